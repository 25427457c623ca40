"""Embedding near-dedup by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import components, dealt, stars, tidy, tiled, whole_runs, Workspace

#: Reference points of a dimension, at most, from a sample of so many vectors (those that hash lowest).
PIVOTS, SAMPLE = 1024, 4096
#: A vector is described by so many nearest pivots; two that share SHARED of them are compared.
NEAREST, SHARED = 8, 3
#: Sample vectors closer than this to a pivot are not pivots, so a crowd of copies gives one.
APART = 0.8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; first by their largest component, so squares neither overflow nor vanish."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, seed: int = 3) -> np.ndarray:
    """Sample vectors, each under APART in cosine from those before it, filled up with seeded random directions."""
    dim = sample.shape[1]
    kept = np.zeros((0, dim))
    for v in sample:
        if len(kept) == pivots:
            break
        if not len(kept) or (kept @ v).max() < APART:
            kept = np.vstack([kept, v])
    rest = np.random.default_rng(seed + dim).standard_normal((pivots - len(kept), dim))
    return np.vstack([kept, unit(rest)]) if len(rest) else kept


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first (ties: the lower number)."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :nearest]


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def pivot_links(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    threshold: float = 0.95,
    pivots: int = PIVOTS,
    nearest: int = NEAREST,
    shared: int = SHARED,
) -> DataFrame:
    """One row for each input row: id, n_links, component_id, kept.

    Two vectors of one dimension are linked if they share `shared` of their `nearest` pivots and
    their cosine, in double precision, is threshold or more. n_links counts the other rows linked
    directly; component_id is the smallest id reachable by links, itself included; kept is
    id = component_id. Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing and are their own component.

    Every vector is posted in an inverted list for each set of `shared` of its pivots. A pair meets
    in every list it shares and is counted in one: that of its lowest shared pivots. Equal
    vectors are one row with a multiplicity from the start; a list of many is dealt in tiles; a
    task sends on, of each vector, its links' number and one edge of a spanning forest. Only the
    pivots are fitted, on SAMPLE vectors of each dimension; a dimension outside the sample has
    random ones. Null ids take part and are never smallest. Repeated rows link with each other.
    An empty table gives an empty table.
    """
    spark = table.sparkSession
    work = Workspace(spark, "pivots")
    rows = table.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))  # no -0.0
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = rows.where(good)
    classes = fine.groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = work.stage(classes.withColumn("key", F.xxhash64("v")).withColumn("dim", F.size("v")), "classes")
    sample: dict[int, list] = {}
    for r in classes.orderBy("key").limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    fitted = spark.sparkContext.broadcast({dim: choose_pivots(unit(np.array(x)), pivots) for dim, x in sample.items()})
    sets = np.array(list(combinations(range(nearest), shared)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(fitted.value)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                if dim not in known:
                    known[dim] = choose_pivots(np.zeros((0, dim)), pivots)
                for k in range(0, own.num_rows, 1024):
                    part = own.slice(k, 1024)
                    near = np.sort(describe(unit(_rows(part.column(2))), known[dim], nearest), axis=1)
                    lists = near[:, sets]
                    code = np.full(lists.shape[:2], dim, np.int64)
                    for j in range(shared):
                        code = code * pivots + lists[:, :, j]
                    keys = np.repeat(part.column(0).to_numpy(), lists.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(code.ravel())], ["key", "list"])

    postings = classes.select("key", "dim", "v").mapInArrow(tidy(post), "key long, list long")
    met = tiled(postings, ["list"], ["key"], deal=False).join(classes.select("key", "v", "dim", "copies"), "key")
    met = dealt(met, ["list"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(fitted.value)
        for columns, starts in whole_runs(batches, ["list", "_i", "_j"], least=20_000):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                dim = int(columns["dim"][lo])
                if dim not in known:
                    known[dim] = choose_pivots(np.zeros((0, dim)), pivots)
                v = unit(np.stack(columns["v"][lo:hi]))
                hit = np.triu(v @ v.T >= threshold, 1)
                a, b = np.nonzero(hit)
                if not len(a):
                    continue
                near = np.sort(describe(v, known[dim], nearest), axis=1)
                last = int(columns["list"][lo]) % pivots
                low = np.zeros((hi - lo, pivots), np.float32)
                np.put_along_axis(low, near, 1.0, axis=1)
                low[:, last + 1 :] = 0
                part = columns["_own"][lo:hi]
                i, j = columns["_i"][lo], columns["_j"][lo]
                # counted once: in the list of the lowest shared pivots, and there in one tile
                once = ((low @ low.T)[a, b] == shared) & ((i == j) | (part[a] != part[b]))
                a, b = a[once], b[once]
                if len(a):
                    key, copies = columns["key"][lo:hi], columns["copies"][lo:hi]
                    links = np.bincount(a, copies[b], hi - lo) + np.bincount(b, copies[a], hi - lo)
                    node, root = stars(key[a], key[b])
                    at = np.flatnonzero(links)
                    out.append((key[at], links[at].astype(np.int64), key[at]))
                    out.append((node, np.zeros(len(node), np.int64), root))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["key", "links", "root"])

    found = work.stage(met.select("list", "_i", "_j", "_own", "key", "dim", "copies", "v").mapInArrow(tidy(compare), "key long, links long, root long"), "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = work.stage(components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), work), "components")
    linked = classes.select("key", "first").join(roots, classes.key == roots.node)
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("key", "least")
    each = classes.select("key", "first", "copies").join(counts, "key", "left").join(linked, "key", "left")
    each = each.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least", "first").alias("component_id"))
    each = work.stage(each, "each")  # so that both sides of the next join are plain shuffles, and Spark can split a crowd of copies
    keyed = rows.select("id", F.when(good, F.xxhash64("v")).alias("key"))
    out = keyed.join(each, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
