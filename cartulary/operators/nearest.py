"""Exact nearest vectors: blocks of rows around centres, visited only where the angle between a query and a block lets them hold a neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.vectors import doubles
from cartulary.sources import store

#: Centres (a bounded sample of the rows), rings of angles around each, rows of a block and queries that visit one together, about.
CENTRES, RINGS, BLOCK = 64, 16, 1024


def _units(values: pa.Array) -> np.ndarray:
    v = np.asarray(values.flatten(), float).reshape(len(values), -1)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def placed(vectors: DataFrame, by: list[str], ident: str, vector: str, centres: np.ndarray) -> DataFrame:
    """(by, ident, _v, _angles): unit vectors and their angles to all centres. Null vectors, those of another length and those of length zero have no direction and are left out."""
    size = F.sqrt(F.aggregate(doubles(F.col(vector)), F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.where(F.size(vector) == centres.shape[1]).where(size > 0).select(*by, F.col(ident), doubles(F.col(vector)).alias("_v"))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = _units(batch.column(batch.num_columns - 1))
                angles = np.arccos(np.clip(u @ shared.value.T, -1, 1))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(u), lists(angles)], [*batch.schema.names[:-1], "_v", "_angles"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _angles array<double>")


def nearest_vectors(queries: DataFrame, rows: DataFrame, k: int, floor: float = -1.0, by: tuple[str, ...] = (), ident: str = "vec_id", vector: str = "embedding", query: str = "q", block: int = BLOCK, visits_only: bool = False) -> DataFrame:
    """(by, q, ident, similarity): of each query vector the k rows of its group (by) with the highest cosine, `floor` at least, rounded to six digits; ties by ident; a row is not its own.

    Each row belongs to the ring of its nearest centre that its angle falls in; rings are cut into
    blocks of about `block` rows. By the triangle inequality a query at angle a from the centre is
    at least a - hi, and lo - a, from all rows of a ring of angles lo to hi. A query's likeliest
    rings give its k-th best so far; then it visits the rings that can reach that, and a block is
    scored with the queries that visit it by one matrix product. With visits_only: (q, rows), how
    many rows each query is compared with.
    """
    spark = rows.sparkSession
    path = store.new_folder(spark, "nearest")
    by = list(by)
    many = max(1, min(CENTRES, rows.count() // block))  # few rows need few centres
    sample = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(ident), ident).limit(many).select(doubles(F.col(vector)).alias("v")).collect()  # CENTRES vectors
    dims = max((len(r["v"]) for r in sample), default=1)
    centres = np.array([r["v"] for r in sample if len(r["v"]) == dims and np.any(r["v"])] or [np.eye(1, dims)[0]])
    centres /= np.sqrt((centres * centres).sum(1, keepdims=True))
    around = F.array_min(F.transform("_angles", lambda a, i: F.struct(a.alias("a"), i.alias("c"))))
    near = placed(rows, by, ident, vector, centres).withColumn("_n", around).select(*by, ident, "_v", F.col("_n.c").alias("_c"), F.col("_n.a").alias("_a"))
    near = store.write(near.withColumn("_ring", F.floor(F.col("_a") * RINGS / np.pi).cast("int")), f"{path}/rows")
    group = [*by, F.lit(0).alias("_g")]
    rings = near.groupBy(*by, "_c", "_ring").agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    rings = store.write(rings.withColumn("_parts", F.ceil(F.col("_n") / block)), f"{path}/rings")
    listed = rings.groupBy(*group).agg(F.collect_list(F.struct("_c", "_ring", "_lo", "_hi", "_n", "_parts")).alias("_rings"))  # CENTRES * (RINGS + 1) at most
    asked = placed(queries, by, query, vector, centres).withColumn("_g", F.lit(0)).join(listed, [*by, "_g"])
    bound = lambda x: F.cos(F.greatest(F.lit(0.0), F.get("_angles", x["_c"]) - x["_hi"], x["_lo"] - F.get("_angles", x["_c"])))
    asked = store.write(asked.select(*by, query, "_v", F.transform("_rings", lambda x: F.struct((-bound(x)).alias("o"), x["_c"].alias("_c"), x["_ring"].alias("_ring"), x["_n"].alias("_n"), x["_parts"].alias("_parts"))).alias("_rings")), f"{path}/asked")

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, query, ident, "similarity"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        s = np.round(np.stack(right["_v"].to_numpy()) @ np.stack(left["_v"].to_numpy()).T, 6)
        ids, asks = left[ident].to_numpy(), right[query].to_numpy()
        s[asks[:, None] == ids[None, :]] = -2
        last = np.partition(s, max(s.shape[1] - k, 0), axis=1)[:, max(s.shape[1] - k, 0)]  # ties with the k-th stay
        q, r = np.nonzero((s >= last[:, None]) & (s >= floor) & (s >= -1))
        return pd.DataFrame({**{c: key[i] for i, c in enumerate(by)}, query: asks[q], ident: ids[r], "similarity": s[q, r]}, columns=columns)

    def scored(visits: DataFrame, name: str) -> DataFrame:
        """The best of each query in the blocks of (by, q, v, c, ring, parts)."""
        crowd = visits.groupBy(*by, "_c", "_ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_crowds"))
        visits = visits.join(crowd, [*by, "_c", "_ring"]).select(*by, "_c", "_ring", query, "_v", F.pmod(F.xxhash64(query), F.col("_crowds")).alias("_crowd"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
        blocks = near.join(rings.select(*by, "_c", "_ring", "_parts"), [*by, "_c", "_ring"]).join(crowd, [*by, "_c", "_ring"])
        blocks = blocks.select(*by, "_c", "_ring", ident, "_v", F.pmod(F.xxhash64(ident), F.col("_parts")).alias("_part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_crowds") - 1)).alias("_crowd"))
        keys = [*by, "_c", "_ring", "_part", "_crowd"]
        kinds = {f.name: f.dataType.simpleString() for f in [*near.schema, *asked.schema]}
        found = blocks.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(score, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, query, ident]) + ", similarity double")
        order = Window.partitionBy(*by, query).orderBy(F.desc("similarity"), ident)
        return store.write(found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k), f"{path}/{name}")

    if many > 1:
        first = asked.select(*by, query, "_v", F.inline(F.slice(F.array_sort("_rings"), 1, 2)))
        best = scored(first, "first").groupBy(*by, query).agg(F.max(F.when(F.col("_rank") == k, F.col("similarity"))).alias("kth"))
        reach = asked.join(best, [*by, query], "left").withColumn("bar", F.greatest(F.coalesce("kth", F.lit(floor)), F.lit(floor)) - 1e-6)
    else:  # one centre's rings are nearly all there is
        reach = asked.withColumn("bar", F.lit(floor - 1e-6))
    visits = reach.select(*by, query, "_v", F.inline(F.filter("_rings", lambda x: -x.o >= F.col("bar"))))
    if visits_only:
        return visits.groupBy(*by, query).agg(F.sum("_n").alias("rows"))
    return scored(store.write(visits, f"{path}/visits"), "best").select(*by, query, ident, "similarity")
