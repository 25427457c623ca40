"""The sets that share most elements with each query set, by prefixes of the rarest elements: an element that all sets have is not joined."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.sources import store

#: Sets, about, that a query's first bound is taken from.
SEED = 4096
#: Sets of one block, and queries that meet a block in one task, about.
BLOCK, ASKED = 16_384, 65_536
#: Characters that a token is looked up by: the most of these that it has. Words that hold this beginning are compared with it.
KEYS = (2, 3, 5, 8)


def held_in(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word) of distinct tokens (token) of two characters and more and distinct words (word) that contain them.

    They meet by a token's beginning, so long that few words are met that do not hold the token: by
    two or three characters alone each token would meet a share of all words.
    """
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substr("word", i, F.lit(n)))
    every = F.flatten(F.array(*[F.when(F.length("word") >= n, parts(n)).otherwise(F.array().cast("array<string>")) for n in KEYS]))
    keyed = words.select("word", F.explode(F.array_distinct(every)).alias("_key"))
    size = F.array_max(F.filter(F.array(*map(F.lit, KEYS)), lambda n: n <= F.length("token")))
    return tokens.select("token", F.left("token", size).alias("_key")).join(keyed, "_key").where(F.contains("word", F.col("token"))).select("token", "word")


def _distinct_sets(rows: DataFrame, keep: int, path: str) -> DataFrame:
    """(sid, elements, ids): equal sets once, with the `keep` least ids of those that have it."""
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("elements").orderBy("id"))).where(F.col("r") <= keep)
    sets = least.groupBy("elements").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # `keep` ids at most
    return store.write(sets.withColumn("sid", F.monotonically_increasing_id()), path)


def _matched(sets: DataFrame, asked: DataFrame, n_sets: int, n_asked: int, keep: int, block: int, together: int) -> DataFrame:
    """(qid, ids, shared): of each block of sets (sid, elements, ids) the `keep` that share most of a query's elements, `bound` at least; ties by the least id.

    asked: (qid, elements, upto, bound), the rarest element first; a set that shares `bound` has
    one of the first `upto`, so a block without any of these is passed over. A block's sets are
    read once for `together` queries, and no pair leaves it but the best.
    """
    ids = sets.schema["ids"].dataType.simpleString()
    blocks, parts = max(1, -(-n_sets // block)), max(1, -(-n_asked // together))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sets.select(F.pmod(F.xxhash64("sid"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), "elements", "ids", F.col("ids")[0].alias("first"))
    right = asked.select(every(blocks).alias("block"), F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part"), "qid", "elements", "upto", "bound")
    schema = pa.schema([("qid", pa.int64()), ("ids", pa.list_(pa.string() if "string" in ids else pa.int64())), ("shared", pa.int32())])

    def best(held: pa.Table, queries: pa.Table) -> pa.Table:
        if not held.num_rows or not queries.num_rows:
            return schema.empty_table()
        held = held.take(pc.sort_indices(held["first"])).combine_chunks()
        named = lambda t: (t["elements"].combine_chunks().flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(t["elements"]).to_numpy())]))
        flat, at = named(held)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        rows = np.repeat(np.arange(held.num_rows), np.diff(at))[order]
        begins = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
        asks, ends = named(queries.combine_chunks())
        asks = pc.fill_null(pc.index_in(asks, value_set=coded.dictionary), -1).to_numpy()
        out, qids, uptos, bounds = [], *(queries[c].to_numpy() for c in ("qid", "upto", "bound"))
        counts = np.zeros(held.num_rows, np.int32)
        for q, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if (asks[a : a + uptos[q]] < 0).all():
                continue
            counts[:] = 0
            for c in asks[a:b]:
                if c >= 0:
                    counts[rows[begins[c] : begins[c + 1]]] += 1
            hit = np.flatnonzero(counts >= bounds[q])
            hit = hit[np.argsort(-counts[hit], kind="stable")[:keep]]
            out.append((np.full(len(hit), qids[q]), hit, counts[hit]))
        if not out:
            return schema.empty_table()
        qid, hit, shared = map(np.concatenate, zip(*out))
        return pa.table([pa.array(qid, pa.int64()), held["ids"].take(pa.array(hit)).cast(schema.field("ids").type), pa.array(shared, pa.int32())], schema=schema)

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(best, f"qid long, ids {ids}, shared int")


def top_overlaps(queries: DataFrame, rows: DataFrame, k: int, least: int = 1, seed: int = SEED) -> DataFrame:
    """(query, id, shared): for each query (query, elements) the k rows (id, elements) that share most elements, `least` at least, ties by id; a row is not its own.

    Equal sets are one from the start, with as many ids as a result can show, so tags that repeat
    cost nothing. A query's elements are put in the order of their frequency, the rarest first.
    About `seed` sets give a first k-th best s; a set that shares s of a query's m elements has one
    of its m - s + 1 rarest. Sets lie in blocks, which all queries visit: a block without these is
    passed over, the others are counted exactly, and each sends on its best few, so pairs are never
    rows. Ids (strings or whole numbers) of queries and rows are compared as they are; null elements
    count for nothing, and repeated ones once.
    """
    path = store.new_folder(rows.sparkSession, "overlaps")
    known = F.array_sort(F.array_distinct(F.filter("elements", lambda x: x.isNotNull())))
    plain = lambda df, c: df.select(F.col(c), known.alias("elements")).where(F.size("elements") > 0)
    sets = _distinct_sets(plain(rows, "id"), k + 1, f"{path}/sets")
    asked = store.write(plain(queries, "query").select("elements").distinct().withColumn("qid", F.monotonically_increasing_id()), f"{path}/asked")
    n_sets, n_asked = sets.count(), asked.count()
    tokens = asked.select("qid", F.explode("elements").alias("element"))
    frequency = sets.select(F.explode("elements").alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    wanted = tokens.join(frequency, "element")
    wanted = wanted.withColumn("p", F.row_number().over(Window.partitionBy("qid").orderBy("df", "element"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("qid")))
    wanted = store.write(wanted, f"{path}/wanted")
    # a query's own elements, which are bounded by its text
    ordered = wanted.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("p", "element"))).alias("e"), F.first("m").alias("m")).select("qid", F.col("e.element").alias("elements"), "m")
    few = sets.where(F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(max(1, n_sets // seed))) == 0)
    seeds = _matched(few, ordered.select("*", F.col("m").alias("upto"), F.lit(least).cast("long").alias("bound")), min(n_sets, seed), n_asked, k + 1, max(n_sets, seed), SEED)
    upto = F.sum(F.size("ids")).over(Window.partitionBy("qid").orderBy(F.desc("shared"), F.col("ids")[0]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sure = seeds.withColumn("n", upto).where(F.col("n") > k).groupBy("qid").agg(F.max("shared").alias("sure"))
    bound = F.greatest(F.coalesce("sure", F.lit(least)), F.lit(least))
    prefix = wanted.join(sure, "qid", "left").where(F.col("p") <= F.col("m") - bound + 1).select("qid", "element", bound.cast("long").alias("bound"))
    prefix = store.write(prefix, f"{path}/prefix")
    of_query = prefix.groupBy("qid").agg(F.count(F.lit(1)).alias("upto"), F.first("bound").alias("bound"))
    met = _matched(sets, ordered.join(of_query, "qid"), n_sets, n_asked, k + 1, BLOCK, ASKED)
    order = lambda key: Window.partitionBy(key).orderBy(F.desc("shared"), "id")
    best = met.select("qid", F.explode("ids").alias("id"), "shared").withColumn("r", F.row_number().over(order("qid"))).where(F.col("r") <= k + 1)
    best = best.join(asked, "qid").select("elements", "id", "shared")
    own = plain(queries, "query").join(best, "elements").where(F.col("query") != F.col("id"))
    return own.withColumn("r", F.row_number().over(order("query"))).where(F.col("r") <= k).select("query", "id", "shared")
