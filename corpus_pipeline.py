"""A corpus pipeline: each stage is one operator of cartulary.llm over all rows that the stage before it kept.

Stages: toxic documents go, one document of each group of near copies stays, secrets are masked,
sources are mixed to target weights, and what is left is encoded and decoded.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.bpe import bpe_round_trip
from cartulary.llm.common import Workspace
from cartulary.llm.mixing import mix, word_count
from cartulary.llm.secrets import redact_secrets
from cartulary.llm.simhash import jaccard_components
from cartulary.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go, each row by its own text. The columns pass through the scoring, so no text is shuffled."""
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies stays; of null ids alone, that of one text.

    Near copies are found by SimHash (fingerprints, blocks, differing bits) and by prefixes, for those
    whose fingerprints differ in more bits; an exact comparison of shingles decides on both.

    Rows of one id and text stay or go together. The texts are dealt by both at every size, once.
    """
    gone = Workspace(spark, "distinct").stage(jaccard_components(docs).where("not kept").select("doc_id", "text_key").distinct(), "gone")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_key"))
    return docs.alias("d").join(gone.alias("g").hint("merge"), same, "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text becomes a mark; n_chars follows the text."""
    return redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes whole, taken / size times, rounded up or down.

    Only the documents at the ends of the shards' arcs, about 2 * sqrt(n) of a source's n, are not
    taken whole already. Those of a source, from the longest down, are rounded to the side that
    brings the source's words nearer to its target; so it misses the target by about half a short
    document, or half a long one where the source has few. A document comes at most as often as the
    mix allows. Documents that come zero times go. Rows alike in id, source and size, null ids
    among them, come equally often, their mean rounded up. The texts are dealt by id, source and
    size at every size of the table, once.
    """
    work = Workspace(spark, "mixed")
    key = ["doc_id", "source", "size"]
    taken = work.stage(mix(docs).where("taken > 0").groupBy(*key).agg(F.sum("taken").alias("all"), F.count(F.lit(1)).alias("n")), "taken")
    taken = taken.withColumn("taken", F.ceil(F.col("all") / F.col("n")))
    rest = taken.where("taken % size > 0")
    mark = F.struct("doc_id", "size")
    part = F.sort_array(F.collect_list(F.struct("size", (F.col("taken") % F.col("size")).alias("rest"), mark.alias("mark"))), asc=False)
    none = F.struct(F.lit(0).cast("long").alias("more"), F.array().cast(f"array<struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},size:bigint>>").alias("up"))

    def rounded(done, x):
        raised, lowered = done["more"] + x["size"] - x["rest"], done["more"] - x["rest"]
        up = F.abs(raised) < F.abs(lowered)
        return F.struct(F.when(up, raised).otherwise(lowered).alias("more"), F.when(up, F.array_append(done["up"], x["mark"])).otherwise(done["up"]).alias("up"))

    ups = rest.groupBy("source").agg(part.alias("part")).select("source", F.explode(F.aggregate("part", none, rounded)["up"]).alias("mark"))
    ups = work.stage(ups.select("source", "mark.doc_id", "mark.size", F.lit(1).alias("up")), "up")
    equal = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key])
    times = taken.alias("t").join(ups.alias("u"), equal("t", "u"), "left")
    times = times.select(*[f"t.{c}" for c in key], (F.floor(F.col("t.taken") / F.col("t.size")) + F.coalesce("u.up", F.lit(0))).cast("int").alias("times"))
    times = work.stage(times.where("times > 0"), "times")
    rows = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"))
    rows = rows.alias("d").join(times.alias("t").hint("merge"), equal("d", "t")).select(*[f"d.{c}" for c in COLUMNS], "t.times")
    rows = rows.withColumn("text", F.explode(F.array_repeat(F.col("text"), F.col("times"))))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit), with its source, and digests of them and of the text that they decode to."""
    coded = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=["source"], lean=True)
    return coded.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", keep_clean),
    ("simhash_near_dedup", keep_distinct),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each is written as Parquet and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.stage(docs, name)
    return docs


#: Nearest-neighbour votes, fingerprints, a forest and BPE are not SQL; tests compare with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
