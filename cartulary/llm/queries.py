"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.bpe import bpe_round_trip
from cartulary.llm.divergence import AUDIT_SQL, audit_sources
from cartulary.llm.language import identify_languages
from cartulary.llm.media import media_columns
from cartulary.llm.mixing import MIX_SQL, mix
from cartulary.llm.pivots import pivot_links
from cartulary.llm.ppm import score_texts
from cartulary.llm.quality import score_quality
from cartulary.llm.secrets import scan_secrets
from cartulary.llm.simhash import simhash_components
from cartulary.llm.tokens import tokens_round_trip
from cartulary.llm.toxicity import score_toxicity
from cartulary.llm.variants import group_variants, VARIANTS_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their spans and the forest's verdict; the value itself is shown by its digest only."""
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, linked at four differing bits or fewer."""
    return simhash_components(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text likelihoods are fitted on documents."""
    return identify_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a word model and under PPM."""
    return score_texts(_table(spark, sf_dir, "documents"))


def op5_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.95 or more."""
    return pivot_links(_table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the text that they decode to."""
    coded = bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place among all ids, and the checksum of its ids, as read from the files."""
    read = tokens_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the nearest examples as evidence."""
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating; a document may come up to three times."""
    return mix(_table(spark, sf_dir, "documents")).drop("source")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload and media digests and features of each document, as read from the tar shards."""
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    return media_columns(_table(spark, sf_dir, "documents")).select(*columns)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that tell each from its language."""
    return audit_sources(_table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their commonest near word and the root of their chain of forms."""
    return group_variants(_table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores with the sizes that they follow from."""
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_simhash, op3_language, op4_ppm, op5_pivots, op6_bpe, op7_tokens, op8_toxicity, op9_mix, op10_media, op11_divergence, op12_variants, op13_quality)}

ORACLES = {"op9_mix": MIX_SQL, "op11_divergence": AUDIT_SQL, "op12_variants": VARIANTS_SQL}
