"""Candidates, evidence, distinct-episode gates and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.predicates import is_noise
from cartulary.functions.text import normal_key

# fixed values: a candidate's confidence and gate
BASE, PER_EPISODE, PER_EVIDENCE, MOST = 0.35, 0.18, 0.06, 0.99


# fixed values: the prompts, labels and marks in these patterns
def evidence_type(text: Column, kind: Column) -> Column:
    """Pipeline text before system text before assistant output before derived rows before notes."""
    low = F.lower(text)
    return (
        F.when(low.rlike("write a dream diary|you are a wiki knowledge curator|you are a knowledge card generator"), "pipeline_instruction")
        .when(is_noise(text), "system").when(low.rlike("assistant: no_reply|^assistant:"), "assistant_output")
        .when((kind == "wiki_staging") & text.rlike(r"(?im)^[-*]\s*\*\*Source date"), "derived_staging").when(kind == "dreaming", "derived_dreaming").otherwise("conversation_or_note")
    )


def source_kind(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/_staging/")), "wiki_staging").when(F.contains(path, F.lit("/dreaming/")), "dreaming").otherwise("daily_memory")


def candidate_text(line: Column) -> Column:
    """What a line proposes, without the id at its end; empty if it proposes nothing."""
    value = F.regexp_extract(line, r"(?i)^[-*]\s*\*{0,2}(?:Candidate|Topic)\s*:\s*(.+)$", 1)
    return F.left(F.trim(F.regexp_replace(value, r"(?i)\s+(?:episode|session)[ _-]?id\s*[:=]\s*\S+\s*$", "")), F.lit(240))


def episode_id(text: Column) -> Column:
    """An id that the text states; never one made up from a file's name."""
    found = F.regexp_extract(text, r"(?i)\b(?:episode|session)[_ -]?id\s*[:=]\s*[`\"]?([A-Za-z0-9._:-]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[`\".,)]+$", ""), F.lit(""))


def confidence(episodes: Column, evidence: Column) -> Column:
    return F.round(F.least(F.lit(MOST), BASE + PER_EPISODE * F.least(episodes, F.lit(4)) + PER_EVIDENCE * F.least(evidence, F.lit(5))), 2)


def pool(evidence: DataFrame) -> DataFrame:
    """Candidates from rows (path, line): grouped counts, distinct episodes, confidence and decision.

    Distinct counts are grouped, so no candidate's evidence is gathered in one row.
    """
    line = F.col("line")
    rows = evidence.withColumn("label", candidate_text(line)).where("label <> ''").withColumn("kind", source_kind(F.col("path")))
    rows = rows.select("path", "line", normal_key(F.col("label")).alias("candidate_key"), evidence_type(line, F.col("kind")).alias("type"), episode_id(line).alias("episode"))
    rows = rows.withColumn("eligible", (F.col("type") == "conversation_or_note") & F.col("episode").isNotNull())
    distinct = rows.dropDuplicates(["candidate_key", "path", "type", "line"])
    out = distinct.groupBy("candidate_key").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.count_if("eligible").alias("eligible_evidence"), F.countDistinct(F.when(F.col("eligible"), F.col("episode"))).alias("episodes"),
        F.max((F.col("type") == "conversation_or_note").cast("int")).alias("direct"),
    )
    sure = confidence(F.col("episodes"), F.col("eligible_evidence"))
    decision = F.when(F.col("direct") == 0, "REJECT_SYSTEM_ECHO").when((F.col("episodes") >= 2) & (F.col("eligible_evidence") >= 2) & (sure >= 0.8), "REVIEW_READY").otherwise("HOLD")
    return out.select("candidate_key", "evidence_count", "eligible_evidence", "episodes", sure.alias("confidence"), decision.alias("decision"))


def append_new(store: DataFrame, batch: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): rows of unseen keys, each once; and rows whose key is known with another digest."""
    once = batch.dropDuplicates([key, digest])
    known = store.select(F.col(key), F.col(digest).alias("_known")).distinct()
    return once.join(known, key, "left_anti"), once.join(known, key).where(F.col(digest) != F.col("_known")).drop("_known")
