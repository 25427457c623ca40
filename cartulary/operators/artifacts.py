"""Candidate artifacts: built from a pool's evidence, checked, appended to a store and reviewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.operators.evidence import candidate_text, confidence, episode_id, evidence_type, source_kind
from cartulary.functions.text import normal_key

# fixed values: a decision's status, and what statuses and decisions there are
STATUS_OF = {"REVIEW_READY": "review_ready", "HOLD": "hold", "REJECT_SYSTEM_ECHO": "rejected"}
STATUSES = ("pending", "hold", "review_ready", "rejected", "approved", "promoted")


def evidence_rows(lines: DataFrame) -> DataFrame:
    """Evidence (candidate_key, label, path, line_no, line, type, kind, episode, eligible) of lines that propose something, each line of a path and type once."""
    rows = lines.withColumn("label", candidate_text(F.col("line"))).where("label <> ''").withColumn("kind", source_kind(F.col("path")))
    rows = rows.withColumn("candidate_key", normal_key(F.col("label"))).withColumn("type", evidence_type(F.col("line"), F.col("kind"))).withColumn("episode", episode_id(F.col("line")))
    rows = rows.withColumn("eligible", (F.col("type") == "conversation_or_note") & F.col("episode").isNotNull())
    best = F.min_by(F.struct("label", "line_no", "kind", "episode", "eligible"), "line_no")
    return rows.groupBy("candidate_key", "path", "type", "line").agg(best.alias("b")).select("candidate_key", "path", "type", "line", "b.*")


def role(kind: Column) -> Column:
    return F.when(kind == "system", "system_echo").when(kind.isin("pipeline_instruction", "assistant_output"), "context").otherwise("support")


def artifact_id(key: Column) -> Column:
    """The key in the characters of a file's name, 200 of them, and a digest that keeps different keys apart."""
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9._:-]+", "_"), "^_+|_+$", ""), F.lit(200))
    return F.concat(F.lit("candidate:"), F.when(slug == "", "unknown").otherwise(slug), F.lit(":"), F.left(F.sha2(key, 256), F.lit(12)))


def artifacts(evidence: DataFrame) -> DataFrame:
    """An artifact for each candidate key: counts, decision, status, first source and episode. Evidence stays in its own rows, with role and digest, so that none is gathered in one."""
    first = F.min_by(F.struct("label", "path", "type", "kind"), F.struct("path", "line_no"))
    g = evidence.groupBy("candidate_key").agg(
        first.alias("f"), F.min_by("episode", F.when(F.col("episode").isNotNull(), F.struct("path", "line_no"))).alias("episode"), F.count(F.lit(1)).alias("evidence"), F.count_if("eligible").alias("eligible"),
        F.countDistinct(F.when(F.col("eligible"), F.col("episode"))).alias("episodes"), F.count_if(F.col("type") == "system").alias("system"), F.max((F.col("type") == "conversation_or_note").cast("int")).alias("direct"),
    )
    sure = confidence(F.col("episodes"), F.col("eligible"))
    decision = F.when(F.col("direct") == 0, "REJECT_SYSTEM_ECHO").when((F.col("episodes") >= 2) & (F.col("eligible") >= 2) & (sure >= 0.8), "REVIEW_READY").otherwise("HOLD")
    status = F.coalesce(*[F.when(F.col("decision") == d, s) for d, s in STATUS_OF.items()])
    out = g.withColumn("confidence", sure).withColumn("decision", decision).withColumn("status", status)
    return out.select(artifact_id(F.col("candidate_key")).alias("artifact_id"), "candidate_key", F.col("f.label").alias("label"), F.col("f.path").alias("source_path"), F.col("f.type").alias("evidence_type"), F.col("f.kind").alias("source_kind"), "episode", "evidence", "eligible", "episodes", "system", "confidence", "decision", "status", F.lit(False).alias("automatic_promotion"))


def artifact_checks(a: DataFrame, schema: str = "candidate-artifact.v1") -> DataFrame:
    """Adds errors: what twelve checks find wrong with an artifact (schema, artifact_id, candidate_key, status, source_kind, evidence_type, source_path, source_sha256, evidence, decision, automatic_promotion).

    evidence is an array of (excerpt, evidence_sha256, induction_eligible); null columns are missing fields.
    """
    c = F.col
    absent = [F.when(c(n).isNull(), F.lit(f"missing required field {n}")) for n in ("artifact_id", "candidate_key", "status", "evidence", "decision")]
    origin = [F.when(c(n).isNull(), F.lit(f"missing provenance.{n}")) for n in ("source_kind", "evidence_type", "source_path", "source_sha256")]
    items = F.coalesce(c("evidence"), F.array().cast(a.schema["evidence"].dataType))
    numbered = lambda test, text: F.transform(items, lambda e, i: F.when(test(e), F.concat(F.lit("evidence["), i.cast("string"), F.lit(f"] {text}"))))
    checks = [
        F.when(~c("schema").eqNullSafe(schema), "wrong schema"), *absent, F.when(~F.coalesce(c("status").isin(*STATUSES), F.lit(False)), "invalid status"), *origin,
        F.when(F.coalesce(F.length("source_sha256"), F.lit(0)) != 64, "invalid source_sha256"), F.when(F.size(items) == 0, "evidence must be non-empty array"),
        F.when(~F.coalesce(c("decision").isin(*STATUS_OF), F.lit(False)), "invalid decision label"), F.when(~c("automatic_promotion").eqNullSafe(False), "automatic_promotion must be false"),
        F.when(F.coalesce((c("status") == "review_ready") & (c("decision") != "REVIEW_READY"), F.lit(False)), "review_ready status/decision mismatch"),
    ]
    per_item = F.concat(numbered(lambda e: ~F.sha2(F.coalesce(e.excerpt, F.lit("")), 256).eqNullSafe(e.evidence_sha256), "sha256 mismatch"), numbered(lambda e: e.induction_eligible.isNull(), "induction_eligible must be boolean"))
    return a.withColumn("errors", F.filter(F.concat(F.array(*checks), per_item), lambda e: e.isNotNull()))


def ingested(store: DataFrame, batch: DataFrame, key: str = "artifact_id", digest: str = "artifact_sha256", order: str = "seq") -> DataFrame:
    """Outcomes of a batch's rows against a store (key, digest): added, skipped (known with the same digest), conflict (known with another); in the batch the first of a key counts."""
    known = store.groupBy(key).agg(F.min(digest).alias("_known"))
    first = batch.groupBy(key).agg(F.min_by(digest, order).alias("_first"), F.min(order).alias("_at"))
    j = batch.join(known, key, "left").join(first, key)
    own = F.coalesce("_known", "_first")
    added = F.col("_known").isNull() & (F.col(order) == F.col("_at"))
    return j.withColumn("outcome", F.when(F.col(digest) != own, "conflict").when(added, "added").otherwise("skipped")).drop("_known", "_first", "_at")


def review(events: DataFrame) -> DataFrame:
    """By candidate key: artifacts, distinct episodes, eligible evidence, the sorted types and decisions, and whether a review may begin. Events (candidate_key, artifact_id, episode, eligible, evidence_type, decision): the first of an artifact."""
    g = events.groupBy("candidate_key").agg(
        F.count(F.lit(1)).alias("artifacts"), F.countDistinct("episode").alias("episodes"), F.sum("eligible").cast("long").alias("eligible"),
        F.array_join(F.array_sort(F.collect_set("evidence_type")), ",").alias("types"), F.array_join(F.array_sort(F.collect_set("decision")), ",").alias("decisions"),
    )
    return g.withColumn("gate", F.when((F.col("episodes") >= 2) & (F.col("eligible") >= 2), "REVIEW_READY").otherwise("HOLD"))
