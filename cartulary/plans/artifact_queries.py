"""Evidence, artifacts and their store over memory lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions.predicates import NOISE
from cartulary.operators import artifacts as A
from cartulary.operators.evidence import pool
from cartulary.plans.base import query
from cartulary.sources.records import memory_lines, table

_KIND = "CASE WHEN contains(path, '/_staging/') THEN 'wiki_staging' WHEN contains(path, '/dreaming/') THEN 'dreaming' ELSE 'daily_memory' END"
_NOISY = "(" + " OR ".join(f"contains(lower(line), '{m}')" for m in NOISE) + ")"
_TYPE = f"CASE WHEN regexp_matches(lower(line), 'write a dream diary|you are a wiki knowledge curator|you are a knowledge card generator') THEN 'pipeline_instruction' WHEN {_NOISY} THEN 'system' WHEN regexp_matches(lower(line), 'assistant: no_reply|^assistant:') THEN 'assistant_output' WHEN {_KIND} = 'dreaming' THEN 'derived_dreaming' ELSE 'conversation_or_note' END"
_LABEL = r"left(trim(regexp_replace(regexp_extract(line, '(?i)^[-*]\s*\*{0,2}(?:Candidate|Topic)\s*:\s*(.+)$', 1), '(?i)\s+(?:episode|session)[ _-]?id\s*[:=]\s*\S+\s*$', '')), 240)"
_EPISODE = r"""nullif(regexp_replace(regexp_extract(line, '(?i)\b(?:episode|session)[_ -]?id\s*[:=]\s*[`"]?([A-Za-z0-9._:-]+)', 1), '[`".,)]+$', ''), '')"""
_CKEY = r"coalesce(nullif(left(regexp_replace(regexp_replace(lower(trim(label)), '[^\p{L}\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g'), 160), ''), 'unknown')"
_EVIDENCE = f"""evidence AS (SELECT candidate_key, path, type, line, arg_min(label, line_no) AS label, min(line_no) AS line_no, any_value(kind) AS kind, any_value(episode) AS episode, any_value(eligible) AS eligible FROM (
  SELECT *, {_CKEY} AS candidate_key, type = 'conversation_or_note' AND episode IS NOT NULL AS eligible FROM (SELECT *, {_LABEL} AS label, {_KIND} AS kind, {_TYPE} AS type, {_EPISODE} AS episode FROM memory) WHERE label <> '') GROUP BY candidate_key, path, type, line)"""
_SURE = "round(least(0.99, 0.35 + 0.18 * least(episodes, 4) + 0.06 * least(eligible, 5)), 2)::DOUBLE"
_ARTIFACTS = f"""artifacts AS (SELECT *, {_SURE} AS confidence, CASE WHEN direct = 0 THEN 'REJECT_SYSTEM_ECHO' WHEN episodes >= 2 AND eligible >= 2 AND {_SURE} >= 0.8 THEN 'REVIEW_READY' ELSE 'HOLD' END AS decision,
  'candidate:' || CASE WHEN slug = '' THEN 'unknown' ELSE slug END || ':' || left(sha256(candidate_key), 12) AS artifact_id FROM (
  SELECT candidate_key, left(regexp_replace(regexp_replace(lower(candidate_key), '[^a-z0-9._:-]+', '_', 'g'), '^_+|_+$', '', 'g'), 200) AS slug, count(*) AS evidence, count(*) FILTER (eligible) AS eligible, count(DISTINCT CASE WHEN eligible THEN episode END) AS episodes, count(*) FILTER (type = 'system') AS system,
    max((type = 'conversation_or_note')::INT) AS direct, arg_min(label, (path, line_no)) AS label, arg_min(path, (path, line_no)) AS source_path, arg_min(type, (path, line_no)) AS evidence_type, arg_min(kind, (path, line_no)) AS source_kind, arg_min(episode, (path, line_no)) FILTER (episode IS NOT NULL) AS episode FROM evidence GROUP BY candidate_key))"""


def _evidence(spark, sf_dir):
    return A.evidence_rows(memory_lines(spark, sf_dir))


@query("SELECT candidate_key, path, line_no, label, type, kind, episode, eligible, CASE type WHEN 'system' THEN 'system_echo' WHEN 'pipeline_instruction' THEN 'context' WHEN 'assistant_output' THEN 'context' ELSE 'support' END AS role FROM evidence", views=("memory",), ctes=_EVIDENCE)
def evidence_lines(spark, sf_dir):
    """What lines propose, where from, of which kind and role; only stated episodes count."""
    return _evidence(spark, sf_dir).select("candidate_key", "path", "line_no", "label", "type", "kind", "episode", "eligible", A.role(F.col("type")).alias("role"))


@query("SELECT artifact_id, candidate_key, label, source_path, evidence_type, source_kind, episode, evidence, eligible, episodes, system, confidence, decision, CASE decision WHEN 'REVIEW_READY' THEN 'review_ready' WHEN 'HOLD' THEN 'hold' ELSE 'rejected' END AS status, false AS automatic_promotion FROM artifacts", views=("memory",), ctes=f"{_EVIDENCE}, {_ARTIFACTS}")
def candidate_artifacts(spark, sf_dir):
    """An artifact for each candidate: distinct eligible episodes, confidence, decision and provenance."""
    return A.artifacts(_evidence(spark, sf_dir))


@query("SELECT candidate_key, evidence AS evidence_count, eligible AS eligible_evidence, episodes, confidence, decision FROM artifacts", views=("memory",), ctes=f"{_EVIDENCE}, {_ARTIFACTS}")
def candidate_pool(spark, sf_dir):
    """Evidence, distinct episodes, confidence and decision of each candidate."""
    return pool(memory_lines(spark, sf_dir))


@query("SELECT candidate_key, evidence, decision, row_number() OVER (ORDER BY evidence DESC, candidate_key) AS rank FROM artifacts ORDER BY evidence DESC, candidate_key LIMIT 100", views=("memory",), ctes=f"{_EVIDENCE}, {_ARTIFACTS}")
def candidate_order(spark, sf_dir):
    """Candidates with most evidence first, a hundred. (The limit is the report's.)"""
    best = A.artifacts(_evidence(spark, sf_dir)).select("candidate_key", "evidence", "decision").orderBy(F.desc("evidence"), "candidate_key").limit(100)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("evidence"), "candidate_key")).cast("long"))  # a hundred rows


#: Artifacts as they come in files, many of them with a fault. Valid in both, but for the list of evidence.
_FILED = """SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'other.v1' ELSE 'candidate-artifact.v1' END AS schema, CASE WHEN conv_id % 13 = 0 THEN NULL ELSE 'a' || conv_id END AS artifact_id, 'k' || turn AS candidate_key,
  CASE conv_id % 5 WHEN 0 THEN 'review_ready' WHEN 1 THEN 'lost' ELSE 'hold' END AS status, 'daily_memory' AS source_kind, CASE WHEN turn % 7 = 0 THEN NULL ELSE 'system' END AS evidence_type, 'memory/a.md' AS source_path, CASE WHEN turn % 3 = 0 THEN 'short' ELSE sha256_text END AS source_sha256,
  CASE conv_id % 3 WHEN 0 THEN 'HOLD' WHEN 1 THEN 'REVIEW_READY' ELSE 'MAYBE' END AS decision, conv_id % 17 = 0 AS automatic_promotion, text AS excerpt, CASE WHEN turn % 2 = 0 THEN sha256_text ELSE 'x' END AS evidence_sha256, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE true END AS induction_eligible, conv_id % 19 = 0 AS bare FROM texts"""
_TEXTS = "texts AS (SELECT conv_id, turn, text, sha256(text) AS sha256_text FROM conversations)"


@query(
    f"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN schema <> 'candidate-artifact.v1' THEN 'wrong schema' END, CASE WHEN artifact_id IS NULL THEN 'missing required field artifact_id' END, CASE WHEN status = 'lost' THEN 'invalid status' END, CASE WHEN evidence_type IS NULL THEN 'missing provenance.evidence_type' END,
  CASE WHEN len(source_sha256) <> 64 THEN 'invalid source_sha256' END, CASE WHEN bare THEN 'evidence must be non-empty array' END, CASE WHEN decision = 'MAYBE' THEN 'invalid decision label' END, CASE WHEN automatic_promotion THEN 'automatic_promotion must be false' END,
  CASE WHEN status = 'review_ready' AND decision <> 'REVIEW_READY' THEN 'review_ready status/decision mismatch' END, CASE WHEN NOT bare AND sha256(excerpt) <> evidence_sha256 THEN 'evidence[0] sha256 mismatch' END, CASE WHEN NOT bare AND induction_eligible IS NULL THEN 'evidence[0] induction_eligible must be boolean' END], lambda x: x IS NOT NULL), '|') AS errors FROM ({_FILED})""",
    ctes=_TEXTS,
)
def artifact_checks(spark, sf_dir):
    """The twelve checks of an artifact, over artifacts with all their faults."""
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.sha2("text", 256).alias("sha256_text"))
    rows = spark.sql(_FILED.replace("FROM texts", "FROM {texts}"), texts=texts)
    one = F.struct("excerpt", "evidence_sha256", "induction_eligible")
    rows = rows.withColumn("evidence", F.when(F.col("bare"), F.filter(F.array(one), lambda e: F.lit(False))).otherwise(F.array(one)))
    return A.artifact_checks(rows).select("conv_id", "turn", F.array_join("errors", "|").alias("errors"))


_STORE = "SELECT DISTINCT 'a' || conv_id AS artifact_id, md5('v' || CASE WHEN conv_id % 10 = 3 THEN 1 ELSE 0 END) AS artifact_sha256 FROM conversations WHERE conv_id % 2 = 0"
_BATCH = "SELECT conv_id * 1000 + turn AS seq, 'a' || conv_id AS artifact_id, md5('v' || CASE WHEN conv_id % 10 = 8 OR turn = 3 THEN 1 ELSE 0 END) AS artifact_sha256 FROM conversations"


@query(f"SELECT seq, b.artifact_id, CASE WHEN artifact_sha256 <> coalesce(known, first) THEN 'conflict' WHEN known IS NULL AND seq = first_seq THEN 'added' ELSE 'skipped' END AS outcome FROM ({_BATCH}) b LEFT JOIN (SELECT artifact_id, min(artifact_sha256) AS known FROM ({_STORE}) GROUP BY 1) s USING (artifact_id) JOIN (SELECT artifact_id, arg_min(artifact_sha256, seq) AS first, min(seq) AS first_seq FROM ({_BATCH}) GROUP BY 1) f USING (artifact_id)")
def store_ingest(spark, sf_dir):
    """A batch against a store that never changes: added once, skipped, or in conflict."""
    c = table(spark, sf_dir, "conversations")
    of = lambda sql: spark.sql(sql.replace("FROM conversations", "FROM {c}"), c=c)
    return A.ingested(of(_STORE), of(_BATCH)).select("seq", "artifact_id", "outcome")


@query(
    "SELECT candidate_key, count(*) AS artifacts, count(DISTINCT episode) AS episodes, sum(eligible)::BIGINT AS eligible, array_to_string(list_sort(list(DISTINCT evidence_type)), ',') AS types, array_to_string(list_sort(list(DISTINCT decision)), ',') AS decisions, CASE WHEN count(DISTINCT episode) >= 2 AND sum(eligible) >= 2 THEN 'REVIEW_READY' ELSE 'HOLD' END AS gate FROM (SELECT left(candidate_key, 2) AS candidate_key, episode, eligible, evidence_type, decision FROM artifacts) GROUP BY candidate_key",
    views=("memory",), ctes=f"{_EVIDENCE}, {_ARTIFACTS}",
)
def store_review(spark, sf_dir):
    """Artifacts of a store by key (here the first two characters of each, so that keys hold several)."""
    return A.review(A.artifacts(_evidence(spark, sf_dir)).withColumn("candidate_key", F.left("candidate_key", F.lit(2))))


_MARKED = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '- Candidate: ' || replace(text, chr(10), ' ') WHEN 1 THEN '- confidence: 0.5' WHEN 2 THEN CASE WHEN conv_id % 2 = 0 THEN '- recalls: 3' ELSE '## Light Sleep' END ELSE replace(text, chr(10), ' ') END AS line FROM conversations"


@query(
    f"""SELECT conv_id, md5(string_agg(shown, chr(10) ORDER BY turn)) AS said, count(*) AS lines FROM (
  SELECT *, CASE WHEN starts_with(line, '- Candidate:') THEN trim(substr(line, 13)) ELSE line END AS shown, starts_with(line, '- Candidate:') AND trim(substr(line, 13)) = '' AS empty,
    meta AND coalesce(last_value(CASE WHEN NOT meta THEN starts_with(line, '- Candidate:') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM (
      SELECT *, regexp_matches(line, '^- (confidence|evidence|recalls|status|note):') AS meta FROM ({_MARKED}))) WHERE NOT skipped AND NOT empty AND line NOT IN ('## Light Sleep', '## REM Sleep', '### Reflections', '### Possible Lasting Truths') GROUP BY conv_id"""
)
def cleaned_memory(spark, sf_dir):
    """Memory without the lines about a candidate that follow it, and without marks of sleep."""
    rows = spark.sql(_MARKED.replace("FROM conversations", "FROM {c}"), c=table(spark, sf_dir, "conversations"))
    proposes, meta = F.startswith("line", F.lit("- Candidate:")), F.col("line").rlike("^- (?:confidence|evidence|recalls|status|note):")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.last(F.when(~meta, proposes), ignorenulls=True).over(w), F.lit(False))
    shown = F.when(proposes, F.trim(F.substr("line", F.lit(13)))).otherwise(F.col("line"))
    marks = ("## Light Sleep", "## REM Sleep", "### Reflections", "### Possible Lasting Truths")
    rows = rows.withColumn("shown", shown).withColumn("skipped", meta & after).where(~F.col("skipped") & ~(proposes & (F.col("shown") == "")) & ~F.col("line").isin(*marks))
    # one conversation's lines: a text again
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shown"))), lambda x: x.shown), "\n")
    return rows.groupBy("conv_id").agg(F.md5(text).alias("said"), F.count(F.lit(1)).alias("lines"))
