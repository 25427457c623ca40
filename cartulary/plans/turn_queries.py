"""Turns, traces, candidates and jobs over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions.predicates import NOISE, is_noise
from cartulary.operators import turns as T
from cartulary.plans.base import query
from cartulary.sources.records import table

#: Requests to start turns: every turn of a conversation, some again, some with another query, session or namespace. Valid in both.
_STARTS = """
SELECT conv_id * 100000 + turn * 10 AS seq, 't' || conv_id || '-' || turn AS turn_id, 's' || (conv_id % 40) AS session_id, text AS query, CASE WHEN conv_id % 9 = 0 THEN 'team-b' WHEN conv_id % 9 = 1 THEN ' ' WHEN conv_id % 9 = 2 THEN 'team-a' END AS namespace FROM conversations
UNION ALL SELECT conv_id * 100000 + turn * 10 + 1, 't' || conv_id || '-' || turn, 's' || (conv_id % 40), ' ' || text, NULL FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT conv_id * 100000 + turn * 10 + 2, 't' || conv_id || '-' || turn, 's' || (conv_id % 40), 'other', NULL FROM conversations WHERE turn % 3 = 0
UNION ALL SELECT conv_id * 100000 + turn * 10 + 3, 't' || conv_id || '-' || turn, 's' || ((conv_id + 1) % 30), text, NULL FROM conversations WHERE turn % 4 = 1
UNION ALL SELECT conv_id * 100000 + turn * 10 + 4, 't' || conv_id || '-' || turn, 's' || (conv_id % 40), '', NULL FROM conversations WHERE turn % 5 = 1"""
_SESSIONS = "SELECT DISTINCT 's' || (conv_id % 30) AS session_id, CASE conv_id % 30 % 2 WHEN 0 THEN 'team-a' ELSE 'private' END AS namespace FROM conversations"


def _of(spark, sf_dir, sql, name="conversations"):
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


@query(
    f"""SELECT seq, turn_id, CASE WHEN trim(session_id) = '' OR trim(query) = '' THEN 'session_id and query are required' WHEN own IS NULL THEN 'unknown session_id' WHEN namespace IS NOT NULL AND trim(namespace) = '' THEN 'namespace is required' WHEN trim(namespace) <> own THEN 'namespace conflicts with session'
  WHEN seq = first_seq THEN 'started' WHEN session_id <> first_session THEN 'turn_id conflicts with existing session_id' WHEN trim(query) <> first_query THEN 'turn_id conflicts with existing query' ELSE 'resumed' END AS outcome FROM (
  SELECT *, min(CASE WHEN good THEN seq END) OVER w AS first_seq, arg_min(session_id, CASE WHEN good THEN seq END) OVER w AS first_session, arg_min(trim(query), CASE WHEN good THEN seq END) OVER w AS first_query FROM (
    SELECT r.*, s.namespace AS own, trim(r.session_id) <> '' AND trim(r.query) <> '' AND s.namespace IS NOT NULL AND (r.namespace IS NULL OR trim(r.namespace) = s.namespace) AS good FROM ({_STARTS}) r LEFT JOIN ({_SESSIONS}) s ON r.session_id = s.session_id) WINDOW w AS (PARTITION BY turn_id))"""
)
def turn_starts(spark, sf_dir):
    """A turn's id is an idempotency key: the same request resumes, another conflicts."""
    return T.start_outcomes(_of(spark, sf_dir, _STARTS), _of(spark, sf_dir, _SESSIONS)).select("seq", "turn_id", "outcome")


_ENDS = """
SELECT conv_id * 100000 + turn * 10 AS seq, 't' || conv_id || '-' || turn AS turn_id, 'q' || conv_id AS query, text AS answer, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'cancelled' WHEN (conv_id + turn) % 13 = 0 THEN 'lost' END AS status FROM conversations
UNION ALL SELECT conv_id * 100000 + turn * 10 + 1, 't' || conv_id || '-' || turn, ' q' || conv_id, text || ' ', 'succeeded' FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT conv_id * 100000 + turn * 10 + 2, 't' || conv_id || '-' || turn, 'q' || conv_id, 'another', NULL FROM conversations WHERE turn % 3 = 0
UNION ALL SELECT conv_id * 100000 + turn * 10 + 3, 't' || conv_id || '-' || turn, 'q' || conv_id, '', NULL FROM conversations WHERE turn % 4 = 0
UNION ALL SELECT conv_id * 100000 + turn * 10 + 4, 't' || conv_id || '-' || turn, 'q', 'a', 'cancelled' FROM conversations WHERE turn % 5 = 0"""
_KNOWN = "SELECT 't' || conv_id || '-' || turn AS turn_id FROM conversations WHERE conv_id % 17 <> 3"


def _js(x: str) -> str:
    return f"to_json({x})::VARCHAR"


_TRACE = f"'trace:' || left(sha256('{{\"answer\": ' || {_js('trim(answer)')} || ', \"content\": null, \"query\": ' || {_js('trim(query)')} || ', \"status\": \"succeeded\", \"turn_id\": ' || {_js('turn_id')} || '}}'), 24)"
_DONE = f"""SELECT seq, turn_id, trace_id, CASE WHEN s NOT IN ('succeeded', 'cancelled') THEN 'status must be succeeded or cancelled' WHEN s = 'succeeded' AND (trim(query) = '' OR trim(answer) = '') THEN 'query and answer are required unless status is cancelled' WHEN s = 'succeeded' AND NOT known THEN 'unknown turn_id'
  WHEN s = 'cancelled' THEN 'cancelled' WHEN gone IS NOT NULL AND (stored IS NULL OR gone < stored) AND seq > gone THEN 'unknown turn_id' WHEN seq = stored THEN 'stored' WHEN trace_id = kept THEN 'deduplicated' ELSE 'turn completion conflicts with existing payload' END AS outcome, answer FROM (
  SELECT *, min(CASE WHEN trace_id IS NOT NULL THEN seq END) OVER w AS stored, min(CASE WHEN s = 'cancelled' THEN seq END) OVER w AS gone, arg_min(trace_id, CASE WHEN trace_id IS NOT NULL THEN seq END) OVER w AS kept FROM (
    SELECT *, CASE WHEN s = 'succeeded' AND trim(query) <> '' AND trim(answer) <> '' AND known THEN {_TRACE} END AS trace_id FROM (
      SELECT e.*, coalesce(nullif(trim(e.status), ''), 'succeeded') AS s, k.turn_id IS NOT NULL AS known FROM ({_ENDS}) e LEFT JOIN ({_KNOWN}) k ON e.turn_id = k.turn_id)) WINDOW w AS (PARTITION BY turn_id))"""


def _completed(spark, sf_dir):
    return T.completion_outcomes(_of(spark, sf_dir, _ENDS), _of(spark, sf_dir, _KNOWN))


@query(f"SELECT seq, turn_id, trace_id, outcome FROM ({_DONE})")
def turn_completions(spark, sf_dir):
    """Completions by the digest of what was said: stored, deduplicated, in conflict, cancelled."""
    return _completed(spark, sf_dir).select("seq", "turn_id", "trace_id", "outcome")


_NORMAL = r"lower(trim(regexp_replace(answer, '\s+', ' ', 'g')))"
_KEY = f"'conversation:private:' || left(sha256('{{\"value\": ' || {_js(_NORMAL)} || '}}'), 32)"


@query(
    f"""SELECT coalesce(n.k, o.k) AS candidate_key, CASE WHEN coalesce(o.status, 'pending') IN ('pending', 'approved') THEN coalesce(n.episodes, 0) ELSE 0 END AS episodes, CASE WHEN coalesce(o.status, 'pending') IN ('pending', 'approved') THEN coalesce(n.traces, 0) ELSE 0 END AS traces, coalesce(o.status, 'pending') AS status
  FROM (SELECT {_KEY} AS k, count(DISTINCT split_part(turn_id, '-', 1)) AS episodes, count(DISTINCT trace_id) AS traces FROM ({_DONE}) WHERE outcome = 'stored' GROUP BY 1) n
  FULL JOIN (SELECT {_KEY} AS k, CASE WHEN min(conv_id) % 3 = 0 THEN 'rejected' WHEN min(conv_id) % 3 = 1 THEN 'approved' ELSE 'promoted' END AS status FROM (SELECT text AS answer, conv_id FROM conversations WHERE turn = 1) GROUP BY 1) o ON n.k = o.k"""
)
def turn_candidates(spark, sf_dir):
    """Stored completions gather as candidates by what they say; rejected and promoted ones stay as they are."""
    done = _completed(spark, sf_dir).where("outcome = 'stored'").select(F.lit("private").alias("namespace"), "answer", F.split("turn_id", "-")[0].alias("episode"), F.col("trace_id").alias("trace"))
    status = F.expr("CASE WHEN min(conv_id) % 3 = 0 THEN 'rejected' WHEN min(conv_id) % 3 = 1 THEN 'approved' ELSE 'promoted' END")
    old = table(spark, sf_dir, "conversations").where("turn = 1").groupBy(T.candidate_key(F.lit("private"), F.col("text")).alias("candidate_key")).agg(status.alias("status"))
    return T.candidates_of(done, old)


#: Traces to capture, some without identity, of an unknown kind or without content. Valid in both.
_CAPTURES = """SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'e' || conv_id END AS episode_id, CASE WHEN (conv_id + turn) % 7 = 0 THEN ' ' ELSE 's' || conv_id END AS session_id, CASE conv_id % 5 WHEN 0 THEN 'rumour' WHEN 1 THEN 'tool_run' END AS source_type,
  't' || turn AS source_id, CASE WHEN turn % 2 = 0 THEN 'agent' END AS agent_id, CASE WHEN turn % 3 = 0 THEN 'team-a' END AS namespace, CASE WHEN turn % 6 = 5 THEN ' ' ELSE text END AS content, '2026-01-0' || (1 + conv_id % 9) AS observed_at FROM conversations"""
_CERR = "CASE WHEN coalesce(trim(episode_id), '') = '' AND trim(session_id) = '' THEN 'episode_id or session_id is required; identity is never inferred' WHEN coalesce(source_type, 'conversation') NOT IN ('conversation', 'tool_run', 'external_source') THEN 'source_type must be conversation, tool_run, or external_source' WHEN trim(content) = '' THEN 'content is required' END"
_OPT = lambda n: f"coalesce({_js(f'nullif(trim({n}), {chr(39) * 2})')}, 'null')"
_HASH = f"""sha256('{{"content": ' || {_js('trim(content)')} || ', "identity": {{"agent_id": ' || {_js("coalesce(agent_id, 'unknown')")} || ', "episode_id": ' || {_OPT('episode_id')} || ', "namespace": ' || {_js("coalesce(namespace, 'private')")} || ', "session_id": ' || {_OPT('session_id')}
  || '}}, "observed_at": ' || {_js('observed_at')} || ', "raw_source_refs": ["turn:' || source_id || '"], "source_id": ' || {_js('source_id')} || ', "source_type": ' || {_js("coalesce(source_type, 'conversation')")} || '}}')"""


@query(f"SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN {_HASH} END AS provenance_sha256, CASE WHEN error IS NULL THEN 'trace:' || left({_HASH}, 24) END AS trace_id FROM (SELECT *, {_CERR} AS error FROM ({_CAPTURES}))")
def trace_captures(spark, sf_dir):
    """Traces with ids from their content, so that the same trace has the same id; those that lack something say what."""
    rows = _of(spark, sf_dir, _CAPTURES).withColumn("refs", F.array(F.concat(F.lit("turn:"), F.col("source_id"))))
    return T.capture_errors(rows).select("conv_id", "turn", "error", "provenance_sha256", "trace_id")


_SAID = "SELECT conv_id, arg_max(trim(text), turn) FILTER (role = 'user' AND trim(text) <> '') AS q, arg_max(trim(text), turn) FILTER (role = 'assistant' AND trim(text) <> '') AS a FROM conversations GROUP BY conv_id"
_NOISY = "(" + " OR ".join(f"contains(lower(q || chr(10) || a), '{m}')" for m in NOISE) + ")"


@query(f"SELECT conv_id, md5(left(q, 4000)) AS question, md5(left(a, 4000)) AS answer, conv_id % 6 <> 0 AND q IS NOT NULL AND a IS NOT NULL AND NOT {_NOISY} AS imported FROM ({_SAID})")
def trace_imports(spark, sf_dir):
    """The last question and answer of each conversation; which are imported: not known yet, both there, no noise."""
    c = table(spark, sf_dir, "conversations")
    last = lambda role: F.max_by(F.when((F.col("role") == role) & (F.trim("text") != ""), F.trim("text")), F.when((F.col("role") == role) & (F.trim("text") != ""), F.col("turn")))
    said = c.groupBy("conv_id").agg(last("user").alias("q"), last("assistant").alias("a"))
    known = c.where("conv_id % 6 = 0").select("conv_id").distinct().withColumn("known", F.lit(True))
    new = F.col("known").isNull() & F.col("q").isNotNull() & F.col("a").isNotNull() & ~is_noise(F.col("q"), F.col("a"))
    return said.join(known, "conv_id", "left").select("conv_id", F.md5(F.left("q", F.lit(4000))).alias("question"), F.md5(F.left("a", F.lit(4000))).alias("answer"), new.alias("imported"))


_JOBS = """SELECT 'j' || conv_id || '-' || turn AS job_id, CASE WHEN turn % 7 = 6 THEN 'index' ELSE 'distill' END AS stage, 'to_candidate' AS worker, CASE (conv_id + turn) % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, 'tr' || conv_id || '-' || turn AS input_ref, 'c' || conv_id AS output_ref FROM conversations"""
_TURNS = "SELECT 'tr' || conv_id || '-' || turn AS trace_id, CASE WHEN turn % 4 = 1 THEN 'SELF_REVIEW_SENT ' || text ELSE text END AS said FROM conversations WHERE (conv_id + turn) % 9 <> 1"
_CANDIDATES = "SELECT DISTINCT 'c' || conv_id AS candidate_id, 'value ' || conv_id AS value FROM conversations WHERE conv_id % 8 <> 5"
_MARKS = "list_sort(list_filter([" + ", ".join(f"'{m}'" for m in NOISE) + "], lambda m: contains(lower(said || chr(10) || value), m)))"


@query(
    f"""SELECT job_id, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'failed' END AS status, error, error IS NOT NULL AS retryable, CASE WHEN error IS NULL THEN CASE WHEN len({_MARKS}) > 0 THEN 'REJECT_SYSTEM_ECHO' ELSE 'HOLD' END END AS decision, CASE WHEN error IS NULL THEN array_to_string({_MARKS}, ',') END AS markers FROM (
  SELECT j.*, said, value, CASE WHEN stage <> 'distill' THEN 'job is not a distillation job' WHEN status = 'failed' THEN 'job is not processable' WHEN said IS NULL OR value IS NULL THEN 'job input/output provenance could not be resolved' END AS error
  FROM ({_JOBS}) j LEFT JOIN ({_TURNS}) t ON j.input_ref = t.trace_id LEFT JOIN ({_CANDIDATES}) c ON j.output_ref = c.candidate_id)"""
)
def distillations(spark, sf_dir):
    """Jobs run over their turn and candidate; failures are rows that may be tried again."""
    out = T.distilled(_of(spark, sf_dir, _JOBS), _of(spark, sf_dir, _TURNS), _of(spark, sf_dir, _CANDIDATES))
    return out.withColumn("markers", F.array_join("markers", ","))


_ACTIONS = "SELECT user_id AS candidate_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'force' ELSE 'approve' END AS action, value > 100 AS eligible FROM events"


@query(
    f"""SELECT candidate_id, CASE WHEN max(promoted::INT) = 1 THEN 'promoted' WHEN max((action = 'reject')::INT) = 1 THEN 'rejected' WHEN max(ok::INT) = 1 THEN 'approved' ELSE 'pending' END AS status, count(*) FILTER (ok AND NOT eligible) AS forced FROM (
  SELECT *, coalesce(max((promoted OR action = 'reject')::INT) OVER (PARTITION BY candidate_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM (
    SELECT *, action = 'promote' AND coalesce(max(ok::INT) OVER (PARTITION BY candidate_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS promoted FROM (
      SELECT *, action = 'force' OR (action = 'approve' AND eligible) AS ok FROM ({_ACTIONS})))) WHERE late = 0 GROUP BY candidate_id"""
)
def promotion_states(spark, sf_dir):
    """Pending, approved by the gate or by force, then promoted or rejected, where it ends."""
    return T.promotions(_of(spark, sf_dir, _ACTIONS, "events"))


@query("SELECT event_id, 'waiting' AS status, event_id % 4 + 1 AS attempts, floor(epoch(ts))::BIGINT + 30 AS not_before FROM events")
def released_jobs(spark, sf_dir):
    """Given back with one attempt more, not before 30 seconds have gone."""
    status, attempts, at = T.released(F.col("event_id") % 4, F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), attempts.alias("attempts"), F.unix_timestamp(at).alias("not_before"))


@query("SELECT event_id AS job_id, step, CASE step WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END END AS status FROM events, (VALUES (0), (1), (2)) s(step)")
def worker_events(spark, sf_dir):
    """The events that a worker reports of each job."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("started"), F.col("ts").alias("ended"), (F.col("event_type") == "error").alias("failed"))
    return T.worker_events(jobs).select("job_id", "step", "status")


@query("SELECT user_id, count(*) AS chunks, count(*) FILTER (event_type = 'purchase') AS succeeded, count(*) = count(*) FILTER (event_type <> 'view') AS ready FROM events GROUP BY user_id")
def chunk_barriers(spark, sf_dir):
    """What waits until all chunk jobs of its group have ended."""
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    return T.ready_to_join(table(spark, sf_dir, "events").select("user_id", status.alias("status")), "user_id")


@query("SELECT id, ts FROM (SELECT event_id AS id, ts FROM events ORDER BY event_id DESC LIMIT 5000)")
def import_bookkeeping(spark, sf_dir):
    """The ids of the last 5,000 imports. (The limit is the operator's.)"""
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(5000).select(F.col("event_id").alias("id"), "ts")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view') ORDER BY ts DESC, event_id DESC LIMIT 200")
def newest_jobs(spark, sf_dir):
    """The newest jobs of some states, 200 at most. (The limit is the operator's.)"""
    return table(spark, sf_dir, "events").where("event_type in ('error', 'view')").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type")


@query(
    "SELECT conv_id, turn, round(0.65 * ((contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT) / 2.0), 4)::DOUBLE AS score FROM (SELECT c.* FROM conversations c JOIN (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'team-a' ELSE 'private' END AS namespace FROM conversations) s ON c.conv_id = s.conv_id WHERE s.namespace = 'private' ORDER BY c.conv_id DESC, turn DESC LIMIT 500) WHERE contains(lower(text), 'the') OR contains(lower(text), 'und') ORDER BY 3 DESC, 1 DESC, 2 DESC LIMIT 30"
)
def namespace_recall(spark, sf_dir):
    """Turns of one namespace's sessions, the latest 500, by the share of terms, discounted. (Both limits are the operator's.)"""
    c = table(spark, sf_dir, "conversations")
    sessions = c.select("conv_id", F.when(F.col("conv_id") % 3 == 0, "team-a").otherwise("private").alias("namespace")).distinct()
    latest = c.join(sessions.where("namespace = 'private'"), "conv_id").orderBy(F.desc("conv_id"), F.desc("turn")).limit(500)
    hits = F.contains(F.lower("text"), F.lit("the")).cast("int") + F.contains(F.lower("text"), F.lit("und")).cast("int")
    return latest.where(hits > 0).select("conv_id", "turn", F.round(0.65 * (hits / 2.0), 4).cast("double").alias("score")).orderBy(F.desc("score"), F.desc("conv_id"), F.desc("turn")).limit(30)


@query("SELECT conv_id, turn, contains(lower(k), 'token') OR contains(lower(k), 'api_key') AS hidden, CASE WHEN contains(lower(k), 'token') OR contains(lower(k), 'api_key') THEN '[REDACTED]' ELSE v END AS v FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Access_Token' WHEN 1 THEN 'my_API_KEY_2' ELSE 'note' END AS k, md5(text) AS v FROM conversations)")
def redacted_payloads(spark, sf_dir):
    """Values of secret keys are not kept."""
    name = F.when(F.col("turn") % 3 == 0, "Access_Token").when(F.col("turn") % 3 == 1, "my_API_KEY_2").otherwise("note")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.redacted(F.create_map(name, F.md5("text"))).alias("m"))
    value = F.map_values("m")[0]
    return rows.select("conv_id", "turn", (value == "[REDACTED]").alias("hidden"), value.alias("v"))


