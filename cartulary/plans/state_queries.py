"""State (M), gates and queues as batch queries over events, conversations and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions.predicates import promotable
from cartulary.functions.text import simple_upper
from cartulary.operators import state as S
from cartulary.operators.evidence import append_new
from cartulary.plans.base import query
from cartulary.sources.records import table


@query("SELECT 'ns' || (user_id % 3)::VARCHAR AS namespace, user_id AS session_key, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS opened, count(*) > 1 AS resumed FROM events WHERE event_type = 'signup' GROUP BY 1, 2")
def session_opens(spark, sf_dir):
    """M01."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return S.sessions(e.select(F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")).alias("namespace"), F.col("user_id").alias("session_key"), F.col("ts").alias("at")))


@query("SELECT record_id, count(*) AS considered, count(*) FILTER (injected) AS injected, max(similarity) AS similarity, max(seen_at) AS seen_at, max(CASE WHEN injected THEN seen_at END) AS injected_at FROM (SELECT user_id AS record_id, value AS similarity, event_type = 'purchase' AS injected, ts AS seen_at FROM events) GROUP BY record_id")
def usage_totals(spark, sf_dir):
    """Known totals (the first half of the events) with new observations."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("record_id"), F.col("value").alias("similarity"), (F.col("event_type") == "purchase").alias("injected"), F.col("ts").alias("seen_at"))
    none = e.limit(0).select("record_id", F.lit(0).cast("long").alias("considered"), F.lit(0).cast("long").alias("injected"), "similarity", "seen_at", F.col("seen_at").alias("injected_at"))
    prior = S.fold_usage(none, e.where("event_id % 2 = 0").drop("event_id"))
    return S.fold_usage(prior, e.where("event_id % 2 = 1").drop("event_id"))


_JOBS = "SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events"


@query(f"SELECT job_id, arg_max(status, seq) FILTER (late = 0) AS status, count(*) FILTER (late = 0) AS applied, sum(late)::BIGINT AS refused FROM (SELECT *, coalesce(max(CASE WHEN status IN ('succeeded', 'failed', 'cancelled') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM ({_JOBS})) GROUP BY job_id")
def job_states(spark, sf_dir):
    """Terminal states stay; later events are refused and counted."""
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    return S.job_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status")))


@query("SELECT event_id AS job_id FROM events WHERE event_type = 'view' AND epoch(TIMESTAMP '2024-01-15 12:00:00')::BIGINT - floor(epoch(ts))::BIGINT >= 3600")
def stale_jobs(spark, sf_dir):
    """Running for longer than the limit."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "running").otherwise("succeeded").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    return S.stale(jobs, F.lit("2024-01-15 12:00:00").cast("timestamp"), 3600).select("job_id")


@query("SELECT event_id, CASE WHEN event_id % 5 + 1 >= 4 THEN 'dead' ELSE 'waiting' END AS status, CASE WHEN event_id % 5 + 1 < 4 THEN (30 * pow(2, event_id % 5))::BIGINT END AS wait FROM events")
def failure_backoff(spark, sf_dir):
    """Doubling waits; dead after four attempts."""
    status, wait = S.after_failure(F.col("event_id") % 5, 4, 30)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), wait.alias("wait"))


@query("SELECT key, n FROM (SELECT coalesce(b.user_id, a.user_id) AS key, coalesce(b.n, a.n) AS n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id) b ON a.user_id = b.user_id)")
def upserts(spark, sf_dir):
    """Changes replace rows of their keys."""
    e = table(spark, sf_dir, "events")
    rows = lambda t, v: e.where(F.col("event_type") == t).groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(v))
    return S.upsert(rows("view", 1), rows("click", 2), ["key"], "version").select("key", "n")


_STATEMENTS = "SELECT 'n' || (conv_id % 2) AS namespace, CASE conv_id % 3 WHEN 0 THEN upper(split_part(text, ' ', 1)) WHEN 1 THEN '  ' || split_part(text, ' ', 1) || ' ' ELSE split_part(text, ' ', 1) END AS statement, 'e' || (conv_id % 25) AS episode, 't' || conv_id || '-' || turn AS trace, CASE WHEN (conv_id + turn) % 23 = 0 THEN 'rejected' WHEN (conv_id + turn) % 29 = 0 THEN 'promoted' ELSE 'pending' END AS status FROM conversations"


@query(f"SELECT namespace, lower(trim(regexp_replace(statement, '\\s+', ' ', 'g'))) AS key, count(DISTINCT episode) AS episodes, count(DISTINCT trace) AS traces, CASE WHEN max((status = 'rejected')::INT) = 1 THEN 'rejected' WHEN max((status = 'promoted')::INT) = 1 THEN 'promoted' ELSE 'pending' END AS status FROM ({_STATEMENTS}) GROUP BY 1, 2")
def candidate_accumulation(spark, sf_dir):
    """The same statement in another case or spacing is one candidate; a rejected one stays so."""
    c = table(spark, sf_dir, "conversations").withColumn("_upper", simple_upper(F.split_part("text", F.lit(" "), F.lit(1))))
    return S.accumulate_candidates(spark.sql(_STATEMENTS.replace("upper(split_part(text, ' ', 1))", "_upper").replace("FROM conversations", "FROM {c}"), c=c))


_GATED = "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'rejected' ELSE 'pending' END AS status, 'e' || (conv_id % 2) AS e1, 'e' || (turn % 2) AS e2, 't' || (conv_id % 3) AS t1, 't' || (turn % 3) AS t2, turn % 4 = 3 AS one FROM conversations"


@query(f"SELECT conv_id, turn, status <> 'rejected' AND e1 <> e2 AND NOT one AS passes FROM ({_GATED})")
def promotion_gate(spark, sf_dir):
    """Not rejected, two different episodes, and two traces, be they alike."""
    rows = spark.sql(_GATED.replace("FROM conversations", "FROM {c}"), c=table(spark, sf_dir, "conversations"))
    traces = F.when(F.col("one"), F.array("t1")).otherwise(F.array("t1", "t2"))
    return rows.select("conv_id", "turn", promotable(F.col("status"), F.array("e1", "e2"), traces).alias("passes"))


@query("SELECT d.doc_id, CASE WHEN l.sha IS NULL THEN 'new' WHEN l.sha <> d.sha THEN 'conflict' END AS state FROM (SELECT DISTINCT doc_id, md5(text) AS sha FROM documents) d LEFT JOIN (SELECT DISTINCT l.doc_id, md5(CASE WHEN quality = 0 THEN text || ' ' ELSE text END) AS sha FROM labels l JOIN documents USING (doc_id)) l USING (doc_id) WHERE l.sha IS NULL OR l.sha <> d.sha")
def idempotent_append(spark, sf_dir):
    """What an append adds: rows of unseen ids; and rows whose id is known with another digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sha"), "text")
    store = d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.md5(F.when(F.col("quality") == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("sha"))
    new, conflicts = append_new(store, d.select("doc_id", "sha"), "doc_id", "sha")
    return new.select("doc_id", F.lit("new").alias("state")).unionByName(conflicts.select("doc_id", F.lit("conflict").alias("state")))


@query("SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_type = 'click' AND (last IS NULL OR epoch(ts)::BIGINT - epoch(last)::BIGINT > 14400)")
def unseen_results(spark, sf_dir):
    """Not shown within four hours before."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    shown = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("shown_at"))
    return S.unseen(e.where("event_type = 'click'"), shown, "user_id", "ts", 14400).select("event_id", "user_id")


@query("SELECT event_type, arg_min(event_id, (-value, ts, event_id)) AS job_id FROM events WHERE value > 0 GROUP BY event_type")
def next_jobs(spark, sf_dir):
    """Of each queue the eligible job of the highest priority, the oldest of equals."""
    e = table(spark, sf_dir, "events").where("value > 0")
    return e.groupBy("event_type").agg(F.min_by("event_id", F.struct((-F.col("value")).alias("p"), "ts", "event_id")).alias("job_id"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_jobs(spark, sf_dir):
    """Events by day."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_FAILING = "SELECT DISTINCT user_id AS alert FROM events WHERE event_type = 'error' AND event_id % 2 = "


@query(f"SELECT alert, 'new' AS change FROM ({_FAILING}1) WHERE alert NOT IN ({_FAILING}0) UNION ALL SELECT alert, 'recovered' FROM ({_FAILING}0) WHERE alert NOT IN ({_FAILING}1)")
def alert_changes(spark, sf_dir):
    """Alerts that came (odd events) and went (even ones)."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    of = lambda k: e.where(F.col("event_id") % 2 == k).select(F.col("user_id").alias("alert")).distinct()
    return S.changes(of(0), of(1), "alert")


@query("SELECT doc_id, CASE WHEN l.quality = 1 THEN 'done' WHEN l.quality = 0 THEN 'failed' WHEN d.doc_id % 3 = 0 THEN 'processing' ELSE 'todo' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def queue_reconcile(spark, sf_dir):
    """A queue against what exists."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed").when(F.col("doc_id") % 3 == 0, "processing").otherwise("todo")
    return j.select("doc_id", status.alias("status"))
