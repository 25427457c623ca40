"""State of streams that start again over one checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.plans.base import query
from cartulary.sources.records import table
from cartulary.streaming import machines as M

_STATUS = "CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query(
    f"""SELECT job_id, arg_max(status, (ts, seq)) FILTER (late = 0) AS status, count(*) FILTER (late = 0) AS applied, sum(late)::BIGINT AS refused FROM (
  SELECT *, coalesce(max(CASE WHEN status IN ('succeeded', 'failed', 'cancelled') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late
  FROM (SELECT user_id AS job_id, date_trunc('millisecond', ts) AS ts, event_id AS seq, {_STATUS} AS status FROM events)) GROUP BY job_id"""
)
def job_stream(spark, sf_dir):
    """Job states from events that come up to ten days late, in parts that a stream takes up one after another; a last event of no job moves the watermark past all."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.expr(_STATUS).alias("status"))
    came = F.floor((F.unix_timestamp("ts") + F.pmod(F.xxhash64("seq"), F.lit(10 * 86_400))) / (12 * 86_400))
    low, high = e.agg(F.min(came), F.max(came)).first()
    last = spark.createDataFrame([(-1, 0, "running")], "job_id long, seq long, status string").select("job_id", F.lit("2100-01-01").cast("timestamp").alias("ts"), "seq", "status")
    parts = [e.where(came == k) for k in range(low, high + 1)]
    rows = M.fed(spark, [*parts, last], lambda s: M.ordered_jobs(s, "10 days"), "update").where("job_id >= 0")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "applied", "refused"), F.col("applied") + F.col("refused")).alias("r")).select("job_id", "r.*")


_RUNS = "SELECT DISTINCT user_id % 8 AS scope, day(ts) // 8 AS run, CASE WHEN event_type = 'error' THEN 'user ' || user_id END AS alert FROM events"


@query(
    f"""WITH runs AS ({_RUNS}), numbers AS (SELECT scope, run, lag(run) OVER (PARTITION BY scope ORDER BY run) AS before FROM (SELECT DISTINCT scope, run FROM runs))
  SELECT n.scope, n.run, r.alert, 'new' AS change FROM numbers n JOIN runs r USING (scope, run) WHERE r.alert IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs b WHERE b.scope = n.scope AND b.run = n.before AND b.alert = r.alert)
  UNION ALL SELECT n.scope, n.run, b.alert, 'recovered' FROM numbers n JOIN runs b ON b.scope = n.scope AND b.run = n.before WHERE b.alert IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.scope = n.scope AND r.run = n.run AND r.alert = b.alert)"""
)
def alert_runs(spark, sf_dir):
    """Users with errors as alerts; of each run of eight days what is new and what has recovered, by a stream that ends after each run and knows from its checkpoint what it has told."""
    e = table(spark, sf_dir, "events")
    runs = e.select((F.col("user_id") % 8).alias("scope"), F.expr("day(ts) div 8").cast("long").alias("run"), F.when(F.col("event_type") == "error", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("alert")).distinct()
    return M.fed(spark, [runs.where(F.col("run") == k) for k in range(4)], M.told_alerts, "append").drop("_batch")
