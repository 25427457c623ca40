"""Batch forms of keyed state: upserts, job machine, usage, queues. Violations are rows, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.text import normal_statement

TERMINAL = ("succeeded", "failed", "cancelled")


def upsert(state: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key of both (ties: the change's): one union and one grouped maximum."""
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rows = [c for c in state.columns if c not in key]
    best = F.max_by(F.struct(*rows), F.struct(F.col(version).alias("v"), F.col("_new").alias("n")))
    return both.groupBy(*key).agg(best.alias("_r")).select(*key, *[f"_r.{c}" for c in rows]).select(*state.columns)


def fold_usage(prior: DataFrame, observed: DataFrame) -> DataFrame:
    """Counts, best similarity and times of each record: what was known with what is observed (record_id, similarity, injected, seen_at)."""
    injected_at = F.when(F.col("injected"), F.col("seen_at"))
    new = observed.select("record_id", F.lit(1).cast("long").alias("considered"), F.col("injected").cast("long").alias("injected"), "similarity", "seen_at", injected_at.alias("injected_at"))
    return prior.unionByName(new).groupBy("record_id").agg(F.sum("considered").alias("considered"), F.sum("injected").alias("injected"), F.max("similarity").alias("similarity"), F.max("seen_at").alias("seen_at"), F.max("injected_at").alias("injected_at"))


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after its events (job_id, seq, status): the first terminal one is final. Adds the number of events refused."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("status").isin(*TERMINAL).cast("int")).over(w), F.lit(0))
    rows = events.withColumn("_late", ended)
    ok = rows["_late"] == 0
    return rows.groupBy("job_id").agg(F.max_by(F.when(ok, F.col("status")), F.when(ok, F.col("seq"))).alias("status"), F.count_if(ok).alias("applied"), F.sum("_late").cast("long").alias("refused"))


def stale(jobs: DataFrame, now: Column, older_than: int) -> DataFrame:
    """Running jobs not updated for older_than seconds (60 to 30 days)."""
    if not 60 <= older_than <= 2_592_000:
        raise ValueError("older_than must be between 60 and 2592000 seconds")
    return jobs.where((F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") >= older_than))


def after_failure(attempts: Column, most: int, delay: int) -> tuple[Column, Column]:
    """(status, seconds to wait) after one more failed attempt: the wait doubles; dead after the last."""
    n = attempts + 1
    return F.when(n >= most, "dead").otherwise("waiting"), F.when(n >= most, F.lit(None)).otherwise((F.lit(delay) * F.pow(F.lit(2), attempts)).cast("long"))


def sessions(turns: DataFrame) -> DataFrame:
    """One row for each (namespace, session_key), with its first time and number of openings; resumed if more than one."""
    return turns.groupBy("namespace", "session_key").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.count(F.lit(1)).alias("opened")).withColumn("resumed", F.col("opened") > 1)


def accumulate_candidates(statements: DataFrame) -> DataFrame:
    """Candidates from statements (namespace, statement, episode, trace, status): grouped by the normal form; rejected and promoted stay."""
    g = statements.withColumn("key", normal_statement(F.col("statement"))).groupBy("namespace", "key")
    status = F.when(F.max((F.col("status") == "rejected").cast("int")) == 1, "rejected").when(F.max((F.col("status") == "promoted").cast("int")) == 1, "promoted").otherwise("pending")
    return g.agg(F.countDistinct("episode").alias("episodes"), F.countDistinct("trace").alias("traces"), status.alias("status"))


def unseen(rows: DataFrame, shown: DataFrame, key: str, at: str, ttl: int) -> DataFrame:
    """Rows that were not shown within ttl seconds before them."""
    last = shown.groupBy(key).agg(F.max("shown_at").alias("_last"))
    fresh = F.col("_last").isNull() | (F.unix_timestamp(at) - F.unix_timestamp("_last") > ttl)
    return rows.join(last, key, "left").where(fresh).drop("_last")


def changes(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, change): what is new, and what has recovered."""
    came = now.join(before, key, "left_anti").withColumn("change", F.lit("new"))
    return came.unionByName(before.join(now, key, "left_anti").withColumn("change", F.lit("recovered")))
