"""Streaming twins of the state operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cartulary.operators.state import TERMINAL


def event_stream(spark, folder: str, glob: str = "events*.parquet", files: int = 1) -> DataFrame:
    """The events in a folder's files as a stream; ts as a timestamp with time zone, which watermarks need."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def usage(events: DataFrame) -> DataFrame:
    """Running totals of each record, for update mode."""
    return events.groupBy(F.col("user_id").alias("record_id")).agg(F.count(F.lit(1)).alias("considered"), F.count_if(F.col("event_type") == "purchase").alias("injected"), F.max("value").alias("similarity"))


def once(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each key once while its state lasts: state is bounded by the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts by type and window; late rows beyond the delay are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def jobs(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The job machine over (job_id, seq, status): the first terminal state is final, later events are refused and counted.

    Within a batch events are taken by seq; one that comes in a later batch than a newer one of its
    job is refused too, as what was applied is not undone. With keep_ms a job's state goes that long
    after its last event; that needs a stream that runs on, as one that ends when it has read all
    there is would wait for the timeouts for ever.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, applied, refused, last = state.get if state.exists else ("", 0, 0, -(1 << 62))
        new = pd.concat(list(frames)).sort_values("seq", kind="stable")
        newest = last
        for seq, told in zip(new["seq"].tolist(), new["status"].tolist()):
            if status in TERMINAL or seq < last:
                refused += 1
            else:
                status, applied = told, applied + 1
            newest = max(newest, seq)
        state.update((status, applied, refused, newest))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "applied": [applied], "refused": [refused]})

    kinds = "status string, applied long, refused long"
    return events.groupBy("job_id").applyInPandasWithState(step, f"job_id long, {kinds}", f"{kinds}, last long", "update", GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
