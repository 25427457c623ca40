"""Keyed state in event time: job events that come in any order, and alerts that are told once over runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cartulary.operators.state import TERMINAL
from cartulary.sources import store

#: Where the state of these streams is kept: the store that event-time timers and state that ends need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Batches without data: timers in event time need one after the last; in processing time they would never end.
EMPTY = "spark.sql.streaming.noDataMicroBatches.enabled"


#: Keys of the state that jobs are dealt in: a call to the store serves all jobs of a bucket that a batch brings.
BUCKETS = 1024


def _packed(frame: pd.DataFrame) -> tuple[bytes]:
    table, out = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return (out.getvalue().to_pybytes(),)


def _unpacked(value: tuple) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(value[0])).read_pandas()


class OrderedJobs(StatefulProcessor):
    """The job machine over events that wait until the watermark has passed them, and are then applied in the order of (at, seq): the first terminal state is final.

    A key holds a bucket of jobs, whose events wait in packed frames; bucket -1 holds the job without an id.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.jobs = handle.getValueState("jobs", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if frames:
            came = pd.concat(frames)[["job_id", "at", "seq", "status"]]
            came["job_id"] = came["job_id"].fillna(0).astype("int64")
            self.waiting.appendList([_packed(came)])
            self.handle.registerTimer(int(came["at"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [_unpacked(x) for x in self.waiting.get()]
        held = pd.concat(held) if held else pd.DataFrame({"at": []})
        passed = held["at"] <= timerValues.getCurrentWatermarkInMs()
        if not passed.any():
            return  # another timer of the bucket has been here: what waits has a timer of its own
        due, rest = held[passed].sort_values(["job_id", "at", "seq", "status"]), held[~passed]
        jobs = _unpacked(self.jobs.get()).set_index("job_id") if self.jobs.exists() else pd.DataFrame({"status": pd.Series(dtype=object), "applied": pd.Series(dtype="int64"), "refused": pd.Series(dtype="int64")})
        ends = due["status"].isin(TERMINAL)
        late = ((ends.groupby(due["job_id"]).cumsum() - ends) > 0) | due["job_id"].isin(jobs.index[jobs["status"].isin(TERMINAL)])
        changed = pd.DataFrame({"applied": (~late).groupby(due["job_id"]).sum(), "refused": late.groupby(due["job_id"]).sum()})
        before = jobs.reindex(changed.index)
        for c in ("applied", "refused"):
            changed[c] = changed[c].astype("int64") + before[c].fillna(0).astype("int64")
        # the last one applied, which may be null; else what the job had
        told = due[~late].drop_duplicates("job_id", keep="last").set_index("job_id")["status"]
        changed.insert(0, "status", told.reindex(changed.index).where(changed.index.isin(told.index), before["status"]).astype(object))
        kept = jobs[~jobs.index.isin(changed.index)]
        self.jobs.update(_packed(pd.concat([kept, changed] if len(kept) else [changed]).rename_axis("job_id").reset_index()))
        self.waiting.clear()
        if len(rest):
            self.waiting.put([_packed(rest)])
            self.handle.registerTimer(int(rest["at"].min()))
        out = changed.rename_axis("job_id").reset_index()
        yield out if key[0] >= 0 else out.assign(job_id=None)

    def close(self) -> None:
        pass


def ordered_jobs(events: DataFrame, delay: str, buckets: int | None = None) -> DataFrame:
    """(job_id, status, applied, refused) whenever a job changes, of events (job_id, ts, seq, status) that come `delay` late at most; what comes later is not taken. For update mode."""
    bucket = F.when(F.col("job_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(buckets or BUCKETS)).cast("int"))
    rows = events.withWatermark("ts", delay).select(bucket.alias("bucket"), "job_id", "ts", F.unix_millis("ts").alias("at"), "seq", "status")
    return rows.groupBy("bucket").transformWithStateInPandas(OrderedJobs(), "job_id long, status string, applied long, refused long", "Update", "EventTime")


class ToldAlerts(StatefulProcessor):
    """Alerts of a scope: those of the last run, which a new run is compared with. An alert that no run has named for the time to live is forgotten."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "alert string", "run long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(list(rows))
        known = {k[0]: v[0] for k, v in self.known.iterator()}
        out = []
        for run, frame in told.sort_values("run").groupby("run"):
            now = set(frame["alert"].dropna())
            out += [(key[0], int(run), a, "new") for a in sorted(now - set(known))] + [(key[0], int(run), a, "recovered") for a in sorted(set(known) - now)]
            for gone in set(known) - now:
                self.known.removeKey((gone,))
            for a in now:
                self.known.updateValue((a,), (int(run),))
            known = dict.fromkeys(now, int(run))
        yield pd.DataFrame(out, columns=["scope", "run", "alert", "change"])

    def close(self) -> None:
        pass


def told_alerts(runs: DataFrame, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """(scope, run, alert, change): what is new and what has recovered, each told once, of runs (scope, run, alert). A run names its scope with a null alert where it has none. For append mode; what was told lives in the checkpoint, so a later start goes on from it."""
    return runs.groupBy("scope").transformWithStateInPandas(ToldAlerts(keep_ms), "scope long, run long, alert string, change string", "Append", "ProcessingTime")


def fed(spark: SparkSession, parts: list[DataFrame], make, mode: str) -> DataFrame:
    """What a stream gives that is started once for each part, over one checkpoint: a part is added to its folder, read to the end, and the stream ends."""
    folder = store.new_folder(spark, "stream")
    wanted = {PROVIDER[0]: PROVIDER[1], EMPTY: str(mode == "update").lower()}
    held = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{folder}/in")
            rows = make(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))

            def save(batch: DataFrame, number: int) -> None:
                batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

            rows.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _batch long").parquet(f"{folder}/out/*")
