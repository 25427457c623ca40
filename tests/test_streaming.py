"""Streaming twins give what the batch forms give."""

from pyspark.sql import functions as F

from cartulary.operators.state import job_states
from cartulary.streaming import machines as M
from cartulary.streaming import state as T

SF = "/root/testdata/sf0.001"


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_usage(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = run(spark, T.usage(T.event_stream(spark, SF)), "usage", "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.usage(events).collect()))


def test_jobs(spark, tmp_path):
    status = F.when(F.col("event_type") == "purchase", "succeeded").otherwise("running")
    shape = lambda e: e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"))
    got = run(spark, T.jobs(shape(T.event_stream(spark, SF))), "jobs", "update", tmp_path)
    want = job_states(shape(spark.read.parquet(f"{SF}/events.parquet")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_once_and_windowed(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = T.event_stream(spark, SF).select("ts", "event_type", "user_id")
    got = run(spark, T.once(rows, ["user_id", "event_type"], "400 days"), "once", "append", tmp_path)
    assert got.count() == events.select("user_id", "event_type").distinct().count()
    counted = run(spark, T.windowed(rows, "1 day", "1 hour").select("window.start", "event_type", "n"), "windowed", "complete", tmp_path)
    want = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.select("start", "event_type", "n").collect()))


def test_jobs_out_of_order(spark, tmp_path):
    folder = tmp_path / "in"
    for k, rows in enumerate([[(1, 5, "running"), (2, 1, "running")], [(1, 3, "failed"), (2, 2, "succeeded")], [(2, 3, "running"), (1, 6, "succeeded")]]):
        spark.createDataFrame(rows, "job_id long, seq long, status string").coalesce(1).write.parquet(str(folder / f"p{k}"))
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(3):
        shutil.copy(next((folder / f"p{k}").glob("*.parquet")), flat / f"events{k}.parquet")
    stream = spark.readStream.schema("job_id long, seq long, status string").option("maxFilesPerTrigger", 1).parquet(str(flat))
    run(spark, T.jobs(stream), "jobs2", "update", tmp_path)
    last = {}
    for r in spark.table("jobs2").collect():
        if r["applied"] + r["refused"] >= sum(last.get(r["job_id"], (0, 0, 0))[1:]):
            last[r["job_id"]] = (r["status"], r["applied"], r["refused"])
    assert last == {1: ("succeeded", 2, 1), 2: ("succeeded", 2, 1)}


def test_jobs_of_a_bucket_share_a_key(spark):
    """Jobs come and end as each alone would, some over several runs, and the state has a key for each bucket and none for each job."""
    keys, at = 3, lambda d: f"2024-01-{d:02d} 00:00:00"
    schema = "job_id long, ts string, seq long, status string"
    days = [
        [(j, at(5), 2, "succeeded" if j % 2 else "running") for j in range(40)] + [(j, at(2), 1, "running") for j in range(40)] + [(50, at(3), 1, "failed"), (None, at(3), 9, "running")],
        [(j, at(4), 3, "failed") for j in range(0, 40, 4)] + [(j, at(20), 4, "running") for j in range(40)] + [(50, at(21), 2, "running"), (None, at(20), 8, "failed")],
        [(-1, at(31), 0, "running")],
    ]
    parts = [spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")) for rows in days]
    got, seen = {}, []
    made = M.ordered_jobs
    for r in M.fed(spark, parts, lambda s: seen.append(made(s, "10 days", keys)) or seen[-1], "update").orderBy(F.col("applied") + F.col("refused")).collect():
        got[r.job_id] = (r.status, r.applied, r.refused)
    want = {j: ("succeeded", 2, 1) if j % 2 else ("failed", 2, 2) if j % 4 == 0 else ("running", 3, 0) for j in range(40)} | {50: ("failed", 1, 1), None: ("failed", 2, 0)}
    assert {k: v for k, v in got.items() if k != -1} == want
    assert "[bucket" in seen[0]._jdf.queryExecution().logical().toString()
