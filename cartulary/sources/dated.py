"""Files of days: memory texts and trace snapshots, read for the last days only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_days(lines: DataFrame, folder: str) -> None:
    """Lines (day, line_no, line; without line breaks) as text files in a folder for each day."""
    lines.select("day", F.concat_ws("\t", F.col("line_no").cast("string"), "line").alias("value")).repartition("day").sortWithinPartitions("day", "value").write.partitionBy("day").text(folder)


def daily_lines(spark: SparkSession, roots: list[str], since: Column) -> DataFrame:
    """(day, line_no, line) of the days since then, of several roots; a root named twice is read once. Folders of earlier days are not read."""
    real = sorted({r.rstrip("/") for r in roots})
    rows = reduce(DataFrame.unionByName, [spark.read.schema("value string, day date").text(r) for r in real])
    parts = F.split("value", "\t", 2)
    return rows.where(F.col("day") >= since).select("day", F.get(parts, 0).cast("long").alias("line_no"), F.coalesce(F.get(parts, 1), F.lit("")).alias("line"))


def newest_snapshots(spark: SparkSession, folder: str, kind: str, since: Column) -> DataFrame:
    """(episode, at, messages) of the traces of a folder of JSON, a trace a line: of that kind, not older than since, and of each episode the newest. A line that is no trace is left out."""
    rows = spark.read.schema("schema string, episode string, at string, messages array<struct<role:string,text:string>>, _broken string").option("columnNameOfCorruptRecord", "_broken").json(folder)
    rows = rows.where(F.col("_broken").isNull() & (F.col("schema") == kind) & F.col("episode").isNotNull()).withColumn("at", F.try_to_timestamp("at")).where(F.col("at") >= since)
    return rows.groupBy("episode").agg(F.max_by(F.struct("at", "messages"), F.struct("at", F.size("messages").alias("n"))).alias("t")).select("episode", "t.at", "t.messages")
