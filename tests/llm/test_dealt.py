"""How rows are dealt: nothing that a small table explodes into goes to the driver."""

from pyspark.sql import functions as F

from cartulary.llm.common import tiled
from cartulary.llm.simhash import links


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("fid"), F.xxhash64("id").alias("w0")).write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")
    for made in (links(prints, 1, 4, 7, 3), tiled(prints.select("fid", F.explode(F.array(F.lit(1), F.lit(2))).alias("key")), ["key"], ["fid"])):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
