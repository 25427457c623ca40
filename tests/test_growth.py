"""What grows with a collection: tasks, folders and reads of its pages, and the rows of a group in one task."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cartulary.operators import synthesis
from cartulary.plans import paged_queries
from cartulary.sources import paged


def test_many_pages_are_few_partitions():
    parts = paged._Pages(lambda r: {"total": 100_050}, {}, 10, 1, 0.0).partitions()
    assert len(parts) <= paged.PARTITIONS
    assert [k for p in parts for k in p.value] == list(range(10_005))


def test_pages_of_a_feed_are_read_together(tmp_path, monkeypatch):
    at = tmp_path / "feed=a" / "shelf=0"
    at.mkdir(parents=True)
    pq.write_table(pa.table({"page": [0, 0, 1, 2], "post": [1, 2, 3, 4], "more": [True, True, True, False]}), at / "x.parquet")
    reads = []
    monkeypatch.setattr(paged_queries.pq, "read_table", lambda *a, f=pq.read_table, **k: reads.append(a) or f(*a, **k))
    served = paged_queries.Timelines(f"file://{tmp_path}", False)
    found = [paged.timeline_page(served({"feed": "a", "cursor": str(k)})) for k in range(4)]
    assert found == [(["1", "2"], "1"), (["3"], "2"), (["4"], None), ([], None)]
    assert len(reads) == 1


def test_no_task_has_the_texts_of_a_group(spark, tmp_path):
    rows = spark.range(400).select(F.lit("g").alias("g"), "id", F.repeat(F.lit("x"), 90).alias("line"))
    packs = synthesis.packed(rows, "g", ["id"], "line", f"file://{tmp_path}", 1000)
    assert [r.prompt for r in packs.orderBy("prompt").collect()] == list(range(packs.count()))
    below = packs._jdf.queryExecution().executedPlan().toString().split("Window [")[1]
    assert "text" not in re.search(r"ReadSchema: struct<([^>]*)>", below)[1]
