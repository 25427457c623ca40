"""Sources that are written and read back: damaged files are refused, and only what is asked for is read."""

import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartulary.operators.topics import topic_page
from cartulary.sources import dated, packed


@pytest.mark.parametrize("itemsize,order", [(4, "<"), (8, ">")])
def test_packed_vectors_come_back(spark, tmp_path, itemsize, order):
    rows = [(f"k{i}", [i + 0.5, float(-i), i / 4]) for i in range(50)] + [("none", None)]
    folder = f"file://{tmp_path}/v"
    packed.write_packed(spark.createDataFrame(rows, "key string, vector array<double>").repartition(3), folder, "key", "vector", dims=3, itemsize=itemsize, order=order)
    got = {r.key: list(r.vector) for r in packed.read_packed(spark, folder, dims=3, itemsize=itemsize, order=order).collect()}
    assert got == {k: v for k, v in rows if v is not None}
    asked = spark.createDataFrame([("k7",), ("k7",), ("nobody",), ("k49",)], "id string")
    found = packed.lookup_packed(asked, folder, "id", dims=3, itemsize=itemsize, order=order).collect()
    assert {r.key: list(r.vector) for r in found} == {k: got[k] for k in ("k7", "k49")} and len(found) == 2
    for wrong in ({"dims": 4, "itemsize": itemsize, "order": order}, {"dims": 3, "itemsize": 12 - itemsize, "order": order}, {"dims": 3, "itemsize": itemsize, "order": "<>".replace(order, "")}):
        with pytest.raises(Exception, match="damaged or of another kind"):
            packed.read_packed(spark, folder, **wrong).collect()


def test_a_file_of_the_wrong_size_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    packed.write_packed(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "key long, vector array<double>").coalesce(1), folder, "key", "vector", dims=2)
    file = next(Path(tmp_path, "v", "data").glob("*.bin"))
    whole = file.read_bytes()
    for broken in (whole[:-4], whole + b"\0" * 4, b"", b"XXXX" + whole[4:]):
        file.write_bytes(broken)
        with pytest.raises(Exception, match="damaged or of another kind"):
            packed.read_packed(spark, folder, dims=2).collect()
    assert struct.unpack_from(packed._HEADER, whole)[3:] == (2, 2)
    with pytest.raises(Exception, match="3 expected"):
        packed.write_packed(spark.createDataFrame([(1, [1.0, 2.0])], "key long, vector array<double>"), f"{folder}2", "key", "vector", dims=3)


def test_days_before_are_not_read(spark, tmp_path):
    lines = spark.createDataFrame([("2024-01-01", 1, "old"), ("2024-01-09", 2, "b\tc"), ("2024-01-09", 1, ""), ("2024-01-10", 5, None)], "day string, line_no long, line string").withColumn("day", F.col("day").cast("date"))
    dated.write_days(lines, f"{tmp_path}/a")
    rows = dated.daily_lines(spark, [f"{tmp_path}/a", f"{tmp_path}/a/"], F.lit("2024-01-09").cast("date"))
    assert sorted((str(r.day), r.line_no, r.line) for r in rows.collect()) == [("2024-01-09", 1, ""), ("2024-01-09", 2, "b\tc"), ("2024-01-10", 5, "")]
    assert "PartitionFilters: [isnotnull(day" in rows._jdf.queryExecution().executedPlan().toString()


def test_topic_page_without_sections(spark):
    page = "---\na: 1\n---\n# Head\n\n**bold** para\n\n## One\n**Item one**\nbody\n**abc**\nshort\n## Two\nplain `code`\n"
    row = spark.createDataFrame([(page, "n"), ("", "n"), ("just text", "n")], "p string, n string").select(topic_page(F.col("p"), F.col("n")).alias("t")).select("t.*").collect()
    assert (row[0].title, row[0].description, [s.heading for s in row[0].sections]) == ("Head", "bold para", ["One", "Two"])
    assert row[0].sections[0]["items"] == ["**Item one**\nbody"] and row[0].sections[1].plain == "plain code"
    assert (row[1].title, row[1].description, row[1].sections) == ("n", "", []) and row[2].description == "just text"
