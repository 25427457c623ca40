"""Case and white space of statements: each character as DuckDB has it."""

import duckdb
from pyspark.sql import functions as F

from cartulary.functions.text import normal_statement, simple_upper
from cartulary.plans.registry import ORACLES, QUERIES


def test_normal_form_of_every_character(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS cp, chr(i::INT) || 'a' || chr(i::INT) AS c FROM range(1, 1114112) t(i) WHERE i NOT BETWEEN 55296 AND 57343) TO '{tmp_path}/c.parquet'")
    c = spark.read.parquet(f"{tmp_path}/c.parquet")
    c.select("cp", normal_statement(F.col("c")).alias("own"), normal_statement(simple_upper(F.col("c"))).alias("raised")).write.parquet(f"{tmp_path}/got")
    form = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
    sql = f"SELECT g.cp FROM '{tmp_path}/got/*.parquet' g JOIN '{tmp_path}/c.parquet' c USING (cp) WHERE own IS DISTINCT FROM {form.format('c')} OR raised IS DISTINCT FROM {form.format('upper(c)')}"
    assert con.sql(sql).fetchall() == []


def test_candidates_of_odd_statements(spark, tmp_path):
    texts = ["Straße x", "STRASSE", "ΟΔΟΣ ", "οδος", "İx", "a\u000bb", " a", None, "", "ﬁn", "a\tB  c"]
    rows = [(k, t, "user", x) for k in range(6) for t, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("candidate_accumulation", "conversation_evidence"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.sql(ORACLES[name])
        assert sorted(map(repr, got.select(*want.columns).toPandas().where(lambda d: d.notna(), None).values.tolist())) == sorted(map(repr, want.df().where(lambda d: d.notna(), None).values.tolist()))
