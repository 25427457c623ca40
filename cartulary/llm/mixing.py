"""Mixing sources to target weights: Sainte-Lague apportionment of words.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.common import WORD, Workspace


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Adds weight and target to (source, source_size).

    Sources in code-point order, null last, take the weights in turn. Targets share the total of
    all sizes by weight; one that would exceed most * source_size stops there, and the excess is
    shared again until none exceeds. That ends where every target is least(most * size, level *
    weight) for one level; sources stop in the order of size / weight, so running sums give it:
    of the levels under which the next source stays below its limit, the highest.
    The windows run over sources, one row each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_full = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_full.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    found = ranked.withColumn("_level", level)
    found = found.withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= most * F.col("source_size"), F.col("_level"))).over(Window.partitionBy()))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(most * F.col("source_size"), F.coalesce(F.col("_level") * F.col("weight"), most * F.col("source_size"))))
    return found.withColumn("target", target.cast("double")).drop("_level")


def apportion(parts: DataFrame, group: list[str], votes: str, seats: str, order: list[Column], cap: str, out: str) -> DataFrame:
    """Sainte-Lague: gives each group's seats to the highest quotients votes / (2 k + 1), as column out.

    At a divisor d a part has round(votes / d) seats, which over n parts differs from the exact sum
    by n / 2 at most. So the seats that round gives at d = total / (seats - n / 2) are sure, and
    only those between them and d = total / (seats + n / 2), about two a part, are ranked. No part
    gets more than cap seats; what that leaves over goes to the next quotients.
    """
    w = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(w), F.sum(votes).over(w)
    half = n / 2 + 1
    sure = F.when((F.col(seats) > half) & (total > 0), F.floor(F.col(votes) * (F.col(seats) - half) / total + 0.5)).otherwise(0)
    some = F.when(total > 0, F.floor(F.col(votes) * (F.col(seats) + half) / total + 0.5) + 1).otherwise(0)
    p = parts.withColumn("_sure", F.least(F.greatest(sure, F.lit(0)), F.col(cap)).cast("long")).withColumn("_some", F.least(some, F.col(cap)).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(w))
    seat = p.select("*", F.explode_outer(F.when(F.col("_some") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_some") - 1))).alias("_k"))
    quotient = F.when(F.col("_k").isNotNull(), F.col(votes) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(w.orderBy(quotient.desc_nulls_last(), *order, F.col("_k")))
    won = seat.withColumn("_won", F.when(quotient.isNotNull() & (rank <= F.col("_left")), 1).otherwise(0))
    return won.groupBy(*parts.columns).agg((F.first("_sure") + F.sum("_won")).alias(out))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    most: float = 3.0,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    seed: int = 7,
) -> DataFrame:
    """One row for each input row: id, size, source_size, target, taken, source.

    size counts the words of the text (null: 0); target is the words that the row's source should
    give; taken the words that the mix takes of the row, repeats counted. The mix has as many words
    as the table. Each is a seat, which Sainte-Lague gives to sources by target, and in turn to a
    source's shards by size; all but about two a part are sure in closed form, so their number
    costs nothing. A source of n rows has about
    sqrt(n) shards of sqrt(n) rows, by a seeded hash of the id, so neither a shard's rows nor a
    source's shards are many, however large the source. In a shard the rows stand in seeded order
    as one ring of words; whole turns of the quota take every row, and the rest is one arc that
    starts at a seeded place. A source thus gives its target to within rounding, and a shard at
    most most * (its words).

    Null sources are one source, the last. Rows of no words take nothing. Null ids hash as the
    text 'null'; rows of one id stand together in the order of size, and equal rows are
    interchangeable. An empty table gives an empty table.
    """
    work = Workspace(docs.sparkSession, "mix")
    rows = work.stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    sources = source_targets(by_source, most, weights)
    sources = sources.withColumn("_total", F.round(F.sum("target").over(Window.partitionBy())).cast("long"))
    sources = sources.withColumn("_cap", F.floor(most * F.col("source_size")).cast("long")).withColumn("_all", F.lit(0))
    sources = apportion(sources, ["_all"], "target", "_total", [F.col("source").asc_nulls_last()], "_cap", "_seats")
    sources = work.stage(sources.withColumn("_shards", F.ceil(F.sqrt("_n")).cast("long")).select("source", "source_size", "target", "_seats", "_shards"), "quotas")

    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    number = F.conv(F.substring(key, 1, 12), 16, 10).cast("long")
    placed = rows.join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)
    placed = placed.withColumn("_key", key).withColumn("_shard", F.pmod(number, F.col("_shards")))
    shards = placed.groupBy("source", "_shard", "_seats").agg(F.sum("size").alias("_words"))
    shards = shards.withColumn("_cap", F.floor(most * F.col("_words")).cast("long")).withColumn("_votes", F.col("_words").cast("double"))
    shards = apportion(shards, ["source"], "_votes", "_seats", [F.col("_shard")], "_cap", "_quota")
    shards = shards.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_words", "_quota")

    ring = Window.partitionBy("source", "_shard").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_end", F.sum("size").over(ring))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))
    words, quota, end, size = F.col("_words"), F.col("_quota"), F.col("_end"), F.col("size")
    arc = quota % words
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null")), F.lit(":"), F.col("_shard").cast("string")))
    start = F.pmod(F.conv(F.substring(name, 1, 12), 16, 10).cast("long"), words)
    overlap = lambda lo, hi: F.greatest(F.lit(0).cast("long"), F.least(end, hi) - F.greatest(end - size, lo))
    once = F.floor(quota / words).cast("long") * size + overlap(start, start + arc) + overlap(start - words, start + arc - words)
    taken = F.when(words == 0, F.lit(0).cast("long")).otherwise(once)
    own = [F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken")]
    return placed.select(*own, *([] if id_col == source_col else [F.col("source").alias(source_col)]))


def _seats_sql(name: str, parts: str, keys: str, group: str, votes: str, order: str) -> str:
    """Common table expressions that give each group's seats to its parts: those that are sure, and by rank the rest; as {name}."""
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    return f"""{name}_sums AS (
  SELECT *, count(*) {over} / 2.0::DOUBLE + 1 AS half, sum({votes}::DOUBLE) {over} AS votes FROM {parts}
), {name}_sure AS (
  SELECT *, CASE WHEN seats > half AND votes > 0 THEN least(greatest(floor({votes} * (seats - half) / votes + 0.5::DOUBLE), 0), cap) ELSE 0 END::BIGINT AS sure,
         CASE WHEN votes > 0 THEN least(floor({votes} * (seats + half) / votes + 0.5::DOUBLE) + 1, cap) ELSE 0 END::BIGINT AS some FROM {name}_sums
), {name}_left AS (
  SELECT *, seats - (sum(sure) {over})::BIGINT AS rest FROM {name}_sure
), {name}_won AS (
  SELECT {keys}, count(*) AS won FROM (
    SELECT p.*, row_number() OVER ({f'PARTITION BY {group} ' if group else ''}ORDER BY {votes} / (2 * k.k + 1) DESC, {order}, k.k) AS r FROM {name}_left p, LATERAL (SELECT unnest(range(p.sure, p.some)) AS k) k
  ) WHERE r <= rest GROUP BY {keys}
), {name} AS (
  SELECT a.* EXCLUDE (seats), a.sure + coalesce(b.won, 0) AS seats FROM {name}_left a LEFT JOIN {name}_won b ON {same}
)"""


#: The same in DuckDB's SQL, over the table documents, with the defaults above.
MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), src0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source
), src1 AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (sum(source_size) OVER ())::BIGINT AS total FROM src0
), src2 AS (
  SELECT *, (total - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM src1
), src3 AS (
  SELECT *, max(CASE WHEN lv * weight <= 3.0::DOUBLE * source_size THEN lv END) OVER () AS level FROM src2
), src4 AS (
  SELECT source, source_size, n, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(3.0::DOUBLE * source_size, coalesce(level * weight, 3.0::DOUBLE * source_size)) END AS target FROM src3
), src5 AS (
  SELECT *, round(sum(target) OVER ())::BIGINT AS seats, floor(3.0::DOUBLE * source_size)::BIGINT AS cap FROM src4
), {_seats_sql("src_seats", "src5", "source", "", "target", "source NULLS LAST")}, src AS (
  SELECT source, source_size, target, seats, ceil(sqrt(n))::BIGINT AS shards FROM src_seats
), placed AS (
  SELECT d.doc_id, d.size, s.*, md5('7:' || coalesce(d.doc_id::VARCHAR, 'null')) AS key,
         ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT % s.shards AS shard
  FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source
), sh0 AS (
  SELECT source, shard, seats, sum(size)::BIGINT AS words, floor(3.0::DOUBLE * sum(size)::BIGINT)::BIGINT AS cap FROM placed GROUP BY source, shard, seats
), {_seats_sql("sh_seats", "sh0", "source, shard", "source", "words", "shard")}, sh AS (
  SELECT source, shard, words, seats AS quota,
         CASE WHEN words > 0 THEN ('0x' || substr(md5('7:' || coalesce(source, 'null') || ':' || shard::VARCHAR), 1, 12))::BIGINT % words END AS start
  FROM sh_seats
), ring AS (
  SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY key, size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM placed
)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CASE WHEN h.words = 0 THEN 0::BIGINT ELSE (h.quota // h.words) * r.size
         + greatest(0, least(r.stop, h.start + h.quota % h.words) - greatest(r.stop - r.size, h.start))
         + greatest(0, least(r.stop, h.start + h.quota % h.words - h.words) - greatest(r.stop - r.size, h.start - h.words)) END::BIGINT AS taken
FROM ring r JOIN sh h ON r.source IS NOT DISTINCT FROM h.source AND r.shard = h.shard
"""
