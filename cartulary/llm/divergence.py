"""Source divergence audit: one sorted scan counts terms by language and source, a second sums how far the sources of a term lie apart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.common import pieces, stretches, tidy, whole_runs, Workspace
from cartulary.llm.files import part_number

#: Documents of a language that a term must be in, terms listed for a group, and the parts that shares are counted in.
LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Entries that a task gathers before it sends them, and pairs of sources that it looks at together.
_ENTRIES, _AT_ONCE = 400_000, 1 << 20
_FOLD = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or 97 <= c < 123 else 32 for c in range(256))


def _changes(table: pa.Table, column: str) -> np.ndarray:
    """Where a column differs from the row before; the first row does."""
    new = np.ones(len(table), bool)
    values = table.column(column)
    new[1:] = pc.not_equal(values.slice(1), values.slice(0, len(table) - 1)).to_numpy(zero_copy_only=False)
    return new


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, part, documents, n): each row stands for a stretch of documents. The empty term counts a group's documents, so that groups without terms are seen."""
    part, held, entries = part_number() << 33, {}, 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in held.items():
            terms = list(documents)
            size = len(terms)
            columns = [pa.repeat(pa.scalar(lang.decode()), size), pa.array(terms, pa.binary()).cast(pa.string()), pa.repeat(pa.scalar(source.decode()), size), pa.repeat(pa.scalar(part), size)]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array(list(documents.values()), pa.int64()), pa.array([n[t] for t in terms], pa.int64())], ["lang", "term", "source", "part", "documents", "n"])
            yield from (batch.slice(k, 1 << 16) for k in range(0, size, 1 << 16))

    for batch in batches:
        for text, lang, source in zip(*batch.columns):
            n, documents = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(documents), {b""}
            for piece in pieces(text.as_py().translate(_FOLD)):
                own = piece.split()
                n.update(own)
                seen.update(own)
            documents.update(seen)
            entries += len(documents) - before
            if entries > _ENTRIES:
                yield from sent()
                part, held, entries = part + 1, {}, 0
    yield from sent()


def _scan(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Run lengths over rows sorted by (lang, term, source, part): (t, lang, term, source, n, total, sources, head) of kept terms, t the term's number, head 1 in its first row."""
        held, number = None, part_number() << 33

        def cut(table: pa.Table, last: bool) -> tuple[pa.Table | None, pa.RecordBatch | None]:
            nonlocal number
            term = _changes(table, "lang") | _changes(table, "term")
            starts = np.flatnonzero(term | _changes(table, "source"))
            summed = [np.add.reduceat(table.column(c).to_numpy(), starts) for c in ("documents", "n")]
            table = pa.table([*(table.column(c).take(pa.array(starts)) for c in ("lang", "term", "source")), *map(pa.array, summed)], ["lang", "term", "source", "documents", "n"])
            heads = np.flatnonzero(term[starts])
            end = len(table) if last else int(heads[-1])
            heads = heads[heads < end]
            if not len(heads):
                return table, None
            documents, n = (x[:end] for x in summed)
            size = np.diff(np.append(heads, end))
            of = np.repeat(np.arange(len(heads)), size)
            kept = (np.add.reduceat(documents, heads) >= least)[of] | pc.equal(table.column("term").slice(0, end), "").to_numpy(zero_copy_only=False)
            columns = {"t": number + of, **{c: table.column(c).slice(0, end).combine_chunks() for c in ("lang", "term", "source")}, "n": n, "total": np.add.reduceat(n, heads)[of], "sources": size[of], "head": np.isin(np.arange(end), heads).astype(np.int64)}
            number += len(heads)
            return table.slice(end), pa.RecordBatch.from_pydict({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()}).filter(pa.array(kept))

        for batch in batches:
            if batch.num_rows:
                names = ["lang", "term", "source", "documents", "n"]
                table = pa.table([batch.column(batch.schema.get_field_index(c)) for c in names], names)
                held, out = cut(table if held is None else pa.concat_tables([held, table]).combine_chunks(), False)
                if out is not None:
                    yield out
        if held is not None and len(held):
            yield cut(held, True)[1]

    return run


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, value) over rows sorted by t: what a term that both sources have adds, beyond what each having it alone would."""
    for columns, starts in whole_runs(batches, ["t"]):
        size = np.diff(starts)
        lo, many = np.repeat(starts[:-1], size), np.repeat(size, size)
        groups, g = np.unique(columns["g"], return_inverse=True)
        p, z, ends, at = columns["p"], columns["z"], np.cumsum(many), 0
        while at < len(many):
            stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")), at + 1)
            a, b = np.repeat(np.arange(at, stop), many[at:stop]), stretches(lo[at:stop], many[at:stop])
            other = g[a] != g[b]
            a, b = a[other], b[other]
            code, inverse = np.unique(g[a] * len(groups) + g[b], return_inverse=True)
            value = np.zeros(len(code), np.int64)
            np.add.at(value, inverse, _far(p[a], p[b]) - _far(p[a], z[b]) - _far(z[a], p[b]) + _far(z[a], z[b]))
            if len(code):
                yield pa.RecordBatch.from_arrays([pa.array(groups[code // len(groups)]), pa.array(groups[code % len(groups)]), pa.array(value)], ["a", "b", "value"])
            at = stop


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * count / total), by long division in three steps, so that no product leaves 64 bits before 9 * 10^15 words."""
    first = count * 1000
    second = first % total * 1000
    third = second % total * 1000
    whole = lambda x: F.call_function("div", x, total)
    return whole(first) * 1_000_000 + whole(second) * 1000 + whole(third) + 1


def _apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language lie apart (part pair) and the terms that tell a source from its language (part term).

    Terms are runs of letters A-Z and of characters beyond ASCII, with A-Z lower-cased. A language
    keeps the terms that are in `least` of its rows or more; shares p are counted in billionths over
    these, with one added to each count, and a divergence is (p - q)^2 / q in whole numbers. All
    other sources of a language are ranked by it, and the `top` terms of each group.

    Tasks count terms in stretches of documents, so a common term is a row for each task and source
    and not for each document; the rows are dealt by (lang, term), sorted further by source and
    stretch, and scanned once: run lengths give each term's document frequency and its counts.
    With the totals known, a second scan in the terms' order sums, for each pair of sources that
    share a term, what that adds; what a term adds that only one of two sources has, or neither,
    depends on a share and a group alone and is summed over the shares that occur in a group. So no
    work grows with terms times pairs of sources. Only sums leave a task.

    Null texts, languages and sources read as empty; the empty language and the empty source are
    like any other. Every row counts as a document, so a repeated row counts again. A group without
    kept terms has pairs, and no terms; a language without kept terms has pairs of value 0. Ties
    stand in the UTF-8 order of the item. Ids and other columns are not read. An empty table gives
    an empty table.
    """
    work = Workspace(docs.sparkSession, "divergence")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(n) for n, c in (("text", text_col), ("lang", lang_col), ("source", source_col))])
    found = rows.mapInArrow(tidy(_documents), "lang string, term string, source string, part long, documents long, n long")
    found = found.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "part")
    counts = work.stage(found.mapInArrow(tidy(_scan(least)), "t long, lang string, term string, source string, n long, total long, sources long, head long"), "counts")
    kept = counts.where("term <> ''")

    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("all_words"), F.sum("head").alias("terms"))
    groups = counts.where("term = ''").select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    groups = groups.select("lang", "source", zero("words").alias("words"), zero("all_words").alias("all_words"), zero("terms").alias("terms"), F.monotonically_increasing_id().alias("g"))
    groups = groups.withColumn("z", F.when(F.col("terms") > 0, _share(F.lit(1).cast("long"), F.col("words") + F.col("terms"))))
    groups = work.stage(groups, "groups")

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n") + 1, F.col("words") + F.col("terms"))).withColumn("q", _share(F.col("total") + 1, F.col("all_words") + F.col("terms")))
    shares = work.stage(shares.select("t", "lang", "term", "source", "sources", "g", "p", "z", "q"), "shares")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    told = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    both = shares.where("sources > 1").select("t", "g", "p", "z").repartition("t").sortWithinPartitions("t").mapInArrow(tidy(_pairs), "a long, b long, value long")
    alike = work.stage(shares.groupBy("lang", "g", "p", "z").agg(F.count(F.lit(1)).alias("k")), "alike")
    beside = groups.select("lang", F.col("g").alias("o"), F.col("z").alias("zo"))
    alone = alike.join(beside, "lang").where("g <> o")
    from_a = alone.select(F.col("g").alias("a"), F.col("o").alias("b"), (F.col("k") * (_apart("p", "zo") - _apart("z", "zo"))).alias("value"))
    from_b = alone.select(F.col("o").alias("a"), F.col("g").alias("b"), (F.col("k") * (_apart("zo", "p") - _apart("zo", "z"))).alias("value"))
    sums = both.unionByName(from_a).unionByName(from_b).groupBy("a", "b").agg(F.sum("value").alias("value"))
    own = groups.select("lang", "source", "terms", "z", F.col("g").alias("a"))
    pairs = own.join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("z").alias("zo")), "lang").where("a <> b")
    base = F.coalesce(F.col("terms") * _apart("z", "zo"), F.lit(0))
    pairs = pairs.join(sums, ["a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("value", F.lit(0))).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(told).select(F.col("lang").alias(lang_col), F.col("source").alias(source_col), "part", "item", "value", "rank")


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The same in DuckDB's SQL, over the table documents, with the defaults above.
AUDIT_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), {_LETTERS}) AS term FROM docs),
counted AS (SELECT lang, source, term, sum(n) AS n, count(*) AS df FROM (SELECT r, lang, source, term, count(*) AS n FROM words GROUP BY ALL) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL HAVING sum(df) >= {LEAST}),
langs AS (SELECT lang, count(*) AS terms, sum(n) AS words FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS words FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT c.* FROM counted c JOIN kept USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS (SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.words + l.terms))::HUGEINT AS p, (1 + {SCALE}::HUGEINT * (k.n + 1) // (l.words + l.terms))::HUGEINT AS q
  FROM kept k JOIN groups g USING (lang) JOIN langs l USING (lang) LEFT JOIN counted c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
