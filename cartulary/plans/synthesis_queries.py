"""What a provider says of whole groups (R26, X06, X07, D50, I14), with deterministic stand-ins for it."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import functions as F

from cartulary.operators import synthesis as S
from cartulary.plans.base import ORACLES, query
from cartulary.plans.vector_queries import conflict_pairs
from cartulary.sources.records import items, table


def sum_stub(prompts: list[str]) -> list:
    """The sum of the numbers that a prompt's lines begin with: the same whatever the tree, if each text is in it once."""
    return [f"n={sum(int(x) for x in re.findall(r'(?m)^n=([0-9]+)', p))}" for p in prompts]


@query("SELECT category, 'n=' || sum(len(searchable)) AS text, 0::BIGINT AS lost FROM items WHERE len(searchable) > 0 GROUP BY category", items=True)
def topic_guides(spark, sf_dir):
    """A guide of each category over all its cards, by a tree of calls: no card is left out, and no prompt is beyond the budget."""
    i = items(spark, sf_dir).where("searchable <> ''")
    line = F.concat(F.lit("n="), F.length("searchable").cast("string"), F.lit(" "), F.regexp_replace("searchable", r"\s+", " "))
    return S.synthesised(i.select("category", "doc_id", line.alias("line")), "category", ["doc_id"], "line", sum_stub).select("category", "text", "lost")


def topic_stub(prompts: list[str]) -> list:
    """JSON, fenced JSON or prose, by the number of cards; it names the first title's length and how many titles it was shown."""
    out = []
    for p in prompts:
        head, *lines = p.split("\n")
        n, titles = int(head.rsplit(" ", 1)[1]), [x[4:] for x in lines if x.startswith("  - ") and not x.startswith("  - slug-")]
        said = json.dumps({"topics": [f"t{len(titles)}", f"k{sum(x.startswith('  - slug-') for x in lines)}"], "reason": f"{n} cards", "confidence": "high" if n % 2 else "low"})
        out.append(said if n % 3 == 0 else f"```json\n{said}\n```" if n % 3 == 1 else f"no idea about {n}")
    return out


@query(
    r"SELECT category, n, CASE WHEN n % 3 < 2 THEN 't' || least(8, titled) || ',k' || (SELECT count(DISTINCT source) FROM documents) END AS topics, CASE WHEN n % 3 < 2 THEN n || ' cards' ELSE 'unreadable: no idea about ' || n END AS reason, CASE WHEN n % 3 < 2 AND n % 2 = 1 THEN 'high' ELSE 'low' END AS confidence FROM (SELECT category, count(*) AS n, count(*) FILTER (title <> '') AS titled FROM (SELECT lang || '-' || source AS category, regexp_replace(title, '\s+', ' ', 'g') AS title FROM (SELECT i.*, d.lang, d.source FROM items i JOIN documents d USING (doc_id))) WHERE category IS NOT NULL GROUP BY category)",
    items=True,
)
def topic_suggestions(spark, sf_dir):
    """Topics suggested for each language and source, from the number of cards, eight titles and the topics there are; an answer that cannot be read suggests nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("-"), "source").alias("category"), F.concat(F.lit("slug-"), "source").alias("slug"))
    i = items(spark, sf_dir).select("doc_id", F.regexp_replace("title", r"\s+", " ").alias("title")).join(d, "doc_id")
    s = S.suggested_topics(i, d.select("slug").where("slug is not null"), topic_stub, ["doc_id"])
    return s.select("category", "n", F.array_join("topics", ",").alias("topics"), "reason", "confidence")


def digest_stub(prompts: list[str]) -> list:
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


@query(
    "SELECT category, n, md5(n || chr(10) || digest) AS text FROM (SELECT category, max(n) AS n, string_agg('- ' || left(coalesce(title, ''), 80) || ' [' || array_to_string(list_slice(list_filter(tags, lambda x: x IS NOT NULL), 1, 5), ', ') || ']', chr(10) ORDER BY doc_id) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY category) AS n FROM items) WHERE k <= 20 AND category IS NOT NULL GROUP BY category)",
    items=True,
)
def knowledge_gaps(spark, sf_dir):
    """What is missing in each category, from a digest of its first twenty cards. (The limit is the report's.)"""
    return S.knowledge_gaps(items(spark, sf_dir), "category", digest_stub, ["doc_id"])


def bullet_stub(prompts: list[str]) -> list:
    """Ten bullets, the first with the number of notes and a line that continues it, after a thought."""
    return [f"<think>- x</think>So:\n- {sum(x.startswith('* ') for x in p.splitlines())} notes\n  in all\n" + "\n".join(f"- b{k}" for k in range(9)) for p in prompts]


@query(
    "SELECT lang, count(*) AS batches, 0::BIGINT AS lost, md5(string_agg('- ' || m || ' notes in all' || chr(10) || '- b0' || chr(10) || '- b1' || chr(10) || '- b2' || chr(10) || '- b3' || chr(10) || '- b4' || chr(10) || '- b5' || chr(10) || '- b6', chr(10) || chr(10) ORDER BY b)) AS text FROM (SELECT lang, b, count(*) AS m FROM (SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 40 AS b FROM documents WHERE lang IS NOT NULL) GROUP BY lang, b) GROUP BY lang"
)
def concluded_notes(spark, sf_dir):
    """The notes of each language in batches of forty, each concluded in eight bullets at most."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", F.concat(F.lit("* "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("note"))
    c = S.concluded(d, "lang", ["doc_id"], "note", bullet_stub)
    return c.select("lang", "batches", "lost", F.md5("text").alias("text"))


@query(
    """SELECT conv_id AS id, told IS NOT NULL AND situation <> 'direct' AS grounded, CASE WHEN told IS NOT NULL AND situation = 'enrichment' THEN coalesce(least(5, links), 0) ELSE 0 END::BIGINT AS links,
  md5(CASE WHEN told IS NOT NULL AND situation <> 'direct' THEN told || CASE WHEN situation = 'enrichment' AND links > 0 THEN chr(10) || chr(10) || 'Links:' || chr(10) || listed ELSE '' END || chr(10) || chr(10) || 'Question: ' || text ELSE text END) AS text
  FROM (SELECT conv_id, text, CASE conv_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'continuity' ELSE 'enrichment' END AS situation FROM conversations WHERE turn = 0) LEFT JOIN (
    SELECT id, string_agg('[' || title || ']' || chr(10) || left(searchable, CASE WHEN kind = 'wiki' THEN 1200 ELSE 400 END), chr(10) || chr(10) ORDER BY kind <> 'wiki', r) AS told, count(*) FILTER (link <> '') AS links, array_to_string((list(link ORDER BY r) FILTER (link <> ''))[1:5], chr(10)) AS listed
    FROM (SELECT *, CASE WHEN kind <> 'wiki' AND source_url <> '' AND title <> '' THEN '- [' || title || '](' || source_url || ')' ELSE '' END AS link, row_number() OVER (PARTITION BY id, kind ORDER BY doc_id) AS r FROM (SELECT doc_id // 7 AS id, CASE WHEN source_type = 'wiki' THEN 'wiki' ELSE 'card' END AS kind, doc_id, title, searchable, source_url FROM items)) WHERE r <= 10 GROUP BY id) ON id = conv_id""",
    items=True,
)
def composed_answers(spark, sf_dir):
    """An answer to each conversation's first message from the cards and topics that lie near it; direct questions are asked as they are."""
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    q = first.select(F.col("conv_id").alias("id"), F.col("text").alias("question"), F.expr("CASE conv_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'continuity' ELSE 'enrichment' END").alias("situation"))
    i = items(spark, sf_dir)
    hits = i.select(F.floor(F.col("doc_id") / 7).alias("id"), F.when(F.col("source_type") == "wiki", "wiki").otherwise("card").alias("kind"), F.col("doc_id").alias("rank"), "title", F.col("searchable").alias("text"), F.col("source_url").alias("url"))
    return S.composed_answers(q, hits, digest_stub)


def verdict_stub(prompts: list[str]) -> list:
    return [None if len(p) % 5 == 4 else f"RELATION: {('CONFLICT', 'DUPLICATE')[len(p) % 2]}\nREASON: of {len(p)}\nNOTABLE: " + ("much" if len(p) % 3 else "") for p in prompts]


#: The pairs of conflict_pairs, with what the stand-in says of their cards.
_JUDGED = f"""pairs AS ({ORACLES["conflict_pairs"]}), cards AS (SELECT doc_id, category, title, coalesce(title, '') || chr(10) || coalesce(summary, '') AS told FROM items),
judged AS (SELECT a, b, similarity, ca, cb, CASE WHEN n % 2 = 0 THEN 'CONFLICT' ELSE 'DUPLICATE' END AS relation, 'of ' || n AS reason, CASE WHEN n % 3 > 0 THEN 'much' ELSE '' END AS notable FROM (
  SELECT a, b, similarity, x.category AS ca, y.category AS cb, len(x.told) + 2 + len(y.told) AS n FROM pairs JOIN cards x ON x.doc_id = a JOIN cards y ON y.doc_id = b) WHERE n % 5 <> 4)"""


def _judged(spark, sf_dir):
    cards = items(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", "summary")
    return S.judged_pairs(conflict_pairs(spark, sf_dir), cards, verdict_stub)


@query(f"{_JUDGED} SELECT a, b, similarity, relation, reason, notable FROM judged", items="more")
def judged_pairs(spark, sf_dir):
    """What a model says of the most alike pairs; a pair whose call fails is left out."""
    return _judged(spark, sf_dir)


@query(
    rf"""{_JUDGED}, doubles AS (SELECT category, t FROM (SELECT category, trim(regexp_replace(lower(trim(title)), '[^\p{{L}}\p{{N}}_\s]', '', 'g')) AS t FROM items) WHERE t <> '' AND category IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
  digests AS (SELECT category, max(n) AS n, string_agg('- ' || left(coalesce(title, ''), 80) || ' [' || array_to_string(list_slice(list_filter(tags, lambda x: x IS NOT NULL), 1, 5), ', ') || ']', chr(10) ORDER BY doc_id) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY category) AS n FROM items) WHERE k <= 20 AND category IS NOT NULL GROUP BY category)
  SELECT category, n AS cards, (SELECT count(*) FROM judged WHERE ca = category AND cb = category) AS judged, (SELECT count(*) FROM judged WHERE ca = category AND cb = category AND relation = 'CONFLICT') AS conflicts,
    (SELECT count(*) FROM doubles d WHERE d.category = g.category) AS duplicates, coalesce((SELECT array_to_string(list(t ORDER BY t)[1:5], '; ') FROM doubles d WHERE d.category = g.category), '') AS examples, md5(n || chr(10) || digest) AS gaps FROM digests g""",
    items="more",
)
def health_report(spark, sf_dir):
    """Of each category its conflicts among the judged pairs, its titles that come twice, and what is missing."""
    cards = items(spark, sf_dir).select(F.col("doc_id").alias("id"), "category", "title")
    return S.health_report(cards, _judged(spark, sf_dir), S.knowledge_gaps(items(spark, sf_dir), "category", digest_stub, ["doc_id"]))
