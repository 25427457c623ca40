"""Recall: semantic, section, continuity, contrarian and action retrieval, question scores, catalog search and the ladder of backends."""

from __future__ import annotations

from collections.abc import Callable

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.config import DEFAULT, Settings
from cartulary.functions import text as T
from cartulary.functions.predicates import allowed, hidden_result
from cartulary.functions.vectors import cosine
from cartulary.operators.overlap import held_in, top_overlaps
from cartulary.operators.ranking import adjustments, top
from cartulary.sources import store
from cartulary.sources.records import sections as sections_of

# fixed values: what contradicts or warns
CONTRARIAN = (
    "不[要建議適合]", "避免", "問題[是在]", "失敗", "踩坑", "缺陷", "限制", "注意[：:]?", "⚠️", "警告", "但[是]?.*不", "然而", "反例", "反而", "缺口", "弱點", "做不到", "沒有解決", "無法", "不夠",
    "avoid", "warning", "caveat", "limitation", "failed", "problem", "however", r"but\s+not", "don.?t", "issue", "drawback", "risk",
)
# fixed values: what can be acted on
ACTION = ("TODO", "下一步", "下一個", "接下來", r"Phase\s*[0-9]", r"v[0-9]\s*[:：]", "roadmap", "計畫", "可以直接", "已有", "現有", "可復用", "可接", "建議先", "優先", "待辦")
# fixed values: what asks for what was said before
CONTINUITY = r"(我們(之前|上次|說好|討論過|提到)|你(還)?記得|上次(說|講|討論)|之前(說|講|提到|決定)|我們(的系統|做的|設計的|定的))"


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _count(tokens: list[str], text: Column) -> Column:
    """How many of the tokens the text, in lower case, contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in tokens], F.lit(0))


def profile_matches(tokens: list[str], categories: dict[str, float], tags: dict[str, float]) -> tuple[list[str], list[str], float]:
    """(categories, tags, boost) of a topic profile that a query's tokens touch: three and five names, and the largest weight."""
    near = lambda name: any(t in name or name in t for t in tokens)
    cats, labels = [n for n in categories if n and near(n)], [n for n in tags if n and near(n)]
    boost = max([categories[n] for n in cats] + [tags[n] for n in labels], default=0.0)
    return cats[:3], labels[:5], round(boost, 4)


def topic_bonus(category: Column, tags: Column, matches: tuple[list[str], list[str], float]) -> Column:
    """0.12 of the boost for a category that matches, else 0.08 for a tag."""
    cats, labels, boost = matches
    if boost <= 0:
        return F.lit(0.0)
    tagged = F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*[F.lit(x) for x in labels]).cast("array<string>"))
    return F.when(_low(category).isin(*cats) if cats else F.lit(False), round(boost * 0.12, 4)).when(F.coalesce(tagged, F.lit(False)), round(boost * 0.08, 4)).otherwise(0.0)


def all_adjustments(matches: tuple[list[str], list[str], float]) -> Column:
    """Ranking adjustments with the topic's bonus."""
    return F.round(adjustments() + topic_bonus(F.col("category"), F.col("tags"), matches), 4)


def keyword_share(tokens: list[str], title: Column, tags: Column, summary: Column) -> Column:
    """The share of the distinct tokens that title, tags and summary contain."""
    distinct = sorted(set(tokens))
    text = F.concat_ws(" ", _low(title), F.lower(F.array_join(tags, " ")), _low(summary))
    return _count(distinct, text) / F.lit(max(1, len(distinct)))


def best_of_card(vectors: DataFrame, query: list[float], key: str = "key", vector: str = "embedding") -> DataFrame:
    """(card, similarity): the best of a card's vectors, whose keys are the card's, or it and #kp and a number."""
    sim = F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6)
    return vectors.select(F.element_at(F.split(key, "#"), 1).alias("card"), sim.alias("s")).groupBy("card").agg(F.max("s").alias("similarity"))


def semantic_recall(vectors: DataFrame, items: DataFrame, query: list[float], tokens: list[str], matches: tuple, limit: int, cut: float | None = None, s: Settings = DEFAULT) -> DataFrame:
    """The best `limit` items by similarity, keywords and adjustments, of the 2 * limit nearest cards above the cut; hidden ones go.

    Twice the limit is fetched, so that hiding leaves enough; vectors without an item are skipped.
    """
    near = top(best_of_card(vectors, query).where(F.col("similarity") >= (s.semantic_cut if cut is None else cut)), 2 * limit, F.desc("similarity"), "card")
    c = F.col
    rows = items.join(F.broadcast(near), items.path == near.card)  # 2 * limit rows
    mixed = s.similarity_weight * c("similarity") + s.keyword_weight * keyword_share(tokens, c("title"), c("tags"), c("summary"))
    rows = rows.withColumn("score", F.round(mixed + all_adjustments(matches), 4))
    rows = rows.where(~hidden_result(c("title"), c("summary"), c("category"), c("excluded"), c("source_url")))
    return top(rows, limit, F.desc("score"), "path")


def first_backend(backends: list[tuple[str, DataFrame | Callable[[], DataFrame]]]) -> DataFrame:
    """The first result that has rows, with its name as mode, and as passed what came before it: 'name: empty' or 'name: error'.

    Each rung is computed once, and staged; a callable is not called before its turn. A rung that raises, when it is planned or
    when it runs, is passed over; if the last one raises, so does this. Where none has rows, the last is given.
    """
    passed: list[str] = []
    for k, (name, rows) in enumerate(backends):
        try:
            made = rows() if callable(rows) else rows
            made = store.write(made, f"{store.new_folder(made.sparkSession, 'backend')}/{name}")
        except Exception as e:  # noqa: BLE001 - a backend may fail in any way
            if k + 1 == len(backends):
                raise
            passed.append(f"{name}: {type(e).__name__}")
            continue
        if k + 1 == len(backends) or not made.isEmpty():
            return made.withColumn("mode", F.lit(name)).withColumn("passed", F.lit(", ".join(passed)))
        passed.append(f"{name}: empty")
    raise ValueError("no backends")


def section_scores(sections: DataFrame, tokens: list[str], floor: int = 4) -> DataFrame:
    """Sections (heading, body) by tokens: 6 for one in the heading, else 2 in the body; not below the floor, and none without a body."""
    title, text = _low(F.col("heading")), F.lower(F.concat_ws(" ", "heading", "body"))
    score = reduce(lambda a, b: a + b, [F.when(F.contains(title, F.lit(t)), 6).when(F.contains(text, F.lit(t)), 2).otherwise(0) for t in tokens], F.lit(0))
    return sections.withColumn("score", score).where((F.col("score") >= floor) & (F.col("body") != ""))


def section_excerpt(body: Column, size: int = 240) -> Column:
    """The lines that are no rules, as one line, cut at a word."""
    lines = F.filter(F.split(body, r"\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^-{3,}$"))
    start = F.trim(F.left(F.array_join(lines, " "), F.lit(size)))
    return F.when(F.length(start) >= size, F.concat(F.regexp_replace(start, r" [^ ]*$", ""), F.lit("…"))).otherwise(start)


def section_recall(sections: DataFrame, tokens: list[str], limit: int = 2, doc: str = "doc_id") -> DataFrame:
    """The best section of each document (the first of equals), and the best `limit` of them, with an excerpt."""
    scored = section_scores(sections, tokens)
    best = scored.groupBy(doc).agg(F.max_by(F.struct("section_no", "heading", "body", "score"), F.struct("score", (-F.col("section_no")).alias("o"))).alias("b")).select(doc, "b.*")
    return top(best, limit, F.desc("score"), doc).withColumn("excerpt", section_excerpt(F.col("body")))


def _tokens(tokens: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in tokens])


def continuity_sections(sections: DataFrame, tokens: list[str], limit: int = 3, floor: float = 0.3) -> DataFrame:
    """Memory sections: the heading's phrase score twice, the body's half; with the best window as excerpt."""
    t = _tokens(tokens)
    score = F.round(2.0 * T.phrase_score(t, F.col("heading")) + 0.5 * T.phrase_score(t, F.col("body")), 3)
    rows = sections.where("body <> ''").withColumn("score", score).where(F.col("score") >= floor)
    return top(rows, limit, F.desc("score"), "doc_id", "section_no").withColumn("excerpt", T.best_window(F.col("body"), t))


def phrase_points(tokens: list[str], low: Column, bonus: float = 0.5) -> Column:
    """text.phrase_score for tokens that are known and a text in lower case: a sum of searches, which Spark compiles."""
    held = {t: F.contains(low, F.lit(t)) for t in tokens}
    cjk = re.compile(f"^{T.CJK}+$")
    of: dict[str, list[str]] = {}
    for t in held:
        for unit in t if cjk.match(t) else [t]:
            of.setdefault(unit, []).append(t)
    any_of = lambda ts: reduce(lambda a, b: a | b, [held[t] for t in ts]).cast("int")
    units = reduce(lambda a, b: a + b, [any_of(ts) for ts in of.values()], F.lit(0))
    pairs = reduce(lambda a, b: a + b, [(F.contains(low, F.lit(a + b)) | F.contains(low, F.lit(f"{a} {b}"))).cast("int") for a, b in zip(tokens, tokens[1:])], F.lit(0))
    return units / F.lit(max(1, len(of))) + F.lit(bonus) * pairs


def continuity_topics(topics: DataFrame, tokens: list[str], limit: int = 2, floor: float = 0.4) -> DataFrame:
    """Topics (doc_id, title, tags, body): 3 of the title's score, 1.5 of the tags', 0.4 of the body's; with the best section's heading.

    The score is computed once, the floor is put to the best alone, and only these are kept and cut into sections.
    """
    p = lambda c: phrase_points(tokens, _low(F.col(c)))
    score = F.round(3.0 * p("title") + 1.5 * p("tags") + 0.4 * p("body"), 3)
    best = top(topics.withColumn("score", score), limit, F.desc("score"), "doc_id").where(F.col("score") >= floor)
    best = store.write(best, store.new_folder(topics.sparkSession, "topics"))
    own = (2.0 * p("heading") + p("body")).alias("own")
    named = sections_of(best.select("doc_id", "body"), ["doc_id"]).select("doc_id", "section_no", "heading", own).where("own > 0")
    named = named.groupBy("doc_id").agg(F.max_by("heading", F.struct("own", (-F.col("section_no")).alias("o"))).alias("heading"))
    return best.join(named, "doc_id", "left").withColumn("section", F.coalesce(F.nullif("heading", F.lit("")), F.col("title"))).drop("heading")


def _pattern(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def contrarian_sections(sections: DataFrame, tokens: list[str], limit: int, signals: tuple[str, ...] = CONTRARIAN) -> DataFrame:
    """Sections of 20 characters and more that hold signals and 0.15 of the tokens: 0.6 of that share, 0.4 for signals up to five."""
    n = F.regexp_count("body", F.lit(_pattern(signals)))
    rel = T.hit_fraction(_tokens(tokens), F.concat_ws(" ", "heading", "body"))
    rows = sections.where(F.length(F.trim("body")) >= 20).withColumn("signals", n).withColumn("_rel", rel).where("signals > 0 and _rel >= 0.15")
    score = F.round(0.6 * F.col("_rel") + 0.4 * F.least(F.col("signals") / 5.0, F.lit(1.0)), 3)
    return top(rows.withColumn("score", score).drop("_rel"), limit, F.desc("score"), "doc_id", "section_no")


def signal_sentence(text: Column, tokens: list[str], signals: tuple[str, ...] = CONTRARIAN, size: int = 200) -> Column:
    """The sentence of ten characters and more with most signals (0.4 each) and tokens (0.6 of their share), the first of equals; else the text's start."""
    t = _tokens(tokens)
    sentences = F.filter(F.transform(F.split(text, "[。！？\n]"), lambda x: F.trim(x)), lambda x: F.length(x) >= 10)
    scored = F.transform(sentences, lambda x, i: F.struct((0.4 * F.regexp_count(x, F.lit(_pattern(signals))) + 0.6 * T.hit_fraction(t, x)).alias("s"), (-i).alias("i"), x.alias("x")))
    best = T.let(F.array_max(scored), lambda b: F.when(b.s > 0, b.x))
    return T.let(F.coalesce(best, F.left(text, F.lit(size))), lambda r: F.when(F.length(r) > size, F.concat(F.left(r, F.lit(size)), F.lit("…"))).otherwise(r))


def asset_score(tokens: list[str], text: Column) -> Column:
    """The share of the tokens and 0.3 for each two neighbours that stand together."""
    low = _low(text)
    pairs = [F.contains(low, F.lit(a + b)) | F.contains(low, F.lit(f"{a} {b}")) for a, b in zip(tokens, tokens[1:])]
    return _count(tokens, low) / F.lit(max(1, len(tokens))) + 0.3 * reduce(lambda a, b: a + b, [p.cast("int") for p in pairs], F.lit(0))


def action_recall(scripts: DataFrame, sections: DataFrame, plans: DataFrame, tokens: list[str], limit: int = 4, signals: tuple[str, ...] = ACTION) -> DataFrame:
    """What can be acted on: three scripts (path, name), two sections with action words (path, section_no, heading, body) and two plans, the best of each path."""
    named = F.regexp_replace("name", "[_-]", " ")
    s = top(scripts.withColumn("score", F.round(asset_score(tokens, F.concat_ws(" ", named, "name")), 3)).where("score >= 0.2"), 3, F.desc("score"), "path").select(F.lit("script").alias("kind"), "path", "name", "score")
    p = top(plans.withColumn("score", F.round(asset_score(tokens, named), 3)).where("score >= 0.2"), 2, F.desc("score"), "path").select(F.lit("plan").alias("kind"), "path", "name", "score")
    acts = F.concat_ws("\n", "heading", "body").rlike(_pattern(signals))
    w = sections.where(acts).withColumn("score", F.round(asset_score(tokens, F.concat_ws(" ", "heading", "body")), 3)).where("score >= 0.15")
    w = top(w, 2, F.desc("score"), "path", "section_no").select(F.lit("wiki_section").alias("kind"), "path", F.col("heading").alias("name"), "score")
    found = s.unionByName(w).unionByName(p)
    best = found.groupBy("path").agg(F.max_by(F.struct("kind", "name", "score"), F.struct("score", "kind", "name")).alias("b")).select("b.kind", "path", "b.name", "b.score")
    return top(best, limit, F.desc("score"), "path")


def question_tokens(text: str, stopwords: tuple[str, ...] = ()) -> list[str]:
    """Words of two characters and more, then neighbouring pairs of CJK characters, repeats kept."""
    runs = re.findall("[一-鿿]{2,}", text.lower())
    return [t for t in [*re.findall(r"[A-Za-z0-9_\-]{2,}", text.lower()), *(r[i : i + 2] for r in runs for i in range(len(r) - 1))] if t not in stopwords]


def topic_question_score(tokens: list[str], question: str, title: Column, tags: Column, body: Column) -> Column:
    """5, 3 and 1 for a token in title, tags and body; 8 and 4 for the whole question in title and body."""
    t, g, b, q = _low(title), _low(tags), _low(body), question.lower()
    return 5.0 * _count(tokens, t) + 3.0 * _count(tokens, g) + 1.0 * _count(tokens, b) + 8.0 * F.contains(t, F.lit(q)).cast("int") + 4.0 * F.contains(b, F.lit(q)).cast("int")


def card_question_score(tokens: list[str], question: str, title: Column, tags: Column, summary: Column, blob: Column) -> Column:
    """8, 6, 3 and 1 for a token in title, tags, summary and blob; 8 for the whole question; 2 for a summary."""
    t, g, s, b = _low(title), F.lower(F.array_join(tags, " ")), _low(summary), _low(blob)
    whole = 8.0 * F.contains(b, F.lit(question.lower())).cast("int") + 2.0 * (s != "").cast("int")
    return 8.0 * _count(tokens, t) + 6.0 * _count(tokens, g) + 3.0 * _count(tokens, s) + 1.0 * _count(tokens, b) + whole


def situation(question: Column, topic_score: Column, cards: Column) -> Column:
    """Continuity by the question's words; enrichment where a topic scores 8 or three cards answer; else direct."""
    return F.when(question.rlike(f"(?i){CONTINUITY}"), "continuity").when((topic_score >= 8.0) | (cards >= 3), "enrichment").otherwise("direct")


def topic_excerpt(body: Column, tokens: list[str], size: int) -> Column:
    """A short body whole; else its best sections, in that order, up to the size: the last is cut if 100 characters of it fit."""
    sections = F.split(body, r"\n(?=#{1,3} )")
    points = lambda x: reduce(lambda a, b: a + b, [F.when(F.contains(F.left(F.lower(x), F.lit(200)), F.lit(t)), 3).when(F.contains(F.lower(x), F.lit(t)), 1).otherwise(0) for t in tokens], F.lit(0))
    ranked = F.array_sort(F.transform(sections, lambda x, i: F.struct((-points(x)).alias("p"), i.alias("i"), x.alias("x"))))

    def add(done: Column, x: Column) -> Column:
        over = F.length(done.out) + F.length(x.x) > size
        rest = size - F.length(done.out)
        cut = F.when(rest > 100, F.concat(done.out, F.left(x.x, rest), F.lit("…"))).otherwise(done.out)
        return F.when(done.full, done).otherwise(F.struct(F.when(over, cut).otherwise(F.concat(done.out, x.x, F.lit("\n\n"))).alias("out"), over.alias("full")))

    whole = F.aggregate(ranked, F.struct(F.lit("").alias("out"), F.lit(False).alias("full")), add, lambda d: d.out)
    return F.when(F.length(body) <= size, body).otherwise(F.btrim(whole, F.lit("\n ")))


def catalog_search(records: DataFrame, terms: list[str], namespace: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(records, filtered): the best records (kind, id, blob, sensitivity, namespace) by occurrences of the terms, and how many of each kind the rights kept back."""
    marked = records.withColumn("_may", allowed(F.col("sensitivity"), F.col("namespace"), namespace))
    blob = F.lower("blob")
    score = reduce(lambda a, b: a + b, [T.occurrences(blob, F.lit(t)) for t in terms], F.lit(0))
    found = marked.where("_may").withColumn("score", score).where("score > 0").drop("_may", "blob")
    return top(found, limit, F.desc("score"), "kind", "id"), marked.where("not _may").groupBy("kind").agg(F.count(F.lit(1)).alias("filtered"))


def recall_warnings(mode: Column, dropped: Column, filtered: Column) -> Column:
    """Why a result is thin: the backend failed, nothing was relevant, or rights kept rows back."""
    about = F.when((mode != "hybrid") & (dropped > 0), F.concat(F.lit("semantic results found but "), dropped.cast("string"), F.lit(" dropped below the relevance floor")))
    about = about.when(mode != "hybrid", "semantic_backend_unavailable_or_empty; keyword fallback used")
    about = about.when(dropped > 0, F.concat(dropped.cast("string"), F.lit(" semantic results dropped below the relevance floor")))
    return F.filter(F.array(about, F.when(filtered > 0, "records_filtered_by_acl")), lambda x: x.isNotNull())


def relevant(rows: DataFrame, similarity: str, floor: float = DEFAULT.relevance_floor, layers: tuple[str, ...] = ()) -> DataFrame:
    """Rows at or above the floor, with the similarity as score and the old score as rank_score; unknown similarities keep theirs. layers: those (column layer) that it holds for."""
    s = F.col(similarity)
    held = F.col("layer").isin(*layers) if layers else F.lit(True)
    kept = rows.where(~held | s.isNull() | (s >= floor))
    swap = held & s.isNotNull()
    return kept.withColumn("rank_score", F.when(swap, F.col("score"))).withColumn("score", F.when(swap, s).otherwise(F.col("score")))


def related(queries: DataFrame, items: DataFrame, ident: str, limit: int = 3, least: int = 1) -> DataFrame:
    """The items whose title, summary and tags contain most of a query's distinct tokens (query, tokens): `least` at least, `limit` of each.

    A token counts in each word that contains it (held_in). So an item becomes the set of the
    tokens that it contains, and is compared with a query by the rarest of them (top_overlaps).
    """
    text = F.lower(F.concat_ws(" ", "title", "summary", F.array_join("tags", " ")))
    words = items.select(F.col(ident).alias("_id"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_\-]{2,}|[一-鿿]{2,}"), F.lit(0)))).alias("word"))
    tokens = queries.select(F.explode("tokens").alias("token")).distinct()
    holds = held_in(tokens, words.select("word").distinct()).groupBy("word").agg(F.collect_list("token").alias("tokens"))  # parts of one word
    sets = words.join(holds, "word").groupBy("_id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("elements"))  # an item's own words
    found = top_overlaps(queries.select("query", F.col("tokens").alias("elements")), sets.select(F.col("_id").alias("id"), "elements"), limit, least)
    return found.select("query", F.col("id").alias(ident), F.col("shared").cast("long").alias("score"))
