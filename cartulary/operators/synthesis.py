"""Prompts built of many rows, and what is said of them: packing under a budget, trees of calls, batches, digests and answers.

Providers are injected (see providers.py). Groups may hold any share of the rows: places in a group
are running sums over ranges of rows, and a prompt is the only thing that is put together in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.text import let, normal_title, take_bullets
from cartulary.operators.providers import answered, json_object, relation
from cartulary.sources import store

Provider = Callable[[list[str]], list]
#: Characters of a prompt, at most.
BUDGET = 6000
#: Levels without fewer prompts after which a group is given up.
PATIENCE = 3
#: Notes of one call, bullets that are kept of its answer, and characters of the page that it is shown.
BATCH, BULLETS, SHOWN = 40, 8, 1500
#: Titles of a category shown for suggestions; cards shown for gaps, with so much of a title and so many tags.
TITLES, CARDS, TITLE, TAGS = 8, 20, 80, 5
#: Links offered with an answer.
LINKS = 5


def placed(rows: DataFrame, group: str, order: list[str], size: Column, folder: str) -> DataFrame:
    """rows with _n (rows before it in its group), _at (their sizes together) and _all (the sizes of the whole group), in the given order.

    Rows are dealt by ranges of group and order, and staged, so a hot group lies in many tasks;
    what precedes each range is a sum over a row for each group and range. The order must tell the
    rows of a group apart. Rows of a null group go.
    """
    ranged = rows.where(F.col(group).isNotNull()).withColumn("_size", size.cast("long")).repartitionByRange(group, *order)
    ranged = store.write(ranged.withColumn("_p", F.spark_partition_id()), f"{folder}/ranged")
    totals = ranged.groupBy(group, "_p").agg(F.sum("_size").alias("_s"), F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    before = totals.select(group, "_p", summed("_s", earlier).alias("_s"), summed("_c", earlier).alias("_c"), F.sum("_s").over(Window.partitionBy(group)).alias("_all"))
    own = Window.partitionBy(group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(before, [group, "_p"])
    out = out.withColumn("_n", F.col("_c") + summed(F.lit(1), own)).withColumn("_at", F.col("_s") + summed("_size", own))
    return out.drop("_p", "_s", "_c", "_size")


def pieces(rows: DataFrame, group: str, order: list[str], text: str, most: int) -> DataFrame:
    """rows (group, order, _piece, text) whose texts have `most` characters at most: all of each text, in the order of _piece.

    A longer text is parted before white space, which stays, or within a word that is longer itself.
    What goes on begins with a space or other white space, so it is not taken for the start of a text.
    """
    parted = F.regexp_extract_all(F.col(text), F.lit(rf"(?s).{{1,{most - 1}}}(?=\s|\z)|.{{{most - 1}}}"), F.lit(0))
    parted = F.transform(parted, lambda x, i: F.when((i > 0) & ~x.rlike(r"^\s"), F.concat(F.lit(" "), x)).otherwise(x))
    return rows.select(group, *order, F.posexplode(F.when(F.length(text) > most, parted).otherwise(F.array(text))).alias("_piece", text))


def packed(rows: DataFrame, group: str, order: list[str], text: str, folder: str, budget: int = BUDGET) -> DataFrame:
    """(group, prompt, parts, text): the texts of each group in order, a line each, in prompts of `budget` characters at most, numbered from 0.

    A text of more than a quarter of a budget counts with its beginning, so hand in `pieces` of such texts: all of them are used then.
    A prompt takes the texts that begin in its three quarters of a budget, so that it depends on nothing but what comes before; a group
    that fits the budget is one prompt. Null and empty texts go.
    """
    most = budget // 4
    parts = rows.where(F.col(text) != "").withColumn("_part", F.left(text, F.lit(most - 1)))
    at = placed(parts, group, order, F.length("_part") + 1, folder)
    at = at.withColumn("prompt", F.when(F.col("_all") - 1 <= budget, F.lit(0).cast("long")).otherwise(F.floor(F.col("_at") / (budget - most))))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_part"))), lambda x: x["_part"]), "\n")
    packs = at.groupBy(group, "prompt").agg(F.count(F.lit(1)).alias("parts"), lines.alias("text"))
    packs = store.write(packs, f"{folder}/packed")
    # a long text may begin where no other does; numbers are given to places alone, so that no task has the texts of a group
    number = F.row_number().over(Window.partitionBy(group).orderBy("prompt")) - 1
    numbered = packs.select(group, "prompt").withColumn("_number", number.cast("long"))
    return packs.join(numbered, [group, "prompt"]).select(group, F.col("_number").alias("prompt"), "parts", "text")


def synthesised(rows: DataFrame, group: str, order: list[str], text: str, provider: Provider, *, head: str = "", budget: int = BUDGET) -> DataFrame:
    """(group, text, levels, prompts, lost): one answer for each group, over all of all its texts.

    A tree of calls: the texts are packed into prompts (after `head`), the answers to these are packed
    again, until one prompt holds what is left of a group. Texts and answers longer than a prompt's share go
    into several in pieces. prompts counts the calls; lost those without an
    answer, whose texts are not in the answer. A group whose calls all fail has a null text; one
    without texts has no row. Answers shorter than half a budget always come to an end; a group that has
    no fewer prompts than PATIENCE levels before is given up: its text is null, and its last prompts are all lost.
    """
    folder = store.new_folder(rows.sparkSession, "synthesis")
    now, by, ends, tolls = rows.select(group, *order, text), order, [], []
    while True:
        at = f"{folder}/level-{len(tolls)}"
        parted = pieces(now.where(F.col(text) != ""), group, by, text, budget // 4 - 1)
        packs = packed(parted, group, [*by, "_piece"], text, at, budget).withColumn("key", F.sha2("text", 256))
        packs = store.write(packs, f"{at}/packs")
        asked = packs.select("key", F.concat(F.lit(head), "text").alias("said"))
        last = packs.groupBy(group).agg(F.max("prompt").alias("last"))
        replies = packs.join(answered(asked, "key", "said", provider), "key", "left").join(last, group)
        replies = store.write(replies.select(group, "prompt", "last", F.nullif(F.trim("answer"), F.lit("")).alias(text)), f"{at}/replies")
        toll = replies.groupBy(group).agg(F.count(F.lit(1)).alias("prompts"), F.count_if(F.col(text).isNull()).alias("lost"))
        before = tolls[-PATIENCE].select(group, F.col("prompts").alias("_before")) if len(tolls) >= PATIENCE else toll.select(group, (F.col("prompts") + 1).alias("_before"))
        over = (F.col("prompts") > 1) & (F.col("prompts") >= F.col("_before"))
        toll = toll.join(before, group).select(group, "prompts", F.when(over, F.col("prompts")).otherwise(F.col("lost")).alias("lost"), over.alias("_over"))
        tolls.append(store.write(toll, f"{at}/toll"))
        ends.append(replies.where("last = 0").select(group, F.col(text).alias("text")))
        now, by = replies.where("last > 0").join(tolls[-1].where("not _over").select(group), group, "left_semi").select(group, "prompt", text), ["prompt"]
        if now.isEmpty():
            break
    toll = reduce(DataFrame.unionByName, tolls).groupBy(group).agg(F.count(F.lit(1)).alias("levels"), F.sum("prompts").alias("prompts"), F.sum("lost").alias("lost"))
    return toll.join(reduce(DataFrame.unionByName, ends), group, "left").select(group, "text", "levels", "prompts", "lost")


def concluded(notes: DataFrame, group: str, order: list[str], text: str, provider: Provider, page: DataFrame | None = None, *, head: str = "", batch: int = BATCH, keep: int = BULLETS) -> DataFrame:
    """(group, batches, lost, text): notes of a topic in batches of `batch`, each answered in bullets of which the first `keep` count.

    page (group, page) is what is written already, shown in part with each batch. Answers stand in the
    batches' order, apart by a blank line; what they thought first, and what is before the first bullet, goes. Batches
    without an answer or without bullets are left out; lost counts those without an answer.
    """
    folder = store.new_folder(notes.sparkSession, "conclusions")
    at = placed(notes.where(F.col(text) != ""), group, order, F.lit(1), folder).withColumn("_batch", F.floor(F.col("_n") / batch))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text))), lambda x: x[text]), "\n")
    batches = at.groupBy(group, "_batch").agg(F.count(F.lit(1)).alias("_m"), lines.alias("_lines"))
    shown = page.select(group, F.left("page", F.lit(SHOWN)).alias("_page")) if page is not None else batches.select(group).distinct().withColumn("_page", F.lit(""))
    told = F.concat(F.lit(head), F.col(group).cast("string"), F.lit("\n"), F.coalesce(F.col("_page"), F.lit("")), F.lit("\n"), F.col("_m").cast("string"), F.lit("\n"), "_lines")
    prompts = store.write(batches.join(shown, group, "left").select(group, "_batch", told.alias("_prompt")).withColumn("_key", F.sha2("_prompt", 256)), f"{folder}/prompts")
    said = prompts.join(answered(prompts, "_key", "_prompt", provider), "_key", "left")
    said = said.withColumn("_kept", F.array_join(take_bullets(F.regexp_replace(F.coalesce("answer", F.lit("")), r"(?s)<think>.*?</think>", ""), keep), "\n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_kept") != "", F.struct("_batch", "_kept")))), lambda x: x["_kept"]), "\n\n")
    return said.groupBy(group).agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col("answer").isNull()).alias("lost"), whole.alias("text"))


def _first(rows: DataFrame, group: str, order: list[str], most: int, line: Column) -> DataFrame:
    """(group, lines): of each group, a line of each of its first rows; Spark cuts the ranking before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    cut = rows.withColumn("_rank", rank).where(F.col("_rank") <= most).select(group, "_rank", line.alias("_line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_line"))), lambda x: x["_line"]), "\n")
    return cut.groupBy(group).agg(lines.alias("lines"))


def suggested_topics(items: DataFrame, existing: DataFrame, provider: Provider, order: list[str], *, head: str = "", known: int = 500) -> DataFrame:
    """(category, n, topics, reason, confidence): what a provider suggests as topics of each category, from its count, its first titles and the topics that exist (column slug, `known` of them at most).

    The answer is JSON, fenced or not. One that cannot be read, or none, suggests nothing: null topics, a reason that cites its start, low confidence.
    """
    counts = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    titles = _first(items.where(F.coalesce("title", F.lit("")) != ""), "category", order, TITLES, F.concat(F.lit("  - "), F.trim("title")))
    slugs = "\n".join(f"  - {r[0]}" for r in existing.select("slug").distinct().orderBy("slug").limit(known).collect())
    told = F.concat(F.lit(head), "category", F.lit(" "), F.col("n").cast("string"), F.lit("\n"), F.coalesce(F.col("lines"), F.lit("")), F.lit(f"\n{slugs}"))
    prompts = counts.where("category is not null").join(titles, "category", "left").select("category", "n", told.alias("prompt"))
    said = prompts.join(answered(prompts, "category", "prompt", provider), "category", "left")
    parsed = F.from_json(json_object(F.col("answer")), "topics array<string>, reason string, confidence string, _bad string", {"columnNameOfCorruptRecord": "_bad"})

    def chosen(p: Column) -> Column:
        bad = p.isNull() | p["_bad"].isNotNull() | (p.topics.isNull() & p.reason.isNull())
        cited = F.concat(F.lit("unreadable: "), F.left(F.trim(F.coalesce("answer", F.lit(""))), F.lit(120)))
        return F.struct(F.when(~bad, p.topics).alias("topics"), F.when(bad, cited).otherwise(p.reason).alias("reason"), F.when(bad, "low").otherwise(F.coalesce(p.confidence, F.lit("low"))).alias("confidence"))

    return said.select("category", "n", let(parsed, chosen).alias("c")).select("category", "n", "c.topics", "c.reason", "c.confidence")


def knowledge_gaps(cards: DataFrame, group: str, provider: Provider, order: list[str], *, head: str = "") -> DataFrame:
    """(group, n, text): what a provider finds missing in each group, from its count and a digest of its first cards (title, tags). No answer, null."""
    line = F.concat(F.lit("- "), F.left(F.coalesce(F.col("title"), F.lit("")), F.lit(TITLE)), F.lit(" ["), F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, TAGS), ", "), F.lit("]"))
    counts = cards.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    prompts = counts.join(_first(cards, group, order, CARDS, line), group).select(group, "n", F.concat(F.lit(head), F.col("n").cast("string"), F.lit("\n"), "lines").alias("prompt"))
    return prompts.join(answered(prompts, group, "prompt", provider), group, "left").select(group, "n", F.col("answer").alias("text"))


def composed_answers(questions: DataFrame, hits: DataFrame, provider: Provider, *, wiki: int = 1200, card: int = 400, most: int = 10) -> DataFrame:
    """(id, grounded, links, text): an answer to each question (id, question, situation), from the hits (id, kind, rank, title, text, url) of its recall.

    Topics (kind 'wiki') come before cards, each with so many characters of its text, `most` of a
    kind at most. Cards' addresses are offered as links, the first LINKS of them, in the situation
    'enrichment' alone. A question in the situation 'direct', or without hits, is asked as it is.
    """
    rank = F.row_number().over(Window.partitionBy("id", "kind").orderBy("rank", "title", "text"))
    near = hits.withColumn("_r", rank).where(F.col("_r") <= most)
    is_wiki = F.col("kind") == "wiki"
    entry = F.concat(F.lit("["), F.coalesce(F.col("title"), F.lit("")), F.lit("]\n"), F.left(F.coalesce(F.col("text"), F.lit("")), F.when(is_wiki, wiki).otherwise(card)))
    link = F.when(~is_wiki & (F.col("url") != "") & (F.col("title") != ""), F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")")))
    told = F.transform(F.array_sort(F.collect_list(F.struct((~is_wiki).alias("k"), "_r", entry.alias("e")))), lambda x: x.e)
    links = F.slice(F.transform(F.array_sort(F.collect_list(F.when(link.isNotNull(), F.struct("_r", link.alias("l"))))), lambda x: x.l), 1, LINKS)
    context = near.groupBy("id").agg(F.array_join(told, "\n\n").alias("_told"), links.alias("_links"))
    q = questions.join(context, "id", "left")
    grounded = F.col("_told").isNotNull() & (F.coalesce("situation", F.lit("")) != "direct")
    offered = F.when(grounded & (F.col("situation") == "enrichment"), F.coalesce("_links", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    q = q.select("id", grounded.alias("grounded"), offered.alias("_offered"), "_told", F.coalesce("question", F.lit("")).alias("question"))
    prompt = F.when(F.col("grounded"), F.concat("_told", F.when(F.size("_offered") > 0, F.concat(F.lit("\n\nLinks:\n"), F.array_join("_offered", "\n"))).otherwise(""), F.lit("\n\nQuestion: "), "question")).otherwise(F.col("question"))
    q = q.select("id", "grounded", F.size("_offered").cast("long").alias("links"), prompt.alias("_prompt")).withColumn("_key", F.sha2("_prompt", 256))
    return q.join(answered(q, "_key", "_prompt", provider), "_key", "left").select("id", "grounded", "links", F.col("answer").alias("text"))


def judged_pairs(pairs: DataFrame, cards: DataFrame, provider: Provider, *, head: str = "") -> DataFrame:
    """(a, b, similarity, relation, reason, notable) of pairs (a, b, similarity): what a provider says of the two cards (id, title, summary).

    An answer states each in a line of its own: an unstated relation is UNKNOWN, other things are empty. Pairs of a card that is missing,
    and pairs whose call fails, are left out.
    """
    card = lambda s: cards.select(F.col("id").alias(s), F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))).alias(f"_{s}"))
    both = pairs.join(card("a"), "a").join(card("b"), "b").withColumn("_prompt", F.concat(F.lit(head), "_a", F.lit("\n\n"), "_b")).withColumn("_key", F.sha2("_prompt", 256))
    both = both.select("a", "b", "similarity", "_key", "_prompt")
    said = both.join(answered(both, "_key", "_prompt", provider), "_key").where("answer is not null")
    line = lambda name: F.trim(F.regexp_extract("answer", rf"{name}:\s*(.+)", 1))
    return said.select("a", "b", "similarity", relation(F.col("answer")).alias("relation"), line("REASON").alias("reason"), line("NOTABLE").alias("notable"))


def health_report(cards: DataFrame, conflicts: DataFrame, gaps: DataFrame, *, examples: int = 5) -> DataFrame:
    """(category, cards, judged, conflicts, duplicates, examples, gaps): the report of each category.

    cards have id, category and title; conflicts are judged pairs, counted where both cards are of the category; gaps (category, text). duplicates are
    titles that more than one card has (but for case and marks; blank ones aside), examples the first of them in the alphabet. A category without any of these has zeros, no examples and null gaps.
    """
    c = cards.where("category is not null")
    total = c.groupBy("category").agg(F.count(F.lit(1)).alias("cards"))
    title = normal_title(F.col("title"))
    twice = c.where(title != "").groupBy("category", title.alias("_t")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rank = twice.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy("_t")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.struct("_r", "_t")))), lambda x: x["_t"]), "; ")
    doubles = rank.groupBy("category").agg(F.count(F.lit(1)).alias("duplicates"), listed.alias("examples"))
    of = lambda s: c.select(F.col("id").alias(s), F.col("category").alias(f"_{s}"))
    within = conflicts.join(of("a"), "a").join(of("b"), "b").where("_a = _b")
    found = within.groupBy(F.col("_a").alias("category")).agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("relation") == "CONFLICT").alias("conflicts"))
    out = total.join(found, "category", "left").join(doubles, "category", "left").join(gaps.select("category", F.col("text").alias("gaps")), "category", "left")
    return out.na.fill(0, ["judged", "conflicts", "duplicates"]).na.fill("", ["examples"])
