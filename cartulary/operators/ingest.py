"""What comes in: transcripts, threads, repositories, papers, media and local notes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.predicates import is_low_value
from cartulary.functions.text import extract_urls, let, text_or_empty

# fixed values: lines of pages that are not text, and how much an image's kind says
BAD_LINES = ("Don’t miss what’s happening", "Sign in to X", "Create account", "New to X?", "Trending now", "What’s happening", "Saved searches", "Provide feedback", "Privacy Policy", "Cookie Policy", "Target URL returned error 404", "github.com/login", "Sign in to GitHub")
IMAGE_KINDS = {"result_image": 10, "storyboard": 9, "comparison": 8, "product_mockup": 7, "diagram": 5, "prompt_screenshot": 3, "article_cover": 2, "unknown": 1}
_TWEET = "struct<text: string, full_text: string, note_tweet: string>"


def clean_page(text: Column) -> Column:
    """Lines that say something."""
    bad = lambda x: F.exists(F.array(*[F.lit(b) for b in BAD_LINES]), lambda b: F.contains(x, b))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~bad(x)), "\n")


def thread(raw: Column) -> Column:
    """(text, additions, urls) of a thread in JSON, be it a list, or under tweets, thread or data, or one post; posts that say little go."""
    envelope = F.from_json(raw, f"tweets array<{_TWEET}>, thread array<{_TWEET}>, data array<{_TWEET}>, text string, full_text string, note_tweet string")
    alone = lambda e: F.array(F.struct(e.text.alias("text"), e.full_text.alias("full_text"), e.note_tweet.alias("note_tweet")))
    posts = F.coalesce(F.when(raw.rlike(r"\A\s*\["), F.from_json(raw, f"array<{_TWEET}>")), let(envelope, lambda e: F.coalesce(e.tweets, e.thread, e.data, alone(e))))
    said = F.transform(posts, lambda p, i: F.struct((i + 1).alias("n"), clean_page(F.coalesce(F.nullif(p.text, F.lit("")), F.nullif(p.full_text, F.lit("")), F.nullif(p.note_tweet, F.lit("")))).alias("t")))
    kept = F.filter(said, lambda p: ~is_low_value(p.t, BAD_LINES))

    def told(k: Column) -> Column:
        text = F.left(F.array_join(F.transform(k, lambda p: F.concat(F.lit("["), p.n.cast("string"), F.lit("] "), p.t)), "\n\n"), F.lit(20000))
        urls = F.slice(F.array_distinct(F.flatten(F.transform(k, lambda p: extract_urls(p.t)))), 1, 10)
        return F.struct(text.alias("text"), F.slice(F.transform(F.filter(k, lambda p: p.n > 1), lambda p: p.t), 1, 10).alias("additions"), urls.alias("urls"))

    return let(kept, told)


def scored_lines(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """(doc, score, slug, text) of lines '[score] slug -- text'; a line that begins otherwise continues the one before; others go."""
    from pyspark.sql import Window

    head = F.col(line).rlike(r"^\s*\[[0-9]+\.[0-9]+\]\s+\S+\s+--")
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("_head", head).withColumn("_k", F.sum(head.cast("int")).over(w)).where("_k > 0")
    rows = rows.where(F.col("_head") | ((F.trim(line) != "") & ~F.startswith(line, F.lit("["))))
    part = F.when(F.col("_head"), F.regexp_extract(F.trim(line), r"--\s?(.*)$", 1)).otherwise(F.col(line))
    of = lambda g: F.max(F.when(F.col("_head"), F.regexp_extract(F.trim(line), r"^\[([0-9]+\.[0-9]+)\]\s+(\S+)", g)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda x: x.p), "\n")
    return rows.groupBy(doc, "_k").agg(of(1).cast("double").alias("score"), of(2).alias("slug"), text.alias("text")).drop("_k")


def timeline(raw: Column) -> Column:
    """(ids, cursor) of a page of a timeline in JSON, at whatever depth its entries are: the numbers of posts, and the bottom cursor's value."""
    ids = F.regexp_extract_all(raw, F.lit(r'"entryId"\s*:\s*"tweet-([0-9]+)'), F.lit(1))
    bottom = F.regexp_extract(raw, r'"entryId"\s*:\s*"cursor-bottom[^"]*"\s*,\s*"content"\s*:\s*\{[^}]*?"value"\s*:\s*"([^"]+)"', 1)
    return F.struct(ids.alias("ids"), F.nullif(bottom, F.lit("")).alias("cursor"))


def wanted_repository(archived: Column, description: Column, topics: Column) -> Column:
    return ~F.coalesce(archived, F.lit(False)) & ((text_or_empty(description) != "") | (F.size(F.coalesce(topics, F.array().cast("array<string>"))) > 0))


def paper(text: Column, stem: Column) -> Column:
    """(title, author, excerpt, chars, quality) of a paper's text: the heading in its first five lines or its name; authors in its first ten; null under 200 characters."""
    lines = F.split(text, r"\n")
    title = let(F.filter(F.slice(lines, 1, 5), lambda x: F.startswith(x, F.lit("# "))), lambda t: F.when(F.size(t) > 0, F.trim(F.regexp_replace(t[0], "^[# ]+", ""))))
    author = F.regexp_extract(F.array_join(F.slice(lines, 1, 10), "\n"), r"\*\*Authors?:\*\*\s*(.+)", 1)
    start = F.trim(F.replace(F.left(text, F.lit(500)), F.lit("\n"), F.lit(" ")))
    n = F.length(text)
    out = F.struct(
        F.coalesce(F.nullif(title, F.lit("")), F.regexp_replace(stem, "[_-]", " ")).alias("title"), F.trim(author).alias("author"), F.when(F.length(start) > 480, F.concat(F.left(start, F.lit(480)), F.lit("…"))).otherwise(start).alias("excerpt"),
        n.cast("long").alias("chars"), F.least(F.lit(1.0), n / 10000.0).alias("quality"),
    )
    return F.when(n >= 200, out)


def clean_paper(text: Column) -> Column:
    """Lines of over three characters that are no page numbers, heads or feet."""
    lines = F.transform(F.split(text, r"\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (F.length(x) > 3) & ~x.rlike("^[0-9]+$") & ~x.rlike("(?i)^(?:arXiv|doi:|https?://|©|Copyright|All rights reserved)")), "\n")


def article_text(title: Column, abstract: Column, authors: Column, paragraphs: Column) -> Column:
    """An article's text with its heads; null under 300 characters."""
    parts = [F.concat(F.lit("# "), title), F.when(F.size(authors) > 0, F.concat(F.lit("**Authors:** "), F.array_join(F.slice(authors, 1, 5), ", "))), F.when(abstract != "", F.concat(F.lit("## Abstract\n"), abstract)), F.array_join(paragraphs, "\n")]
    text = F.trim(F.concat_ws("\n\n", *parts))
    return F.when(F.length(text) >= 300, text)


def local_summary(text: Column, title: Column) -> Column:
    """(line, points): a summary by rule: the first sentence, 80 characters, and the first three."""
    t = F.regexp_replace(text, r"\A---(?s:.*?)---\s*", " ")
    for pattern in (r"(?m)^(?:Title|URL Source|Published Time|Markdown Content):.*$", r"```(?s:.*?)```", r"\[[^\]]+\]\([^)]+\)", r"https?://\S+"):
        t = F.regexp_replace(t, pattern, " ")
    sentences = F.filter(F.transform(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), r"[。！？!?.]+"), lambda x: F.trim(x)), lambda x: x != "")

    def told(s: Column) -> Column:
        line = F.when(F.size(s) > 0, s[0]).otherwise(title)
        return F.struct(F.when(F.length(line) > 80, F.concat(F.rtrim(F.left(line, F.lit(80))), F.lit("…"))).otherwise(line).alias("line"), F.slice(s, 1, 3).alias("points"))

    return let(sentences, told)


def best_thumbnail(images: DataFrame, group: str, order: str) -> DataFrame:
    """(group, order) of the image of the highest kind * 10 + score; the first of equals."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in IMAGE_KINDS.items()], F.lit(1))
    return images.groupBy(group).agg(F.max_by(order, F.struct((rank * 10 + F.col("score")).alias("s"), (-F.col(order)).alias("o"))).alias(order))


def extension(url: Column, content_type: Column) -> Column:
    """A file's ending by its address's format, else by its type; .jpg without either."""
    asked = F.lower(F.regexp_extract(url, r"[?&]format=([^&#]*)", 1))
    kind = F.coalesce(content_type, F.lit(""))
    by_type = F.coalesce(*[F.when(F.contains(kind, F.lit(k)), f".{k}") for k in ("png", "webp", "gif")], F.lit(".jpg"))
    return F.when(asked.isin("jpg", "jpeg"), ".jpg").when(asked.isin("png", "webp", "gif"), F.concat(F.lit("."), asked)).otherwise(by_type)


def slug_address(slug: Column) -> Column:
    """The address that a slug stands for: a status number, at its end or alone; a video; a repository."""
    digits, video = F.regexp_extract(slug, r"([0-9]{15,20})$", 1), F.regexp_extract(slug, r"^youtube-([A-Za-z0-9_\-]{11})$", 1)
    owner, name = (F.regexp_extract(slug, r"^github_(?:fork|star)-(.+)-([^-]+)$", k) for k in (1, 2))
    return F.when(digits != "", F.concat(F.lit("https://x.com/i/status/"), digits)).when(video != "", F.concat(F.lit("https://www.youtube.com/watch?v="), video)).when(owner != "", F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name)).otherwise("")


def preferred(languages: Column, order: tuple[str, ...] = ("zh-Hans", "zh-TW", "en")) -> Column:
    """The first of the wanted languages that there is."""
    return F.coalesce(*[F.when(F.array_contains(languages, x), F.lit(x)) for x in order], F.lit(None).cast("string"))


def new_notes(files: DataFrame, known: DataFrame) -> DataFrame:
    """Notes (path, body) that are not known (key): id and key by their content, each content once."""
    rows = files.withColumn("id", F.left(F.md5("body"), F.lit(8))).withColumn("key", F.concat(F.lit("local|"), "id"))
    once = rows.groupBy("key").agg(F.min(F.struct("path", "id")).alias("b")).select("key", "b.path", "b.id")
    return once.join(known.select("key"), "key", "left_anti")
