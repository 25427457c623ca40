"""Notes in Markdown: index rows, paths, migration, key points, titles and section documents, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import let, text_or_empty
from cartulary.sources.records import sections, without_front_matter

# fixed values: headings, labels and field names that notes are written with
_ONE_LINE = r"##\s*📌\s*一句話摘要\s*\n+(.+)"
_CONDENSED = r"##\s*📝\s*AI\s*濃縮\s*\n+(.+)"
_TWO_TONGUES = r"(?s)##\s+7\.\s*雙語摘要[^\n]*\n(.+?)(?=\n##|\z)"
_CORE = (r"(?s)##\s+1\.\s*核心摘要\s*\n(.+?)(?=\n##|\z)", r"(?s)##\s+1\.\s*English Summary\s*\n(.+?)(?=\n##|\z)", r"(?s)##\s*📝\s*English Summary\s*\n(.+?)(?=\n##|\z)")
_POINTS = r"(?s)##\s+[^\n]*(?:關鍵論點|三個重點)[^\n]*\n(.+?)(?=\n##|\z)"
_VECTOR_SUMMARIES = (r"(?s)##\s+[^\n]*一句[話话]摘要\s*\n(.+?)(?=\n##|\z)", r"(?s)##\s+摘要\s*\n(.+?)(?=\n##|\z)")
_URLS = (r'(?m)^source_url:\s*"?([^"\n]+)"?\s*$', r'(?m)^original_url:\s*"?([^"\n]+)"?\s*$', r"\*\*原始連結\*\*：\s*(\S+)", r"(https://x\.com/\S+)", r"(https://twitter\.com/\S+)")
_UNTITLED, _NOT_SUMMARIES = "(untitled)", ("待整理", "待補充")


def _first(options: list[Column]) -> Column:
    """The first that is not empty; empty if all are."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in options], F.lit(""))


def _joined_lines(block: Column, size: int) -> Column:
    lines = F.transform(F.split(block, r"\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^-+", "")))
    return F.left(F.array_join(F.filter(lines, lambda x: x != ""), " "), F.lit(size))


def note_title(body: Column, stem: Column) -> Column:
    """The title field, else the first heading of one mark, else the file's name."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(body, p, 1)), F.lit("")) for p in (r'(?m)^title:\s*"?(.+?)"?\s*$', r"(?m)^#\s+(.+)$")], stem)


def note_category(body: Column) -> Column:
    return _first([F.trim(F.regexp_extract(body, r'(?m)^category:\s*"?(.+?)"?\s*$', 1)), F.lit("general")])


def note_tags(body: Column) -> Column:
    """The listed tags without quotes, else all words after a hash mark."""
    listed = F.transform(F.split(F.regexp_extract(body, r"(?m)^tags:\s*\[(.*?)\]\s*$", 1), ","), lambda t: F.regexp_replace(F.trim(t), "^[\"']+|[\"']+$", ""))
    marked = F.regexp_extract_all(body, F.lit(r"#([\p{L}\p{N}_\-]+)"), F.lit(1))
    return let(F.filter(listed, lambda t: t != ""), lambda own: F.when(F.size(own) > 0, own).otherwise(marked))


def note_summary(body: Column) -> Column:
    """The first of: the one-line summary, the condensed text (200), both tongues of the two-tongue summary (300), a core summary's lines (300)."""
    two = F.regexp_extract(body, _TWO_TONGUES, 1)
    tongues = F.filter(F.array(*[F.trim(F.regexp_extract(two, rf"(?m)^{label}[：:]\s*(.+)$", 1)) for label in ("(?:ZH|中文)", "(?:EN|英文)")]), lambda x: x != "")
    options = [F.trim(F.regexp_extract(body, _ONE_LINE, 1)), F.left(F.trim(F.regexp_extract(body, _CONDENSED, 1)), F.lit(200)), F.left(F.array_join(tongues, " | "), F.lit(300))]
    return _first([*options, *[_joined_lines(F.regexp_extract(body, p, 1), 300) for p in _CORE]])


def vector_summary(body: Column) -> Column:
    """A summary section as one line, 300 characters: what the vectors are made of."""
    return _first([F.left(F.regexp_replace(F.trim(F.regexp_extract(body, p, 1)), r"\s+", " "), F.lit(300)) for p in _VECTOR_SUMMARIES])


def source_type_of_stem(stem: Column, migrating: bool = False) -> Column:
    """What a file's name tells of its source. A migration also knows old names, and papers by another rule."""
    digits = stem.rlike("^[0-9]{15,20}$")
    rest = F.when(F.startswith(stem, F.lit("github_fork-")), "github_fork").when(F.startswith(stem, F.lit("github_star-")), "github_star").when(F.startswith(stem, F.lit("youtube-")), "youtube")
    if migrating:
        paper = F.startswith(stem, F.lit("local-pmc")) | (F.startswith(stem, F.lit("local-")) & ~F.startswith(stem, F.lit("local-paper")))
        return F.when(paper, "local-paper").otherwise(rest.when(F.startswith(stem, F.lit("legacy-")), "x-bookmark").when(digits, "x-bookmark").otherwise("local"))
    return rest.when(F.startswith(stem, F.lit("local-")), "local-paper").when(digits, "x-bookmark").otherwise("local")


def note_source_type(body: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(body, r'(?m)^source_type:\s*"?([^"\n]+)"?\s*$', 1)), F.lit("")), source_type_of_stem(stem))


def note_url(body: Column) -> Column:
    """The first address field or address that the ladder finds, else that of the status number."""
    found = [F.regexp_replace(F.trim(F.regexp_extract(body, p, 1)), '^"+|"+$', "") for p in _URLS]
    status = F.regexp_extract(body, r'(?m)^tweet_id:\s*"?([0-9]+)"?\s*$', 1)
    return _first([*found, F.when(status != "", F.concat(F.lit("https://x.com/i/status/"), status)).otherwise("")])


def index_rows(files: DataFrame) -> DataFrame:
    """Index rows of files (path, stem, body): fields by their ladders, and searchable, which holds them and the text's first 2,000 characters."""
    b, stem = F.col("body"), F.col("stem")
    out = files.select(
        "path", "stem", note_title(b, stem).alias("title"), note_category(b).alias("category"), note_tags(b).alias("tags"), note_summary(b).alias("summary"),
        note_source_type(b, stem).alias("source_type"), note_url(b).alias("source_url"), F.left(b, F.lit(2000)).alias("_start"),
    )
    blob = F.concat_ws("\n", "title", "category", F.array_join("tags", " "), "summary", "_start")
    return out.select("*", ((F.contains("path", F.lit("/cards/"))) | (F.col("summary") != "")).alias("enriched"), blob.alias("searchable")).drop("_start")


def canonical_path(relative: Column, workspace: str = "/w") -> Column:
    """One path for the layouts that indexes have had: absolute, below memory, below cards, below the bookmarks."""
    r = F.trim(relative)
    below = lambda prefix: F.concat(F.lit(prefix), r)
    return (
        F.when(r == "", "").when(F.startswith(r, F.lit("/")), r).when(r.rlike("^memory/(?:cards|bookmarks)/"), below(f"{workspace}/"))
        .when(F.startswith(r, F.lit("cards/")), below(f"{workspace}/memory/")).otherwise(below(f"{workspace}/memory/bookmarks/"))
    )


def changed_files(listing: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """(key, state) of a listing against an index, both (key, mtime, size): new, changed (whole seconds or size differ), same, gone."""
    i = index.select(key, F.col("mtime").cast("long").alias("_m"), F.col("size").cast("long").alias("_s"), F.lit(True).alias("_old"))
    j = listing.select(key, F.col("mtime").cast("long").alias("mtime"), F.col("size").cast("long").alias("size"), F.lit(True).alias("_new")).join(i, key, "full_outer")
    state = F.when(F.col("_new").isNull(), "gone").when(F.col("_old").isNull(), "new").when((F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s")), "same").otherwise("changed")
    return j.select(key, state.alias("state"))


def migrated(body: Column, stem: Column) -> Column:
    """(text, changes): thought block off, type renamed, source_type and sensitivity filled in where front matter has none."""
    thought = body.rlike(r"\A\s*<think>")
    plain = F.when(thought, F.regexp_replace(F.regexp_replace(body, r"\A\s*<think>(?s:.*?)</think>\s*", ""), r"\A\s+", "")).otherwise(body)

    def fixed(text: Column) -> Column:
        block, rest = F.regexp_extract(text, r"\A---\n(?s:(.*?))\n---\s*\n?(?s:.*)", 1), F.regexp_extract(text, r"\A---\n(?s:.*?)\n---\s*\n?((?s:.*))", 1)
        has = text.rlike(r"\A---\n(?s:.*?)\n---\s*\n?")
        old, typed, open_to = F.contains(block, F.lit("type: x-knowledge-card")), block.rlike(r"(?m)^source_type:"), block.rlike(r"(?m)^sensitivity:")
        kind = source_type_of_stem(stem, migrating=True)
        new = F.when(old, F.replace(block, F.lit("type: x-knowledge-card"), F.lit("type: knowledge-card"))).otherwise(block)
        new = F.when(typed, new).otherwise(F.concat(F.regexp_extract(new, r"\A((?s:.*?)(?m:^type:.*$))", 1), F.when(new.rlike("(?m)^type:.*$"), F.concat(F.lit("\nsource_type: "), kind)).otherwise(""), F.regexp_replace(new, r"\A(?s:.*?)(?m:^type:.*$)", "")))
        new = F.when(open_to, new).otherwise(F.concat(F.rtrim(new), F.lit("\nsensitivity: public")))
        changes = [F.when(thought, "stripped <think> block"), F.when(has & old, "type: x-knowledge-card → knowledge-card"), F.when(has & ~typed, F.concat(F.lit("added source_type: "), kind)), F.when(has & ~open_to, "added sensitivity: public"), F.when(~has, "SKIP: no valid frontmatter after stripping")]
        return F.struct(F.when(has, F.concat(F.lit("---\n"), new, F.lit("\n---\n"), rest)).otherwise(text).alias("text"), F.filter(F.array(*changes), lambda x: x.isNotNull()).alias("changes"))

    return let(plain, fixed)


def key_points(body: Column) -> Column:
    """The key-point section without bullets."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_extract(body, _POINTS, 1)), r"(?m)^[\-*•]\s*", ""))


def key_point_list(body: Column, most: int = 5, least: int = 10) -> Column:
    """Its lines of ten characters and more, five at most."""
    return F.slice(F.filter(F.transform(F.split(key_points(body), r"\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least), 1, most)


def card_text(title: Column, summary: Column, points: Column, size: int = 900) -> Column:
    """What a card's vector is made of."""
    return F.left(F.array_join(F.filter(F.array(F.trim(title), F.trim(summary), points), lambda x: x != ""), ". "), F.lit(size))


def display_title(title: Column, summary: Column) -> Column:
    """A title of ten digits and more gives way to the summary's first sentence."""
    t, s = text_or_empty(title), text_or_empty(summary)
    sentence = F.trim(F.left(F.split(F.split(s, "。")[0], r"\.")[0], F.lit(60)))
    usable = (s != "") & ~s.isin(*_NOT_SUMMARIES) & ~F.startswith(s, F.lit("###")) & (sentence != "")
    return F.when((t != "") & ~t.rlike("^[0-9]{10,}$"), t).when(usable, F.concat(sentence, F.lit("…"))).when(t != "", t).otherwise(_UNTITLED)


def section_documents(files: DataFrame, prefix: str = "wiki/topics", least: int = 80, most: int = 4000) -> DataFrame:
    """(key, text, hash) of sections of files (stem, body) whose body has `least` characters: what section vectors are made of."""
    plain = files.select("stem", without_front_matter(F.col("body")).alias("body"))
    rows = sections(plain, ["stem"]).where(F.length("body") >= least)
    text = F.left(F.concat(F.col("stem"), F.lit(" — "), F.col("heading"), F.lit("\n"), F.col("body")), F.lit(most))
    key = F.concat(F.lit(f"{prefix}/"), F.col("stem"), F.lit(".md#"), F.coalesce(F.nullif("heading", F.lit("")), F.lit("intro")))
    return rows.select(key.alias("key"), text.alias("text")).withColumn("hash", F.left(F.md5("text"), F.lit(12)))


def rule_category(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The category of the first rule of which the text holds a keyword; null without one."""
    low = F.lower(text)
    hit = lambda words: reduce(Column.__or__, [F.contains(low, F.lit(w.lower())) for w in words])
    return F.coalesce(*[F.when(hit(words), F.lit(category)) for category, words in rules], F.lit(None).cast("string"))


def category_signal(title: Column, tags: Column, summary: Column) -> Column:
    """Title, tags and summary: a whole text would hold every rule's words."""
    return F.concat_ws("\n", title, F.array_join(tags, ", "), F.left(F.regexp_replace(summary, r"\s+", " "), F.lit(300)))


def canonical_category(category: Column) -> Column:
    """Without the number before it."""
    return F.regexp_replace(F.lower(F.trim(category)), r"^[0-9]{2}-", "")


def with_category(body: Column, category: Column) -> Column:
    """The first category field replaced; where there is none, put first into the front matter."""
    field = F.concat(F.lit("category: "), category)
    before, after = F.regexp_extract(body, r"\A((?s:.*?))(?m:^category:[^\n]*$)", 1), F.regexp_extract(body, r"\A(?s:.*?)(?m:^category:[^\n]*$)((?s:.*))\z", 1)
    none = F.concat(F.regexp_extract(body, r"\A((?s:.*?)---\n)", 1), F.when(F.contains(body, F.lit("---\n")), F.concat(field, F.lit("\n"))).otherwise(""), F.regexp_replace(body, r"\A(?s:.*?)---\n", ""))
    return F.when(F.coalesce(category, F.lit("")) == "", body).when(body.rlike("(?m)^category:[^\\n]*$"), F.concat(before, field, after)).otherwise(none)


