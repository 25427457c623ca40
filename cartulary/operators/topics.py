"""Topic pages: sources, registry, health, staged candidates and what is written into pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import let

# fixed values: the section of sources, the default section, and the fields that come first
SOURCES = r"(?s)\n## 來源\n(.*?)(?=\n## |\z)"
CORE = "核心概念"
ORDER = ("title", "tags", "sources", "last_updated", "status")


def field(body: Column, key: str) -> Column:
    return F.trim(F.regexp_extract(body, rf"(?m)^{key}:[ \t]*(.*)$", 1))


def has_front_matter(body: Column) -> Column:
    return body.rlike(r"\A---\n(?s:.*?)\n---\n")


def source_urls(body: Column) -> Column:
    """Distinct addresses of the section of sources."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_extract(body, SOURCES, 1), F.lit(r"\((https?://[^)]+)\)"), F.lit(1)))


def new_sources(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards (slug, url, title, date) that their page (slug, body) does not list yet: one of each address, the newest (of equals by title)."""
    known = pages.select("slug", F.explode(source_urls(F.col("body"))).alias("url"))
    best = cards.groupBy("slug", "url").agg(F.max(F.struct("date", "title")).alias("b")).select("slug", "url", "b.title", "b.date")
    return best.join(known, ["slug", "url"], "left_anti").join(pages.select("slug"), "slug", "left_semi")


def rendered(fields: Column) -> Column:
    """Front matter of a map of fields: the known ones first, then the others by name."""
    own = F.filter(F.array(*[F.lit(k) for k in ORDER]), lambda k: F.map_contains_key(fields, k))
    rest = F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in ORDER])))
    lines = F.transform(F.concat(own, rest), lambda k: F.concat(k, F.lit(": "), F.element_at(fields, k)))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---"))


def with_sources(body: Column, lines: Column, total: Column, today: Column) -> Column:
    """The page with lines appended to its sources, their number and the day in its front matter. A page without front matter, a redirect and one without sources stay."""
    stays = ~has_front_matter(body) | F.contains(F.left(body, F.lit(200)), F.lit("Redirect:")) | ~body.rlike(SOURCES)
    block = F.regexp_extract(body, SOURCES, 1)
    before, after = F.regexp_extract(body, r"(?s)\A(.*?)\n## 來源\n", 1), F.regexp_extract(body, r"(?s)\A.*?\n## 來源\n.*?(\n## .*|)\z", 1)
    counted = F.regexp_replace(F.regexp_replace(before, r"(?m)^sources:.*$", F.concat(F.lit("sources: "), total.cast("string"))), r"(?m)^last_updated:.*$", F.concat(F.lit("last_updated: "), today))
    return F.when(stays, body).otherwise(F.concat(counted, F.lit("\n## 來源\n"), F.regexp_replace(block, r"\s+\z", ""), F.lit("\n"), lines, F.lit("\n"), after))


def with_entry(body: Column, section: Column, entry: Column, source_date: Column, today: Column) -> Column:
    """The page with an entry at the head of a section, marked as self-derived; a section that is not there is added at the end."""
    line = F.concat(F.lit("- "), entry, F.lit(" *(self-derived · memory/"), source_date, F.lit(".md)*"))
    head = F.concat(F.lit("## "), section)
    at = F.locate("\u0001", F.replace(body, head, F.lit("\u0001")))
    inserted = F.concat(F.left(body, at - 1), head, F.lit("\n\n"), line, F.substr(body, at + F.length(head)))
    added = F.concat(F.regexp_replace(body, r"\s+\z", ""), F.lit("\n\n"), head, F.lit("\n\n"), line, F.lit("\n"))
    return F.regexp_replace(F.when(F.contains(body, head), inserted).otherwise(added), r"last_updated:\s*\S+", F.concat(F.lit("last_updated: "), today))


def registry_line(slug: Column, body: Column) -> Column:
    """A page's line in the registry; null without front matter."""
    own = lambda k, rest: F.coalesce(F.nullif(field(body, k), F.lit("")), rest if isinstance(rest, Column) else F.lit(rest))
    line = F.concat(F.lit("- ["), own("title", slug), F.lit("](topics/"), slug, F.lit(".md) — | status: "), own("status", "draft"), F.lit(" | sources: "), own("sources", "0"), F.lit(" | last_updated: "), own("last_updated", "unknown"))
    return F.when(has_front_matter(body), line)


def page_health(pages: DataFrame, today: Column, stale_days: int = 60) -> DataFrame:
    """Of each page (slug, body): days since its update, why it is stale, source lines, entries by origin, and sections."""
    b = F.col("body")
    day = field(b, "last_updated")
    days = F.datediff(today, F.try_to_date(day))
    stale = F.when(day == "", "no last_updated").when(days.isNull(), F.concat(F.lit("unparseable date: "), day)).when(days > stale_days, F.concat(days.cast("string"), F.lit(" days ago")))
    entries = F.filter(F.split(b, r"\n"), lambda x: x.rlike("^- .+") & ~F.contains(x, F.lit("last_updated")))
    said = let(entries, lambda e: F.struct(F.size(e).alias("entries"), F.size(F.filter(e, lambda x: x.rlike(r"\*\([^)]*memory/[0-9]{4}-[0-9]{2}-[0-9]{2}"))).alias("conversation")))
    out = pages.select("slug", days.alias("days"), stale.alias("stale"), F.regexp_count(b, F.lit(r"(?m)^\s*- \[")).alias("source_lines"), said.alias("s"), F.regexp_count(b, F.lit(r"(?m)^## .+")).alias("sections"))
    return out.select("slug", "days", "stale", "source_lines", "s.entries", "s.conversation", (F.col("s.entries") - F.col("s.conversation")).alias("external"), "sections")


def staged(blocks: Column) -> Column:
    """A staged candidate's fields, from its block of text."""
    own = lambda k: F.trim(F.regexp_extract(blocks, rf"\*\*{k}:\*\* (.+)", 1))
    status = F.when(blocks.rlike(r"(?i)\*\*Status:\*\*.*\[x\] approve"), "approved").when(blocks.rlike(r"(?i)\*\*Status:\*\*.*\[x\] skip"), "skipped").otherwise("pending")
    text = F.regexp_extract(blocks, r"(?s)- \*\*Status:\*\*[^\n]*\n(.*?)(?=\n- \*\*|\n---|\z)", 1)
    lines = F.array_join(F.filter(F.split(text, r"\n"), lambda x: F.trim(x) != ""), "\n")
    return F.struct(
        own("Topic").alias("topic"), F.coalesce(F.nullif(own("Section"), F.lit("")), F.lit(CORE)).alias("section"), F.coalesce(F.nullif(F.regexp_extract(blocks, r"\*\*Confidence:\*\* (\w+)", 1), F.lit("")), F.lit("medium")).alias("confidence"),
        F.coalesce(F.nullif(own("Source date"), F.lit("")), F.lit("unknown")).alias("source_date"), status.alias("status"), F.trim(lines).alias("text"),
    )


def approved(candidate: Column, all_of_them: bool = False, high: bool = False) -> Column:
    """Whether a staged candidate is applied: approved (or all, or those of high confidence), with a text, and a topic that is not new."""
    chosen = (candidate["status"] == "approved") | F.lit(all_of_them) | (F.lit(high) & (candidate["confidence"] == "high"))
    return chosen & (candidate["text"] != "") & (candidate["topic"] != "") & ~F.startswith(candidate["topic"], F.lit("[NEW:"))


def decided(block: Column, approve: Column) -> Column:
    """The block with its status line as decided."""
    mark = F.when(approve, "[x] approve  [ ] skip").otherwise("[ ] approve  [x] skip")
    return F.regexp_replace(block, r"(\*\*Status:\*\*)[^\n]*", F.concat(F.lit("$1 "), mark))


def promoted_card(value: Column, candidate_id: Column, episodes: Column, traces: Column, created: Column) -> Column:
    """A promoted candidate as a card: only the parts that it can fill, marked as self-derived."""
    e, t = F.array_sort(F.array_distinct(episodes)), F.slice(F.array_sort(F.array_distinct(traces)), 1, 10)
    listed = F.concat(F.lit("["), F.array_join(F.transform(e, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    head = [F.lit("---"), F.concat(F.lit("title: "), F.left(value, F.lit(80))), F.lit("category: 99-general"), F.lit("source_type: conversation"), F.lit("provenance: self-derived"), F.lit("claim_level: Inference"), F.concat(F.lit("episodes: "), listed), F.concat(F.lit("candidate_id: "), candidate_id), F.concat(F.lit("created: "), created), F.lit("---")]
    told = [F.lit(""), F.concat(F.lit("# "), F.left(value, F.lit(120))), F.lit(""), value, F.lit(""), F.concat(F.size(e).cast("string"), F.lit(" episodes")), F.lit("")]
    marks = F.concat(F.transform(e, lambda x: F.concat(F.lit("- Episode: `"), x, F.lit("`"))), F.transform(t, lambda x: F.concat(F.lit("- Trace: `"), x, F.lit("`"))))
    return F.array_join(F.concat(F.array(*head, *told), marks), "\n")


def without_internal(text: Column) -> Column:
    """A page without its sections about itself."""
    marked = F.split(F.regexp_replace(text, r"(?m)^(#{1,3} )", "\u0001$1"), "\u0001")
    own = r"(?i)\A#{1,3}\s*(?:未解決|待辦|TODO|這頁自身|系統狀態|治理|已知問題|open issue|roadmap 備注)"  # fixed values: such headings
    return F.array_join(F.filter(marked, lambda x: ~x.rlike(own)), "")


def topic_page(page: Column, name: Column) -> Column:
    """(title, description, sections): a topic page as a struct.

    The title is the front matter's, else the first heading's of one or two marks, else the name;
    the description the first paragraph that is no heading, 200 characters without marks. A section
    of two marks has its heading, its items (bold headlines of 4 to 80 characters with the line
    below, six at most), and its plain text of 300 characters.
    """
    bare = lambda c: F.regexp_replace(c, "[*`]", "")
    body = F.regexp_replace(page, r"\A---(?s:.*?)---\n", "")
    own, head = F.trim(F.regexp_extract(page, r"(?m)^title:\s*(.+)$", 1)), F.trim(F.regexp_extract(page, r"(?m)^#{1,2}\s+(.+)$", 1))
    title = F.when(own != "", own).when(head != "", head).otherwise(name)
    paragraphs = F.filter(F.transform(F.split(body, r"\n{2,}"), lambda p: F.btrim(p, F.lit("\n "))), lambda p: (p != "") & ~F.startswith(p, F.lit("#")))
    parts = F.split(F.regexp_replace(F.concat(F.lit("\n"), body), r"\n##\s+", "\u0001"), "\u0001")

    def section(part: Column) -> Column:
        first = F.split(part, "\n", 2)
        content = F.btrim(F.coalesce(F.get(first, 1), F.lit("")), F.lit("\n "))
        items = F.slice(F.regexp_extract_all(content, F.lit(r"\*\*([^*\n]{4,80})\*\*\n+([^\n#*][^\n]*)"), F.lit(0)), 1, 6)
        return F.struct(F.trim(first[0]).alias("heading"), items.alias("items"), F.left(bare(content), F.lit(300)).alias("plain"))

    sections = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), section)
    return F.struct(title.alias("title"), F.left(bare(F.coalesce(F.get(paragraphs, 0), F.lit(""))), F.lit(200)).alias("description"), sections.alias("sections"))
