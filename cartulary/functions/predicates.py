"""Filters and gates as boolean, label or reason columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.config import DEFAULT, Settings
from cartulary.functions.text import CJK, clean_summary, information_length, text_or_empty

# fixed values: markers of text that no person wrote
NOISE = ("heartbeat", "heartbeat_ok", "assistant: heartbeat_ok", "cron:", "cron jobs executed", "cron_jobs_executed", "self_review_sent", "hn_digest_sent", "delivery", "write a dream diary entry", "do not run the command again", "async command did not run", "a background task completed", "queued user message from a previous", "assistant: no_reply", "assistant turn failed before producing content", "image2_skill_autogrow_failed", "system echo", "system (")
# fixed values: pages that hold no article, as they stand in the text; and exports of such
JUNK = ("Don't miss what's happening", "People on X are the first to know", "Log in to X", "Sign in to X", "JavaScript is not available")
BAD_EXPORT = ("Don’t miss what’s happening", "Sign in to X", "Create account", "Trending now", "Warning: This page maybe not yet fully loaded", "Target URL returned error 404")
# fixed values: texts that stand in for one
PLACEHOLDERS = ("", "待整理", "待補充", "tbd", "todo", "n/a", "untitled", "(untitled)")
# fixed values: fields of a finished card
CARD_TYPES = ("x-knowledge-card", "knowledge-card")
CARD_SOURCES = ("x-bookmark", "youtube", "github_fork", "github_star", "local-paper", "pubmed")
# fixed values: messages that need no answer from the store
ACKNOWLEDGEMENTS = ("ok", "好", "收到", "謝謝", "thanks", "好的", "嗯", "哦", "喔")
GREETINGS = ("^哈+$", "^哈哈", "^早安", "^晚安", "^午安", "^你好$", "^hi$", "^hello$", "^嗨$")
SUPPRESS = ("^哈+$", "^哈哈", "早安", "晚安", "午安", "^幫我翻譯", "^翻譯[一下這個]", "^幫我算", "^計算", r"^寫一?個\s*(function|函?數|程式|腳本|class)", "^你好$", "^hi$", "^hello$")
# fixed values: what a message wants, and what wants nothing
INTENTS = {"howto": "怎麼|如何|workflow|sop|流程|規劃|設計|做法|框架|framework", "case_study": "案例|參考|靈感|對照|有沒有.*類似|值得抄|case study", "strategy": "值不值得|要不要|方向|策略|比較|優先|下一步|decision"}
NEGATIVE = r"(?i)哈+|哈哈|早安|晚安|謝謝|收到|ok$|好$"
#: Words that make a short message worth an answer; a store adds names of its own.
DOMAINS = ("知識庫", "wiki", "recall", "agent", "llm", "workflow", "automation")
GENERIC_TAGS = ("general", "misc", "other", "note", "todo", "x", "article")


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.contains(low, F.lit(terms[0]))
    for t in terms[1:]:
        found = found | F.contains(low, F.lit(t))
    return found


def allowed(sensitivity: Column, namespace: Column, asked: str) -> Column:
    """Public rows are everybody's; others their namespace's; rows without one those of 'private'."""
    own = F.nullif(text_or_empty(namespace), F.lit(""))
    return (F.lower(F.coalesce(F.nullif(sensitivity, F.lit("")), F.lit("private"))) == "public") | F.when(own.isNotNull(), own == asked).otherwise(F.lit(asked == "private"))


def valid_source_url(url: Column) -> Column:
    """http(s), and on two hosts of statuses only with the 15 to 20 digits of one."""
    u = text_or_empty(url)
    status = u.rlike(r"https?://(?:x|twitter)\.com/[^\s/]+/status/[0-9]{15,20}(?:\b|/|\?)") | u.rlike(r"https?://x\.com/i/status/[0-9]{15,20}(?:\b|/|\?)")
    on_host = F.contains(u, F.lit("x.com")) | F.contains(u, F.lit("twitter.com"))
    return u.rlike("^https?://") & (~on_host | status)


def _title_kind(title: Column) -> dict[str, Column]:
    t = text_or_empty(title)
    return {"none": t == "", "numeric": t.rlike("^[0-9]{15,20}$"), "tweet": F.lower(t).rlike(r"^tweet\s+[0-9]{15,20}$"), "dated": t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}-"), "size": F.length(t)}


def _present(pairs: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())


def low_signal(summary: Column, s: Settings = DEFAULT) -> Column:
    return clean_summary(summary).isin(*s.low_signal_summaries)


def exclusion_reasons(title: Column, summary: Column, url: Column, s: Settings = DEFAULT) -> Column:
    t, low = _title_kind(title), low_signal(summary, s)
    return _present([((text_or_empty(url) != "") & ~valid_source_url(url), "invalid_source_url"), (t["dated"] & low, "date_slug_low_signal"), (t["numeric"] & low, "numeric_title_low_signal"), (t["tweet"] & low, "tweet_numeric_low_signal")])


def item_issues(title: Column, summary: Column, url: Column, path: Column, excluded: Column, duplicate_of: Column, s: Settings = DEFAULT) -> Column:
    """What an audit finds wrong with an item, in the order of the checks."""
    t, u = _title_kind(title), text_or_empty(url)
    of_title = F.when(t["none"], "missing_title").when(t["numeric"], "numeric_title").when(t["tweet"], "tweet_numeric_title").when(t["dated"] & (t["size"] < 42), "date_slug_title").when(t["size"] < 8, "very_short_title")
    of_summary = F.when(low_signal(summary, s), "low_signal_summary").when(F.length(clean_summary(summary)) < 18, "very_short_summary")
    of_url = F.when(u == "", "missing_source_url").when(~valid_source_url(u), "invalid_source_url")
    legacy = path.rlike("(^|/)legacy-")
    rest = [F.when(legacy, "legacy_card"), F.when(F.startswith(path, F.lit("/")), "absolute_relative_path"), F.when(F.coalesce(excluded, F.lit(False)), "excluded"), F.when(F.coalesce(duplicate_of, F.lit("")) != "", "duplicate_entry")]
    return F.filter(F.array(of_title, of_summary, of_url, *rest), lambda x: x.isNotNull())


def hidden_result(title: Column, summary: Column, category: Column, excluded: Column, url: Column, s: Settings = DEFAULT) -> Column:
    t, low = _title_kind(title), low_signal(summary, s)
    generic = F.lower(text_or_empty(category)).isin(*s.generic_categories)
    return F.coalesce(excluded, F.lit(False)) | (low & (text_or_empty(url) == "")) | t["numeric"] | (t["tweet"] & low) | (generic & low)


def _held(text: Column, marks: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m)))


def is_junk_page(text: Column) -> Column:
    """A junk marker in what stands after the front matter."""
    body = F.when(F.startswith(text, F.lit("---")), F.regexp_replace(text, r"\A---(?s:.*?)---", "")).otherwise(text)
    return _held(F.coalesce(body, F.lit("")), JUNK) > 0


def is_low_value(text: Column, marks: tuple[str, ...] = BAD_EXPORT) -> Column:
    """Two or more markers, or under 80 characters."""
    t = F.coalesce(text, F.lit(""))
    return (_held(t, marks) >= 2) | (F.length(F.trim(t)) < 80)


def is_bad_export(text: Column) -> Column:
    return _held(F.coalesce(text, F.lit("")), BAD_EXPORT) > 0


def is_placeholder(text: Column) -> Column:
    return F.lower(text_or_empty(text)).isin(*PLACEHOLDERS)


def needs_title(title: Column) -> Column:
    """A number, or 'tweet' and a number."""
    return F.lower(text_or_empty(title)).rlike(r"^(?:tweet\s+)?[0-9]{15,20}$")


def skipped_path(path: Column) -> Column:
    """Dot-files, indexes, generated files, backups and exports."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.startswith(name, F.lit(".")) | name.isin("INDEX.md", "README.md") | name.rlike(r"search_index|vector_index|\.bak$") | path.rlike("(?:^|/)notebooklm_exports/")


def valid_orphan(body: Column, card_id: Column, url: Column, title: Column, summary: Column) -> Column:
    """Whether a card without an index row may get one: front matter, type, source type, address, id, and no mere placeholders."""
    field = lambda k: F.trim(F.regexp_extract(body, rf'(?m)^{k}:\s*"?([^"\n]+)"?\s*$', 1))
    plain = F.regexp_replace(body, r"<think>(?s:.*?)</think>", "")
    kind = field("source_type")
    status = url.rlike(r"/(?:status|i/status)/[0-9]{15,20}")
    return (
        F.startswith(F.btrim(plain, F.lit("\n ")), F.lit("---")) & field("type").isin(*CARD_TYPES) & kind.isin(*CARD_SOURCES) & url.rlike(r"^https?://[^\s/]+")
        & ~((kind == "x-bookmark") & ~status) & ~((kind != "x-bookmark") & (card_id == "")) & ~(is_placeholder(title) & is_placeholder(summary))
    )


def graph_eligible(title: Column, summary: Column, category: Column) -> Column:
    return (F.length(F.coalesce(title, F.lit(""))) > 5) & (F.coalesce(summary, F.lit("")) != "") & (F.coalesce(category, F.lit("")) != "")


def absorbable(body: Column) -> Column:
    """Front matter at the start, and no redirect in the first 200 characters."""
    start = F.left(body, F.lit(200))
    return F.startswith(start, F.lit("---")) & ~F.contains(start, F.lit("Redirect:"))


def bounded(value: Column, least: int, most: int, default: int) -> Column:
    """(value, error) of a number given as text in JSON: whole numbers within the bounds; null takes the default."""
    v = F.trim(value)
    whole = v.rlike("^-?[0-9]+$")
    n = F.when(whole, v.cast("long"))
    error = F.when(v.isNull() | (v == "null"), None).when(~whole, "must be an integer").when((n < least) | (n > most), f"must be between {least} and {most}")
    return F.struct(F.when(v.isNull() | (v == "null"), F.lit(default)).otherwise(F.when(error.isNull(), n)).cast("long").alias("value"), error.alias("error"))


def is_noise(*parts: Column) -> Column:
    return any_of(F.concat_ws("\n", *parts), NOISE)


def good_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*GENERIC_TAGS) & ~t.rlike("^[0-9]+$"))


def suppressed(text: Column, domains: tuple[str, ...] = DOMAINS) -> Column:
    """Acknowledgements, messages of eight characters or fewer (CJK ones count three) that name no domain, and what needs no recall."""
    t = F.lower(text_or_empty(text))
    return ((F.length(t) <= 4) & t.isin(*ACKNOWLEDGEMENTS)) | ((information_length(t) <= 8) & ~any_of(t, domains)) | text.rlike("(?i)" + "|".join(SUPPRESS))


def skip_reason(text: Column) -> Column:
    t = F.lower(text_or_empty(text))
    return F.when((F.length(t) <= 4) & t.isin(*ACKNOWLEDGEMENTS), "acknowledgement").when(text.rlike("(?i)" + "|".join(GREETINGS)), "greeting").otherwise("")


def intents(text: Column) -> Column:
    return _present([(text.rlike(f"(?i){p}"), n) for n, p in INTENTS.items()])


def wants_nothing(text: Column) -> Column:
    t = F.lower(text_or_empty(text))
    return ((F.length(t) <= 8) & t.isin("ok", "好", "收到", "謝謝", "thanks")) | text.rlike(NEGATIVE)


def recall_gate(text: Column, boost: Column, least: float = 0.35) -> Column:
    """Why recall runs or not: empty_input, casual_or_ack, intents and topic boost, or no_trigger."""
    reasons = F.concat_ws(";", F.when(F.size(intents(text)) > 0, F.concat(F.lit("intent:"), F.array_join(intents(text), ","))), F.when(boost >= least, F.concat(F.lit("topic_boost:"), boost.cast("string"))))
    return F.when(text_or_empty(text) == "", "empty_input").when(wants_nothing(text), "casual_or_ack").when(reasons != "", reasons).otherwise("no_trigger")


def above_floor(similarity: Column, floor: float) -> Column:
    """Unknown is not irrelevant: a null similarity passes."""
    return similarity.isNull() | (similarity >= floor)


def promotable(status: Column, episodes: Column, traces: Column, s: Settings = DEFAULT) -> Column:
    return (status != "rejected") & (F.size(F.array_distinct(episodes)) >= s.promote_episodes) & (F.size(traces) >= s.promote_traces)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)
