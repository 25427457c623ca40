"""Remote collections that come in pages, through an injected transport: numbered pages as a data source, and chains of cursors that resume.

A transport is a picklable function from a request (a dictionary) to a response; it may raise.
Pages are fetched by tasks; the driver asks only how many there are.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[dict], object]
#: Most results that one search may ask for, and how many it asks for each one that is wanted.
SEARCH_MOST, SEARCH_TIMES = 500, 3
#: Partitions of a collection, at most: where it has more pages, a task asks for several, one after another.
PARTITIONS = 256
PAGE_SCHEMA = "page int, position int, body string, error string"
CHAIN_SCHEMA = "feed string, page int, ids array<string>, next string, error string"


def tried(transport: Transport, request: dict, tries: int = 3, wait: float = 0.0):
    """The response; after `tries` failures, the last error. Waits wait, 2 * wait, 4 * wait seconds between."""
    for n in range(tries):
        try:
            return transport(request)
        except Exception:  # noqa: BLE001 - a transport may fail in any way
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)


# --- numbered pages -----------------------------------------------------------------------------


def article_search(query: str, limit: int, since_year: int | None = None) -> dict:
    """The request of a search for open articles: `limit` are wanted, and more are asked for, as some turn out to be of no use."""
    # fixed values: the service's words for open articles and for a range of years
    years = f" AND {since_year}:2030[pdat]" if since_year else ""
    return {"db": "pmc", "term": f"({query}) AND pmc open access[filter]{years}", "retmax": min(SEARCH_TIMES * limit, SEARCH_MOST), "retmode": "json", "sort": "relevance"}


class _Page(InputPartition):
    def __init__(self, pages: range):
        super().__init__(pages)


class _Pages(DataSourceReader):
    def __init__(self, transport: Transport, request: dict, size: int, tries: int, wait: float):
        self.transport, self.request, self.size, self.tries, self.wait = transport, request, size, tries, wait

    def partitions(self) -> list[InputPartition]:
        total = int(tried(self.transport, {**self.request, "start": 0, "size": 0}, self.tries, self.wait)["total"])
        total = min(total, int(self.request.get("retmax", total)))
        pages = -(-total // self.size)
        each = max(1, -(-pages // PARTITIONS))
        return [_Page(range(k, min(k + each, pages))) for k in range(0, pages, each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no partitions
            return
        for page in partition.value:
            yield from self.page(page)

    def page(self, page: int) -> Iterator[tuple]:
        start = page * self.size
        size = min(self.size, int(self.request.get("retmax", start + self.size)) - start)
        try:
            items = tried(self.transport, {**self.request, "start": start, "size": size}, self.tries, self.wait)["items"]
        except Exception as e:  # noqa: BLE001 - a page that fails is a row that says so
            yield page, None, None, f"{type(e).__name__}: {e}"
            return
        for k, item in enumerate(items):
            yield page, k, item if isinstance(item, str) else json.dumps(item, ensure_ascii=False), None


def page_source(transport: Transport, name: str = "pages") -> type[DataSource]:
    """A data source of numbered pages over a transport, to be registered with spark.dataSource.register.

    Options: request (JSON), size (results a page), tries, wait. Each page is a partition, or up to
    PARTITIONS of them hold the pages, in order. The
    transport answers {"total"} to a request of size 0 and {"items"} to others. A row is an item, a
    string or JSON; a page that fails after all tries is one row with its error, and the others stay.
    A collection of no results has no rows.
    """

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            o = self.options
            return _Pages(transport, json.loads(o.get("request", "{}")), int(o.get("size", 100)), int(o.get("tries", 3)), float(o.get("wait", 0)))

    return PagedSource


def read_pages(spark: SparkSession, transport: Transport, request: dict, size: int = 100, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """(page, position, body, error) of all pages that the request finds."""
    spark.dataSource.register(page_source(transport))
    return spark.read.format("pages").options(request=json.dumps(request), size=size, tries=tries, wait=wait).load()


def readme_preview(content: Column, most: int = 500) -> Column:
    """The start of a README that comes in base64, without marks of headings and with links as their texts; empty where there is none or it is broken."""
    clean = F.regexp_replace(F.coalesce(content, F.lit("")), r"\s", "")
    good = clean.rlike(r"\A([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    text = F.try_validate_utf8(F.unbase64(F.when(good, clean)).cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, r"#+\s*", ""), r"\[([^\]]+)\]\([^)]+\)", "$1")
    text = F.regexp_replace(text, r"!\[.*?\]\(.*?\)", "")
    return F.coalesce(F.regexp_replace(F.left(text, F.lit(most)), r"\A\s+|\s+\z", ""), F.lit(""))


# --- chains of cursors --------------------------------------------------------------------------


def _entries(node) -> Iterator[dict]:
    for key, value in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
        if key == "entries" and isinstance(value, list):
            yield from (e for e in value if isinstance(e, dict))
        yield from _entries(value)


def timeline_page(response: dict) -> tuple[list[str], str | None]:
    """Ids and the bottom cursor of a timeline's page, whose entries may lie at any depth of its data."""
    ids, bottom = [], None
    for entry in _entries(response.get("data", {})):
        mark, content = entry.get("entryId", ""), entry.get("content") or {}
        if found := re.match(r"tweet-(\d+)", mark):
            ids.append(found[1])
        if content.get("entryType") == "TimelineTimelineCursor" and (content.get("cursorType") == "Bottom" or "cursor-bottom" in mark):
            bottom = content.get("value") or bottom
    return ids, bottom


def crawl_state(pages: DataFrame) -> DataFrame:
    """(feed, pages, cursor, completed, errors) from the pages kept: where each feed's chain goes on, and whether it ended. An empty page ends a chain and is not counted."""
    good = F.col("error").isNull()
    last = F.max_by(F.struct("next", F.size("ids").alias("n")), F.when(good, F.col("page")))
    state = pages.groupBy("feed").agg(F.count_if(good & (F.size("ids") > 0)).alias("pages"), last.alias("last"), F.count_if(~good).alias("errors"))
    ended = F.coalesce(F.col("last").isNotNull() & (F.col("last.next").isNull() | (F.col("last.n") == 0)), F.lit(False))
    return state.select("feed", "pages", F.when(~ended, F.col("last.next")).alias("cursor"), ended.alias("completed"), "errors")


def crawl(
    feeds: DataFrame,
    transport: Transport,
    folder: str,
    *,
    most: int = 50,
    count: int = 20,
    parse: Callable[[object], tuple[list[str], str | None]] = timeline_page,
    tries: int = 1,
    wait: float = 0.0,
    restart: bool = False,
) -> DataFrame:
    """Up to `most` further pages of each feed (column feed), kept below folder; gives all pages that are kept.

    Each feed is a chain: a page names the cursor of the next. Chains run side by side, a task
    for each part of the feeds; what a task fetches goes to the folder by Spark's commit, so a lost
    executor costs that task's pages and a run that dies leaves the folder as it was. The next
    run goes on from the last cursor kept. A page that fails is a row with its error and ends that
    feed's turn: the next run asks for the same page again. A page without ids, or without a
    cursor, ends the chain for good. Null feeds are left out; equal feeds are one.
    """
    spark = feeds.sparkSession
    spark.createDataFrame([], CHAIN_SCHEMA).write.mode("overwrite" if restart else "append").parquet(folder)
    kept = lambda: spark.read.schema(CHAIN_SCHEMA).parquet(folder)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("feed", pa.string()), ("page", pa.int32()), ("ids", pa.list_(pa.string())), ("next", pa.string()), ("error", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                page, cursor, found = row["page"], row["cursor"], []
                for _ in range(most):
                    page += 1
                    request = {"feed": row["feed"], "count": count, **({"cursor": cursor} if cursor else {})}
                    try:
                        ids, cursor = parse(tried(transport, request, tries, wait))
                    except Exception as e:  # noqa: BLE001 - kept as the page's error
                        found.append((row["feed"], page, [], None, f"{type(e).__name__}: {e}"))
                        break
                    found.append((row["feed"], page, ids, cursor, None))
                    if not ids or not cursor:
                        break
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), fields)], schema=fields)

    todo = feeds.select(F.col("feed").cast("string").alias("feed")).where("feed is not null").distinct().join(crawl_state(kept()), "feed", "left")
    todo = todo.where(~F.coalesce("completed", F.lit(False))).select("feed", F.coalesce("pages", F.lit(0)).cast("int").alias("page"), "cursor")
    # written beside what it is read from, then added to it
    part = f"{folder.rstrip('/')}-run"
    todo.repartition("feed").mapInArrow(fetch, CHAIN_SCHEMA).write.mode("overwrite").parquet(part)
    spark.read.schema(CHAIN_SCHEMA).parquet(part).write.mode("append").parquet(folder)
    return kept()


def wanted_posts(posts: DataFrame, done: DataFrame | None = None, *, since: Column | None = None) -> DataFrame:
    """Distinct ids of posts (id, created_at such as 'Wed Oct 10 20:19:24 +0000 2018') that are not done (column id).

    All of them, or those created at `since` or later: there, a post without a date that can be read goes.
    Null and blank ids go.
    """
    rows = posts.withColumn("id", F.trim(F.col("id").cast("string"))).where("id <> ''")
    if since is not None:
        # fixed form: weekday, month, day, time, zone, year; the weekday is not looked at
        parts = F.regexp_extract(F.col("created_at"), r"\A[A-Z][a-z]{2} ([A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4})\z", 1)
        rows = rows.where(F.try_to_timestamp(parts, F.lit("MMM d HH:mm:ss xx yyyy")) >= since)
    ids = rows.select("id").distinct()
    return ids if done is None else ids.join(done.select(F.col("id").cast("string").alias("id")), "id", "left_anti")
