"""Remote collections in pages (S24, S31 to S34, I06, I12). The transports stand in for services: they serve what Spark wrote of the tables."""

from __future__ import annotations

import heapq
import re

import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.plans.base import query
from cartulary.sources import paged, store
from cartulary.sources.records import table


#: Pages that lie in one folder of a shelf: of a listing, whose pages tasks ask for side by side, and of a feed, which is asked for in order.
LISTED, FED = 8, 64


class Shelf:
    """Tables in folders name=value, as a service would hold them."""

    def __init__(self, folder: str):
        self.folder = folder
        self.held: tuple[str, dict[int, list[dict]]] = "", {}

    def at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.folder))

    def open(self) -> ds.Dataset:
        disk, root = self.at()
        return ds.dataset(root, filesystem=disk, format="parquet", partitioning="hive")

    def rows(self, part: str, page: int) -> list[dict]:
        """The rows of a page, which a part holds with others; none if there is no such page. The last part read is kept, as the next page is most often in it."""
        if self.held[0] != part:
            disk, root = self.at()
            found: dict[int, list[dict]] = {}
            if disk.get_file_info(f"{root}/{part}").type != fs.FileType.NotFound:
                for row in pq.read_table(f"{root}/{part}", filesystem=disk, partitioning=None).to_pylist():
                    found.setdefault(row["page"], []).append(row)
            self.held = part, found
        return self.held[1].get(page, [])

    def parts(self) -> list[str]:
        disk, root = self.at()
        return [f.base_name for f in disk.get_file_info(fs.FileSelector(root)) if "=" in f.base_name]


class Articles(Shelf):
    """A search: articles of the term's years, by rank."""

    def __call__(self, request: dict) -> dict:
        since = int(re.search(r"(\d+):2030\[pdat\]", request["term"])[1])
        found = self.open().to_batches(filter=ds.field("year") >= since, columns=["doc_id"])
        if request["size"] == 0:
            return {"total": sum(b.num_rows for b in found)}
        best = heapq.nsmallest(request["start"] + request["size"], (i for b in found for i in b.column(0).to_pylist()))
        return {"items": [str(i) for i in best[request["start"] :]]}


@query(
    "SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM (SELECT doc_id FROM documents WHERE 2015 + doc_id % 10 >= 2020 ORDER BY doc_id LIMIT 500) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) WHERE rank <= 200"
)
def paged_articles(spark, sf_dir):
    """Of what a search for articles since 2020 finds, the best 200 that are not saved yet. (The limits are the search's.)"""
    folder = store.new_folder(spark, "articles")
    store.write(table(spark, sf_dir, "documents").select("doc_id", (2015 + F.col("doc_id") % 10).alias("year")), folder, by=["year"])
    found = paged.read_pages(spark, Articles(folder), paged.article_search("sleep", 200, 2020), size=50)
    ids = found.where("error is null").select("page", "position", F.col("body").cast("long").alias("doc_id"))
    new = ids.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    at = F.row_number().over(Window.orderBy("page", "position"))  # over 500 rows at most
    return new.select("doc_id", at.cast("long").alias("rank")).where("rank <= 200")


class Repositories(Shelf):
    """A listing of repositories, a hundred a page; some pages never come."""

    def __call__(self, request: dict) -> dict:
        if request["size"] == 0:
            last = max((int(p.split("=")[1]) for p in self.parts()), default=None)
            return {"total": 0 if last is None else 100 * (1 + max(b.column(0).to_numpy().max() for b in self.open().to_batches(filter=ds.field("shelf") == last, columns=["page"]) if b.num_rows))}
        page = request["start"] // 100
        if page % 5 == 3:
            raise TimeoutError("busy")
        return {"items": [{"id": r["doc_id"], "content": r["content"]} for r in self.rows(f"shelf={page // LISTED}", page)]}


@query(
    r"""SELECT doc_id // 100 AS page, doc_id, CASE WHEN doc_id % 11 = 0 THEN md5('') ELSE md5(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace('# ' || source || ' [' || lang || '](http://x.y/' || doc_id || ')' || chr(10) || text, '#+\s*', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '!\[.*?\]\(.*?\)', '', 'g'), 500), '^\s+|\s+$', '', 'g')) END AS preview, NULL AS error FROM documents WHERE doc_id // 100 % 5 <> 3
  UNION ALL SELECT DISTINCT doc_id // 100, NULL::BIGINT, NULL, 'TimeoutError: busy' FROM documents WHERE doc_id // 100 % 5 = 3"""
)
def paged_repositories(spark, sf_dir):
    """All pages of a listing, each asked for by itself, with previews of READMEs in base64; a page that does not come is a row that says so, and a README that is broken is empty."""
    folder = store.new_folder(spark, "repositories")
    text = F.concat(F.lit("# "), "source", F.lit(" ["), "lang", F.lit("](http://x.y/"), F.col("doc_id").cast("string"), F.lit(")\n"), "text")
    content = F.when(F.col("doc_id") % 11 == 0, "~broken~").otherwise(F.base64(F.encode(text, "UTF-8")))
    page = F.floor(F.col("doc_id") / 100)
    store.write(table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), page.alias("page"), F.floor(page / LISTED).alias("shelf")), folder, by=["shelf"])
    found = paged.read_pages(spark, Repositories(folder), {})
    item = F.from_json("body", "id long, content string")
    return found.withColumn("item", item).select(
        F.col("page").cast("long").alias("page"), F.col("item.id").alias("doc_id"), F.when(F.col("error").isNull(), F.md5(paged.readme_preview(F.col("item.content")))).alias("preview"), "error"
    )


class Timelines(Shelf):
    """Timelines, twenty posts a page; with flaky, the third page of every fifth account fails."""

    def __init__(self, folder: str, flaky: bool):
        super().__init__(folder)
        self.flaky = flaky

    def __call__(self, request: dict) -> dict:
        page = int(request.get("cursor", 0))
        if self.flaky and page == 2 and int(request["feed"].split("-")[1]) % 5 == 0:
            raise ConnectionError("gone")
        rows = self.rows(f"feed={request['feed']}/shelf={page // FED}", page)
        entries = [{"entryId": f"tweet-{r['post']}", "content": {}} for r in rows]
        if rows and rows[0]["more"]:
            entries.append({"entryId": "cursor-bottom-1", "content": {"entryType": "TimelineTimelineCursor", "value": str(page + 1)}})
        return {"data": {"timeline": {"instructions": [{"entries": entries}]}}}


@query(
    "SELECT 'acct-' || conv_id % 32 AS feed, ceil(count(*) / 20.0)::BIGINT AS pages, true AS completed, (CASE WHEN conv_id % 32 % 5 = 0 AND count(*) > 40 THEN 1 ELSE 0 END)::BIGINT AS errors, count(*) AS posts, sum(conv_id * 1000 + turn)::BIGINT AS total FROM conversations GROUP BY conv_id % 32"
)
def crawled_feeds(spark, sf_dir):
    """Accounts crawled in two runs, the first of four pages each and with failures; the second goes on from the cursors kept, to the end."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("acct-"), (F.col("conv_id") % 32).cast("string")).alias("feed"), (F.col("conv_id") * 1000 + F.col("turn")).alias("post"))
    w = Window.partitionBy("feed")
    c = c.withColumn("n", F.row_number().over(w.orderBy("post")) - 1).withColumn("all", F.count(F.lit(1)).over(w))
    page = F.floor(F.col("n") / 20)
    folder = store.new_folder(spark, "timelines")
    posts = store.write(c.select("feed", page.alias("page"), F.floor(page / FED).alias("shelf"), "post", (F.col("all") > 20 * (page + 1)).alias("more")), f"{folder}/served", by=["feed", "shelf"])
    feeds = posts.select("feed").distinct()
    paged.crawl(feeds, Timelines(f"{folder}/served", True), f"{folder}/kept", most=4)
    pages = paged.crawl(feeds, Timelines(f"{folder}/served", False), f"{folder}/kept", most=100_000)
    ids = pages.select("feed", F.explode("ids").alias("id")).distinct().groupBy("feed").agg(F.count(F.lit(1)).alias("posts"), F.sum(F.col("id").cast("long")).alias("total"))
    return paged.crawl_state(pages).join(ids, "feed").select("feed", "pages", "completed", "errors", "posts", "total")


@query(
    "SELECT DISTINCT (event_id // 2)::VARCHAR AS id FROM events WHERE event_id % 50 <> 0 AND date_trunc('second', ts) >= (SELECT date_trunc('second', max(ts)) FROM events) - INTERVAL 28 DAY AND event_id // 2 NOT IN (SELECT event_id // 2 FROM events WHERE value > 50 AND event_id IS NOT NULL)"
)
def recent_posts(spark, sf_dir):
    """Ids of the posts of the last 28 days by their date as text, once, without those that are done; a post whose date cannot be read goes."""
    e = table(spark, sf_dir, "events")
    key = F.floor(F.col("event_id") / 2).cast("string")
    told = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    posts = e.select(key.alias("id"), F.when(F.col("event_id") % 50 == 0, "soon").otherwise(told).alias("created_at"))
    since = F.lit(e.agg(F.date_trunc("second", F.max("ts")) - F.expr("interval 28 days")).first()[0])
    return paged.wanted_posts(posts, e.where("value > 50").select(key.alias("id")), since=since)
