"""Pages through a transport: requests, retries, failures that stay within a page, and crawls that resume."""

import base64
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartulary.sources import paged


def test_requests_of_searches():
    assert paged.article_search("sleep", 10) == {"db": "pmc", "term": "(sleep) AND pmc open access[filter]", "retmax": 30, "retmode": "json", "sort": "relevance"}
    big = paged.article_search("a b", 400, 2021)
    assert big["retmax"] == 500 and big["term"] == "(a b) AND pmc open access[filter] AND 2021:2030[pdat]"


def numbers(total, broken=(), folder=None, fails=0):
    """A service of numbered items; pages that begin at a broken number fail, always or the first so many times."""

    def answer(request):
        if request["size"] == 0:
            return {"total": total}
        start = request["start"]
        if start in broken:
            mark = Path(folder) / str(start)
            n = int(mark.read_text()) if mark.exists() else 0
            mark.write_text(str(n + 1))
            if n < fails:
                raise TimeoutError("busy")
        return {"items": [{"n": k} if k % 2 else f"i{k}" for k in range(start, min(start + request["size"], total))]}

    return answer


def _bodies(rows):
    return [r.body for r in sorted(rows, key=lambda r: (r.page, r.position or 0)) if r.error is None]


def _item(k):
    return json.dumps({"n": k}) if k % 2 else f"i{k}"


def test_each_page_is_a_partition_and_all_items_come(spark):
    rows = paged.read_pages(spark, numbers(23), {}, size=5)
    assert rows.rdd.getNumPartitions() == 5
    assert _bodies(rows.collect()) == [_item(k) for k in range(23)]
    assert _bodies(paged.read_pages(spark, numbers(23), {"retmax": 12}, size=5).collect()) == [_item(k) for k in range(12)]
    assert paged.read_pages(spark, numbers(0), {}).collect() == []


def test_failures_are_tried_again_and_stay_within_their_page(spark, tmp_path):
    for name in ("some", "all"):
        (tmp_path / name).mkdir()
    again = paged.read_pages(spark, numbers(20, {5}, str(tmp_path / "some"), 2), {}, size=5)
    assert _bodies(again.collect()) == [_item(k) for k in range(20)]
    rows = paged.read_pages(spark, numbers(20, {5}, str(tmp_path / "all"), 99), {}, size=5).collect()
    assert [(r.page, r.body, r.error) for r in rows if r.error] == [(1, None, "TimeoutError: busy")]
    assert _bodies(rows) == [_item(k) for k in (*range(5), *range(10, 20))]


def chain(sizes, fail_at=None):
    """Timelines of so many posts a feed; a cursor is the number to go on from. The page at fail_at fails."""

    def answer(request):
        at, n = int(request.get("cursor", 0)), sizes[request["feed"]]
        if at == fail_at:
            raise ConnectionError("gone")
        posts = [{"entryId": f"tweet-{k}", "content": {}} for k in range(at, min(at + request["count"], n))]
        if at + request["count"] < n or (n == 4 and at < n):  # a feed of 4 names a cursor even at its end, and then gives an empty page
            posts.append({"entryId": "cursor-bottom-1", "content": {"entryType": "TimelineTimelineCursor", "value": str(at + request["count"])}})
        return {"data": {"deep": [{"entries": posts}], "entries": [{"entryId": "cursor-top-1", "content": {"entryType": "TimelineTimelineCursor", "value": "up"}}]}}

    return answer


def _state(pages):
    return {r.feed: (r.pages, r.cursor, r.completed, r.errors) for r in paged.crawl_state(pages).collect()}


def test_a_crawl_resumes_from_the_cursor_that_it_kept(spark, tmp_path):
    sizes = {"a": 11, "b": 3, "c": 0, "d": 4}
    feeds = spark.createDataFrame([(f,) for f in [*sizes, "a", None]], "feed string")
    folder = f"file://{tmp_path}/crawl"
    go = lambda fail_at=None, most=2: paged.crawl(feeds, chain(sizes, fail_at), folder, most=most, count=2)
    assert _state(go(fail_at=2)) == {"a": (1, "2", False, 1), "b": (1, "2", False, 1), "c": (0, None, True, 0), "d": (1, "2", False, 1)}
    assert _state(go()) == {"a": (3, "6", False, 1), "b": (2, None, True, 1), "c": (0, None, True, 0), "d": (2, None, True, 1)}
    pages = go(most=50)
    assert {f: s[2] for f, s in _state(pages).items()} == dict.fromkeys(sizes, True)
    ids = pages.select("feed", F.explode("ids").alias("id"))
    assert ids.count() == ids.distinct().count() == sum(sizes.values())
    assert go(most=50).count() == pages.count()  # nothing is asked of chains that ended


def test_a_crawl_that_starts_again_forgets(spark, tmp_path):
    feeds = spark.createDataFrame([("a",)], "feed string")
    folder = f"file://{tmp_path}/crawl"
    paged.crawl(feeds, chain({"a": 9}), folder, count=2)
    assert _state(paged.crawl(feeds, chain({"a": 3}), folder, count=2, restart=True)) == {"a": (2, None, True, 0)}


def test_readme_previews(spark):
    long = "# Head\n\nSee [the docs](https://x.y/z) ![](i.png)\n" + "é" * 600
    coded = base64.encodebytes(long.encode()).decode()
    rows = [(0, coded), (1, None), (2, "not base64!"), (3, ""), (4, base64.b64encode(b"## a\n### b").decode())]
    got = dict(spark.createDataFrame(rows, "i int, c string").select("i", paged.readme_preview(F.col("c"))).collect())
    start = "Head\n\nSee the docs \n"
    assert got == {0: start + "é" * (500 - len(start)), 1: "", 2: "", 3: "", 4: "a\nb"}


@pytest.mark.parametrize("since,want", [(None, {"1", "2", "3", "4"}), ("2018-10-10 20:00:00", {"1"})])
def test_wanted_posts(spark, since, want):
    posts = [("1", "Wed Oct 10 20:19:24 +0000 2018"), ("1", "Wed Oct 10 20:19:24 +0000 2018"), ("2", "Wed Oct 10 20:19:24 +0800 2018"), ("3", "yesterday"), (" 4 ", None), ("5", "Thu Oct 11 20:19:24 +0000 2018"), ("", None), (None, None)]
    done = spark.createDataFrame([("5",), ("5",)], "id string")
    got = paged.wanted_posts(spark.createDataFrame(posts, "id string, created_at string"), done, since=F.lit(since).cast("timestamp") if since else None)
    assert {r.id for r in got.collect()} == want
