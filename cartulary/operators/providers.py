"""Calls to models and services as injected functions: in batches, tried again, failing to null; and what is built on them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import let, text_or_empty

#: Texts of one call.
BATCH = 50


def answered(rows: DataFrame, key: str, prompt: str, provider: Callable[[list[str]], list], kind: str = "string", batch: int = BATCH, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """(key, answer) of distinct keys: the provider gets lists of up to `batch` prompts. A call that raises is tried again, and then each of its prompts alone; what still fails is null.

    Equal keys are asked once, by a shuffle of the prompts; the provider must be picklable.
    """
    asked = rows.groupBy(key).agg(F.min(prompt).alias("_prompt"))
    field = asked.schema[key].dataType.simpleString()

    def call(prompts: list[str]) -> list:
        for n in range(tries):
            try:
                return provider(prompts)
            except Exception:  # noqa: BLE001 - a provider may fail in any way
                time.sleep(wait * 2**n)
        return [None] if len(prompts) == 1 else [a for p in prompts for a in call([p])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                said = pa.array(call(part.column(1).to_pylist()), pa.list_(pa.float64()) if kind.startswith("array") else pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), said], [key, "answer"])

    return asked.mapInArrow(run, f"`{key}` {field}, answer {kind}")


def json_object(answer: Column) -> Column:
    """The object in an answer: without a thought before it and marks around it."""
    return F.regexp_extract(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?</think>", ""), r"(?s)(\{.*\})", 1)


def classified(answer: Column, fallback: Column, categories: list[str]) -> Column:
    """(category, confidence, model, new_category): a known category; a new one, as a slug, only if the answer is sure; else the fallback."""
    parsed = F.from_json(json_object(answer), "category string, new_category string, confidence string")

    def chosen(p: Column) -> Column:
        slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(p.new_category)), "[^a-z0-9一-鿿]+", "-"), "^-+|-+$", ""), F.lit(48))
        sure = F.lower(F.coalesce(p.confidence, F.lit("low")))
        known = F.trim(p.category).isin(*categories)
        new = (F.trim(p.category) == "NEW_CATEGORY") & (slug != "") & (sure == "high")
        category = F.when(known, F.trim(p.category)).when(new, slug).otherwise(fallback)
        confidence = F.when(known | new | sure.isin("high", "medium"), sure).otherwise("low")
        ok = F.coalesce(p.category, F.lit("")) != ""
        return F.struct(F.when(ok, category).otherwise(fallback).alias("category"), F.when(ok, confidence).otherwise("low").alias("confidence"), ok.alias("model"), F.coalesce(ok & new & ~known, F.lit(False)).alias("new_category"))

    return let(parsed, chosen)


def judged(answer: Column) -> Column:
    """(include, dimension) of a gate's answer; an answer that cannot be read includes nothing."""
    p = F.from_json(json_object(answer), "include boolean, dimension string")
    return let(p, lambda x: F.struct(F.coalesce(x.include, F.lit(False)).alias("include"), F.coalesce(x.dimension, F.lit("none")).alias("dimension")))


def relation(answer: Column) -> Column:
    """The relation that an answer states in a line of its own."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(answer, F.lit("")), r"RELATION:\s*(\w+)", 1), F.lit("")), F.lit("UNKNOWN"))


def chunks(text: Column, size: int, most: int | None = None) -> Column:
    """The text in pieces of `size` characters, all of them or the first `most`."""
    n = F.ceil(F.length(text) / F.lit(float(size))).cast("int")
    n = F.greatest(n, F.lit(1)) if most is None else F.least(F.greatest(n, F.lit(1)), F.lit(most))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))


def condensed(rows: DataFrame, key: str, text: str, provider: Callable[[list[str]], list], size: int = 6000, most: int = 12, head: int = 800) -> DataFrame:
    """(key, text): a text of over `size` characters as its pieces' summaries and its start; where a summary fails, its first `size` characters."""
    long = rows.where(F.length(text) > size)
    parts = long.select(key, F.posexplode(chunks(F.col(text), size, most)).alias("i", "part")).withColumn("piece", F.sha2("part", 256))
    said = answered(parts, "piece", "part", provider)
    g = parts.join(said, "piece").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "answer"))), lambda x: F.trim(x.answer)), "\n\n").alias("_sum"), F.count_if(F.col("answer").isNull()).alias("_lost"))
    t = F.col(text)
    whole = F.concat(F.lit("（以下為長文件分段濃縮，原文 "), F.length(t).cast("string"), F.lit(" 字元）\n\n"), F.col("_sum"), F.lit("\n\n--- 原文開頭 ---\n"), F.left(t, F.lit(head)))
    short = F.when(F.col("_lost") > 0, F.left(t, F.lit(size))).when(F.col("_sum").isNotNull(), whole).otherwise(t)
    return rows.join(g, key, "left").select(key, short.alias("text"))


def insights(rows: DataFrame, key: str, text: str, provider: Callable[[list[str]], list], size: int = 4000) -> DataFrame:
    """(key, content, topic): what a provider finds in each piece of a text, as JSON; one of each content of the same first 120 characters."""
    parts = rows.select(key, F.explode(chunks(F.col(text), size)).alias("part")).where(F.trim("part") != "").withColumn("piece", F.sha2("part", 256))
    found = F.from_json(json_object(F.col("answer")), "insights array<struct<content: string, topic: string>>").insights
    rows = parts.join(answered(parts, "piece", "part", provider), "piece").select(key, F.inline(found)).where("content <> ''")
    return rows.groupBy(key, F.left("content", F.lit(120)).alias("_k")).agg(F.min(F.struct("content", "topic")).alias("b")).select(key, "b.content", "b.topic")


def composed(question: str, records: DataFrame, order: list, size: int = 4000) -> str:
    """A prompt of the question and the best records (title, text) that fit: the records are few, as they are a recall's."""
    told, left = [], size
    for r in records.orderBy(*order).limit(50).collect():
        part = f"[{r['title']}]\n{r['text']}"
        if len(part) > left:
            break
        told.append(part)
        left -= len(part)
    return "\n\n".join([*told, f"Question: {question}"])
