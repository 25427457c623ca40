"""Language ID by fusing evidence: text likelihoods, declared language, address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import tidy, Workspace

#: Texts that the likelihoods are fitted on, at most: those whose ids hash lowest.
SAMPLE = 4096
#: Trigrams of bytes are counted in so many buckets.
BUCKETS = 1 << 16
#: A text's trigrams weigh as so many independent ones, at most.
WEIGHT = 40.0
#: Pages that a suffix counts as in its hosts' priors, and all pages in a suffix's.
HOST_SMOOTHING, SUFFIX_SMOOTHING = 8.0, 32.0
_FOLD = bytes(c + 32 if 65 <= c < 91 else 32 if c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))
_BEGINS = {kind: rb"<!--" if kind == b"!--" else rb"<" + kind + rb"\b" for kind in (b"!--", b"script", b"style")}
_ENDS = {kind: re.compile(rb"-->" if kind == b"!--" else rb"</" + kind + rb"\s*>") for kind in _BEGINS}
_TAG = re.compile(rb"<[^>]*>")


def page_text(html: bytes) -> bytes:
    """What a page shows: without scripts, styles, comments and tags. What is never closed is shown.

    One scan forward: once a kind's end has not been found, no later one of that kind can be closed
    either, and none is looked for; behind the last > there are no tags. So the time grows with the
    page's length, however broken it is.
    """
    low, shown, at, looked, kinds = html.lower(), [], 0, 0, list(_BEGINS)
    while kinds:
        begin = re.compile(b"|".join(b"(%s)" % _BEGINS[k] for k in kinds)).search(low, looked)
        if begin is None:
            break
        kind = kinds[begin.lastindex - 1]
        end = _ENDS[kind].search(low, begin.end())
        if end is None:
            kinds.remove(kind)
            looked = begin.start()
            continue
        shown.append(html[at : begin.start()])
        at = looked = end.end()
    text = b" ".join([*shown, html[at:]])
    last = text.rfind(b">") + 1
    return _TAG.sub(b" ", text[:last]) + text[last:]


def buckets(text: bytes) -> np.ndarray:
    """The bucket of each trigram of letters and spaces, A-Z lower-cased, runs of spaces as one."""
    data = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return (code * np.uint32(2_654_435_761)) >> np.uint32(16)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total[lang] += np.bincount(buckets((text or "").encode()), minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    powers = [F.exp(x - top) for x in logs]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def identify_languages(
    pages: DataFrame,
    labelled: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    *,
    label_id: str = "doc_id",
    label_text: str = "text",
    label_col: str = "lang",
) -> DataFrame:
    """One row for each page: id, host, declared, text_lang (by the text alone), lang, posterior, host_prior.

    Text likelihoods are those of byte trigrams under each language of labelled, fitted on the
    SAMPLE rows whose ids hash lowest. By the text alone each page then counts in parts for the
    languages; grouped sums of those parts over all pages give, for each language, how pages of it
    declare themselves (html lang), the mix of each address suffix (the host's last label) smoothed
    to that of all pages, and the mix of each host smoothed to its suffix's. A page's posterior
    multiplies its likelihood, its declaration's and its host's prior; the page's own part is
    left out of its host's sums, and stays in those of its suffix and its declaration, which are
    over far more pages. A page declares what the first html tag says.

    A null or empty page has no say by its text; a null address no host, so the prior of all pages;
    no declaration, or one that is no language tag, none by that. Ties go to the language first in
    code-point order. Null ids and repeated rows are kept. Without labelled rows lang is null. An
    empty table gives an empty table.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "language")
    known = labelled.select(F.col(label_id).alias("id"), F.col(label_col).alias("lang"), F.col(label_text).alias("text")).where("lang is not null and id is not null")
    chosen = work.stage(known.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE), "chosen")
    found = known.join(F.broadcast(chosen.distinct()), "id").select("lang", "text").mapInArrow(tidy(_counts), "lang string, bucket long, n long")
    found = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in found.collect():  # BUCKETS for each language of the sample, at most
        counts.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    langs = sorted(counts)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    opened = F.regexp_extract("html", r"(?i)<html\b([^>]*)", 1)  # the first, once, so that the time grows with the length
    tag = F.lower(F.regexp_extract(opened, r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", 1))
    rows = rows.select("id", F.when(host != "", host).alias("host"), F.when(tag != "", tag).alias("declared"), "html")
    if not langs:
        return rows.select(F.col("id").alias(id_col), "host", "declared", *[F.lit(None).cast(t).alias(n) for n, t in (("text_lang", "string"), ("lang", "string"), ("posterior", "double"), ("host_prior", "double"))])
    table = np.stack([np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS)) for x in langs], axis=1)
    model = spark.sparkContext.broadcast(table)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(langs)))
            for i in range(batch.num_rows):
                b = buckets(page_text((batch.column(3)[i].as_py() or "").encode()))
                if len(b) > 1:
                    own = model.value[b].sum(0)
                    out[i] = (own - own.max()) * min(1.0, WEIGHT / len(b))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array(out[:, k]) for k in range(len(langs)))], ["id", "host", "declared", *names])

    names = [f"l{k}" for k in range(len(langs))]
    each = rows.mapInArrow(tidy(likelihoods), f"id {kind}, host string, declared string, " + ", ".join(f"{n} double" for n in names))
    parts = _softmax([F.col(n) for n in names])
    each = work.stage(each.select("*", *[p.alias(f"r{k}") for k, p in enumerate(parts)], F.element_at(F.split("host", r"\."), -1).alias("suffix")), "likelihoods")
    r = [f"r{k}" for k in range(len(langs))]
    sums = [F.sum(x).alias(x) for x in r]
    total = np.array([float(x or 0) for x in each.agg(*sums).first()])
    overall = (total + 1) / (total.sum() + len(langs))
    said = {x["declared"]: np.array([x[c] for c in r]) for x in each.where("declared is not null").groupBy("declared").agg(*sums).collect()}  # tags of three letters at most
    spoken = sum(said.values(), np.zeros(len(langs)))
    declares = {d: np.log((n + 0.5) / (spoken + 0.5 * (len(said) + 1))) for d, n in said.items()}
    by_suffix = each.where("suffix is not null").groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("n"))
    by_suffix = by_suffix.select("suffix", *[((F.col(c) + F.lit(SUFFIX_SMOOTHING * overall[k])) / (F.col("n") + SUFFIX_SMOOTHING)).alias(f"s{k}") for k, c in enumerate(r)])
    by_host = each.where("host is not null").groupBy("host", "suffix").agg(*[F.sum(c).alias(f"h{k}") for k, c in enumerate(r)], F.count(F.lit(1)).alias("n"))
    by_host = work.stage(by_host.join(by_suffix, "suffix").drop("suffix"), "hosts")  # so that Spark can split a hot host's pages
    joined = each.join(by_host, "host", "left")
    heard = spark.createDataFrame([(d, v.tolist()) for d, v in declares.items()], "declared string, d array<double>")
    joined = joined.join(F.broadcast(heard), "declared", "left")
    prior = [F.coalesce((F.col(f"h{k}") - F.col(f"r{k}") + HOST_SMOOTHING * F.col(f"s{k}")) / (F.col("n") - 1 + HOST_SMOOTHING), F.lit(float(overall[k]))) for k in range(len(langs))]
    joined = joined.select("*", *[F.greatest(p, F.lit(1e-12)).alias(f"p{k}") for k, p in enumerate(prior)])
    logs = [F.col(f"l{k}") + F.log(f"p{k}") + F.coalesce(F.element_at("d", k + 1), F.lit(0.0)) for k in range(len(langs))]
    post = joined.select("*", *[x.alias(f"q{k}") for k, x in enumerate(_softmax(logs))])

    def best(prefix: str) -> Column:
        return F.array_max(F.array(*[F.struct(F.col(f"{prefix}{k}").alias("p"), F.lit(-k).alias("k")) for k in range(len(langs))]))

    at = lambda k, values: F.element_at(F.array(*values), (1 - k).cast("int"))
    names_of = [F.lit(x) for x in langs]
    post = post.withColumn("_t", best("r")).withColumn("_b", best("q"))
    return post.select(
        F.col("id").alias(id_col), "host", "declared", at(F.col("_t.k"), names_of).alias("text_lang"), at(F.col("_b.k"), names_of).alias("lang"),
        F.col("_b.p").alias("posterior"), at(F.col("_b.k"), [F.col(f"p{k}") for k in range(len(langs))]).alias("host_prior"),
    )
