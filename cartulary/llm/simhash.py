"""SimHash near-dedup: pigeonhole blocks find close fingerprints, Hamming distance verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import components, dealt, pairs_in_runs, resident, stars, tidy, TILE, tiled, whole_runs, words_of, Workspace

#: Shingles whose bits are counted at once, so a very long text needs no more memory.
_AT_ONCE = 16_384
#: Bits in which linked fingerprints differ at most; the blocks of 64 bits, and how many of them a key keeps: BLOCKS - DISTANCE agree at least.
DISTANCE, BLOCKS, AGREE = 4, 7, 3


def _spread(h: np.ndarray, words: int) -> np.ndarray:
    """h itself, then words - 1 further 64-bit mixes of it (splitmix64 steps), as columns."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        z = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A 64-bit hash of each shingle in order; a text of fewer words is one shingle, and one without words has none."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in joined), np.uint64)


def fingerprint(text: str | None, shingle: int = 4, words: int = 1) -> np.ndarray:
    """The fingerprint as 64-bit words. A bit is 1 if over half the shingles' hashes have it; a text without words has none."""
    return majority(shingle_hashes(text, shingle), words)


def majority(h: np.ndarray, words: int) -> np.ndarray:
    ones = np.zeros(64 * words, np.int64)
    for k in range(0, len(h), _AT_ONCE):
        bits = np.unpackbits(_spread(h[k : k + _AT_ONCE], words).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """(id, w0, w1, ...) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            rows = [fingerprint(texts[i].as_py(), shingle, words) for i in range(batch.num_rows)]
            table = np.array(rows, np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(words))], ["id", *(f"w{k}" for k in range(words))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, " + ", ".join(f"w{k} long" for k in range(words)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_keys(words: int, blocks: int, agree: int) -> Column:
    """For each choice of `agree` of the blocks, the fingerprint with only their bits kept."""
    bits = 64 * words
    edges = [round(k * bits / blocks) for k in range(blocks + 1)]
    keys = []
    for chosen in combinations(range(blocks), agree):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        parts = [F.col(f"w{k}").bitwiseAND(F.lit(_signed(m)).cast("long")) for k in range(words) if (m := mask >> (64 * k) & 0xFFFFFFFFFFFFFFFF)]
        keys.append(parts[0] if len(parts) == 1 else F.xxhash64(*parts))
    return F.array(*keys)


def links(prints: DataFrame, words: int, max_distance: int, blocks: int, agree: int) -> DataFrame:
    """Edges (a, b) of fid that connect all distinct fingerprints that meet in a block key and differ in at most max_distance bits."""
    names = [f"w{k}" for k in range(words)]
    rows = prints.select("fid", *names, F.posexplode(block_keys(words, blocks, agree)).alias("choice", "bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in whole_runs(batches, ["choice", "bits", "_i", "_j"]):
            w = [columns[n].view(np.uint64) for n in names]

            def near(a, b, w=w):
                far = np.bitwise_count(w[0][a] ^ w[0][b]).astype(np.int32)
                for x in w[1:]:
                    far += np.bitwise_count(x[a] ^ x[b])
                return far <= max_distance

            found = [(columns["fid"][a], columns["fid"][b]) for a, b in pairs_in_runs(starts, near) if len(a)]
            if found:
                a, b = stars(*(np.concatenate(x) for x in zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tiled(rows, ["choice", "bits"], ["fid"]).mapInArrow(tidy(run), "a long, b long")


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 4,
    words: int = 1,
    max_distance: int = DISTANCE,
    blocks: int = BLOCKS,
    agree: int = AGREE,
) -> DataFrame:
    """One row for each input row: id, fingerprint (hex) and component_id.

    Fingerprints have 64 * words bits, cut into blocks. Two that differ in at most max_distance
    bits agree in blocks - max_distance blocks at least; if agree is no more than that (as by
    default), every such pair shares a key and none is lost. With fewer blocks than that needs,
    pairs beyond blocks - agree bits share a key with a probability that grows with similarity.
    Equal fingerprints are one row from the start, so copies cost nothing; large groups under one
    key are dealt in tiles, and only a spanning forest of the links leaves a task.

    A null or empty text, or one of white space, has fingerprint zero and is linked like any
    other. component_id is the smallest id reachable, itself included; null ids take part and are
    never the smallest, so a component of null ids has null. Repeated rows come back repeated.
    An empty table gives an empty table. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "simhash")
    names = [f"w{k}" for k in range(words)]
    each = work.stage(fingerprints(docs, id_col, text_col, shingle, words), "fingerprints")
    fid = F.col("w0") if words == 1 else F.xxhash64(*names)
    prints = work.stage(each.groupBy(*names).agg(F.min("id").alias("first")).withColumn("fid", fid), "distinct")
    roots = work.stage(components(links(prints, words, max_distance, blocks, agree), work), "components")
    linked = prints.join(roots, prints.fid == roots.node)
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("fid", "least")
    of_print = prints.join(linked, "fid", "left").select(*names, F.coalesce("least", "first").alias("component_id"))
    shown = reduce(F.concat, [F.lpad(F.lower(F.hex(n)), 16, "0") for n in reversed(names)])
    return each.join(of_print, names).select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


#: Near copies: Jaccard of the distinct five-word shingles at least NEAR (a ratio, so that it is compared in whole numbers).
NEAR, SHINGLE = (4, 5), 5
#: Bits of 512 within which a pair is compared exactly. A pair of Jaccard 0.8 differs in 78 on
#: average (SD 8), at worst, four shingles of five, in 96 (SD 9): 150 loses none in practice.
RADIUS, _WORDS = 150, 8
#: Without a radius: parts of the hashes' range in which a text's distinct shingles are counted; counts beyond _MOST are not relied on.
PARTS, _MOST = 128, 65_535
#: Texts sampled for the shingles that are common, and common shingles at most.
_SAMPLE, _COMMON = 4_096, 65_536


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int | None = RADIUS) -> DataFrame:
    """One row for each input row: id, text_key, component_id and kept, where pairs are linked whose shingle sets have Jaccard NEAR or more.

    Candidates come from SimHash as in simhash_components: a fingerprint of 64 bits over a text's
    distinct shingles, keys of AGREE of BLOCKS blocks, and at most DISTANCE differing bits. Pairs of
    Jaccard NEAR often differ in more bits, so prefixes bring up the rest: with shingles in one order for all texts, two sets of Jaccard j
    share one of the first m - ceil(j m) + 1 of their m each, so no pair is lost. The order puts
    shingles that are common in a sample last, so few texts meet in a shared passage. Fingerprints
    of 512 bits drop candidates of prefixes beyond radius; those that are left, and SimHash's, are compared exactly by their shingle
    hashes, so every link is one. With radius None no such fingerprint is taken, and a candidate of prefixes goes
    only where it cannot be a pair: two sets share no more hashes than the smaller of their counts
    in each of PARTS parts of the range add up to, and a pair of sizes a and b shares j / (1 + j) *
    (a + b) at least. That loses no pair whatever the texts, and takes longer. Equal sets are one row from the start, and large groups are dealt
    in tiles.

    Texts without words are copies of one another. component_id is the smallest id reachable; null
    ids take part and are never the smallest. text_key is xxhash64 of the text. kept marks one
    (id, text_key) of each component: of the smallest id, or of the null ids where it has no other,
    the smallest text_key. Repeated rows come back repeated.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "nearcopies")
    num, den = NEAR
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    names = ["w0", "counts"] if radius is None else [f"w{k}" for k in range(_WORDS)]
    this = work.root

    def sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.unique(shingle_hashes(batch.column(1)[i].as_py(), SHINGLE)) for i in range(batch.num_rows)]

    def fid_of(sets: list[np.ndarray]) -> pa.Array:
        return pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64))

    def lists(sets: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(f"nearcopies {this}", "began", lambda: True)  # what an operator before kept in the worker goes
        for batch in batches:
            sets = sets_of(batch)
            yield pa.RecordBatch.from_arrays([fid_of(sets), lists(sets)], ["fid", "hashes"])

    # the distinct texts that hash lowest: their hashes are sorted, and no text but theirs is shuffled
    hashed = rows.where("text is not null").withColumn("h", F.xxhash64("text"))
    last = hashed.select("h").distinct().orderBy("h").limit(_SAMPLE).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.first("text").alias("text"))
    sample = chosen.mapInArrow(tidy(whole), "fid long, hashes array<long>")
    often = sample.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").orderBy(F.desc("n"), "h").limit(_COMMON).collect()
    often.sort(key=lambda r: r["h"] % (1 << 64))
    common = spark.sparkContext.broadcast((np.array([r["h"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.int64)))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = resident(f"nearcopies {this}", "common", lambda: common.value)
        for batch in batches:
            sets, first = sets_of(batch), []
            for h in sets:
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    order = np.lexsort((h, np.where(known[at] == h, n[at], 0)))
                else:
                    order = np.arange(len(h))
                first.append(h[order[: len(h) + (-num * len(h) // den) + 1]] if len(h) else h)
            if radius is None:
                counts = [np.minimum(np.bincount((h >> np.uint64(57)).astype(np.int64), minlength=PARTS), _MOST).astype(np.uint16).tobytes() for h in sets]
                sketch = [pa.array(np.array([majority(h, 1)[0] for h in sets], np.uint64).view(np.int64)), pa.array(counts, pa.binary())]
            else:
                table = np.array([majority(h, _WORDS) for h in sets], np.uint64).reshape(-1, _WORDS).view(np.int64)
                sketch = [pa.array(table[:, k]) for k in range(_WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fid_of(sets), pa.array([len(h) for h in sets], pa.int64()), *sketch, lists(first)], ["id", "text_key", "fid", "m", *names, "prefix"])

    each = work.stage(keyed.mapInArrow(tidy(prints), f"id {kind}, text_key long, fid long, m long, {', '.join('counts binary' if w == 'counts' else f'{w} long' for w in names)}, prefix array<long>"), "prints")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")
    distinct = work.stage(each.groupBy("fid").agg(one, *(F.first(c).alias(c) for c in ["m", *names, "prefix"])), "distinct")
    met = tiled(distinct.select("fid", F.explode("prefix").alias("key")), ["key"], ["fid"], deal=False)
    met = dealt(met.join(distinct.select("fid", "m", *names), "fid"), ["key"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in whole_runs(batches, ["key", "_i", "_j"]):
            m = columns["m"]
            w = np.frombuffer(b"".join(columns["counts"]), np.uint16).reshape(-1, PARTS) if radius is None else [columns[k].view(np.uint64) for k in names]

            def near(a, b, w=w, m=m):
                like = den * np.minimum(m[a], m[b]) >= num * np.maximum(m[a], m[b])
                if radius is not None:
                    return like & (sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int32) for x in w) <= radius)
                at = np.flatnonzero(like)
                for k in range(0, len(at), 1 << 15):
                    i = at[k : k + (1 << 15)]
                    x, y = a[i], b[i]
                    most = np.minimum(w[x], w[y]).sum(1, dtype=np.int64)
                    like[i] = ((num + den) * most >= num * (m[x] + m[y])) | (np.maximum(m[x], m[y]) > _MOST)
                return like

            found = [(columns["fid"][a], columns["fid"][b]) for a, b in pairs_in_runs(starts, near) if len(a)]
            if found:
                a, b = stars(*(np.concatenate(x) for x in zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # SimHash: sets of one fingerprint, and fingerprints that differ in a few bits, which share a key of blocks; then what only prefixes bring up
    heads = distinct.groupBy("w0").agg(F.min("fid").alias("head"))
    alike = distinct.join(heads, "w0").where("fid <> head").select(F.col("fid").alias("a"), F.col("head").alias("b"))
    close = links(heads.select(F.col("head").alias("fid"), "w0"), 1, DISTANCE, BLOCKS, AGREE)
    found = work.stage(alike.unionByName(close).unionByName(met.mapInArrow(tidy(candidates), "a long, b long")), "found")
    groups = work.stage(components(found, work), "candidates")
    work.drop(found)
    wanted = each.join(groups, each.fid == groups.node, "left_semi").select(F.col("id").alias("wanted")).distinct()
    sets = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").mapInArrow(tidy(whole), "fid long, hashes array<long>")
    sets = sets.groupBy("fid").agg(F.first("hashes").alias("hashes"))
    sets = work.stage(sets.join(groups, sets.fid == groups.node).select("root", "fid", "hashes"), "sets")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in whole_runs(batches, ["root", "_i", "_j"], least=2 * TILE):
            for lo, hi in zip(starts[:-1], starts[1:]):
                own = columns["hashes"][lo:hi]
                m = np.array([len(h) for h in own])
                begin = np.cumsum(m) - m
                _, code = np.unique(np.concatenate(own), return_inverse=True)
                group, has = np.arange(hi - lo), np.zeros(code.max() + 1, np.int64)
                for x in range(hi - lo):
                    if (group == group[0]).all():
                        break
                    mine = code[begin[x] : begin[x] + m[x]]
                    has[mine] = 1
                    both = np.add.reduceat(has[code], begin)
                    has[mine] = 0
                    hit = den * both >= num * (m[x] + m - both)
                    group[np.isin(group, group[hit])] = group[x]
                fid, out = columns["fid"][lo:hi], np.flatnonzero(group != np.arange(hi - lo))
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(fid[out]), pa.array(fid[group[out]])], ["a", "b"])

    found = work.stage(tiled(sets, ["root"], ["fid"]).mapInArrow(tidy(verified), "a long, b long"), "verified")
    roots = work.stage(components(found, work), "components")
    work.drop(found)
    linked = distinct.select("fid", "first").join(roots, F.col("fid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fid"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_set = work.stage(linked.select("fid", "root").join(least, "root").select("fid", "least"), "least")
    kept = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_key") == F.col("least.text_key"))
    out = each.select("id", "text_key", "fid").join(of_set, "fid").select(F.col("id").alias(id_col), "text_key", F.col("least.id").alias("component_id"), kept.alias("kept"))
    out = work.stage(out, "groups")
    for used in (each, distinct, groups, sets, roots, of_set):
        work.drop(used)
    return out
