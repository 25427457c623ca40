"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame and SQL functions only. The forest is grown by Spark's RandomForestClassifier on labelled
findings, then written out as one SQL expression, so that it is applied where the text lies.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import Workspace

#: Labelled findings that a forest is grown on, at most: those that hash lowest.
FINDINGS = 20_000
TREES, DEPTH = 24, 6

#: Names that a value is assigned to.
_NAMES = "api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|auth|credential|private[_-]?key|client[_-]?id"
_RUN = r"A-Za-z0-9+/_\-"
#: What stands before an assigned value: an identifier that ends in a name, and the sign, however far apart.
_ASSIGN = rf"(?i:{_NAMES})[\"']?\s*[=:]\s*[\"']?"
#: A candidate: a value that is assigned (group 2, after group 1); a key's first line, or a run of 20 characters or more with a digit (group 3).
CANDIDATE = rf"(?<![{_RUN}])(?:([{_RUN}]*?{_ASSIGN})([^\s\"']{{6,}})|((?=[A-Za-z+/_\-]*[0-9])[{_RUN}]{{20,}}={{0,2}}))|(-----BEGIN [A-Z ]*PRIVATE KEY-----)"
#: Common words of identifiers and prose (fixed list).
DICTIONARY = (
    "access account admin album alpha amber apple april array assets august authorization backup bank base before between blue board bridge button cache camera change channel charge "
    "checksum child class client cloud code comment commit common component config connect content control cookie count create custom daily data debug default demo deploy design detail "
    "device digest direct display document domain dummy east edition editor element email enable engine error event example export feature field file filter final first folder format "
    "forward frame front function gateway general github global green group handle header health height hello history home hosted house image import index information input instance "
    "internal issue item july june key label language large layer letter level library light line link list local login machine main manager march market master media memory message "
    "method model module monday month music name network node north note number object office option order output package page paper parent part password path people phone picture "
    "placeholder plain platform player point policy position power press price private product profile program project public query question random record region release remote report "
    "repository request resource response result return review revision route sample schema school score script search second section security select sender sequence series server service "
    "session setting shared short signal simple single social source stage standard start state static status storage store stream string style subject summary support system table target "
    "task team template temporary test text theme thread ticket time title tool total track training transfer type unique unit update upload user value vector version video view virtual "
    "visible volume warning watch water week weight white width window winter word work world write year yellow zone"
).split()
#: Frequent letter pairs of European prose (fixed list): prose passes through them, keys rarely do.
PAIRS = "th he in er an re nd on en at ou ed ha to or it is hi es ng ch ei ie de te ar st se le la qu ue ai eu io ti me al ra co as os ta".split()
_EXAMPLE = "example|sample|dummy|fake|test|mock|fixture|placeholder|demo"
_DIGEST = "commit|sha-?1|sha-?256|md5|checksum|digest|etag|uuid|revision|integrity|base64,"


def _features(value: Column, left: Column, right: Column, path: Column) -> dict[str, Column]:
    """What the forest sees of a candidate: its length, characters and their transitions, dictionary coverage, path and neighbours."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    low, near = F.lower(value), F.lower(F.concat(left, F.lit(" "), right))
    count = lambda s, pattern: F.regexp_count(s, F.lit(pattern)).cast("double")
    has = lambda s, pattern: s.rlike(pattern).cast("double")
    chars = F.array_distinct(F.split(value, ""))
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double") / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return {
        "length": n,
        "digits": count(value, "[0-9]") / n,
        "upper": count(value, "[A-Z]") / n,
        "marks": count(value, "[^A-Za-z0-9]") / n,
        "entropy": entropy,
        "hex": has(value, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "to_digit": count(value, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "to_case": count(value, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "prose_pairs": count(low, "(?=(?:" + "|".join(PAIRS) + "))") / n,
        "vowel_turns": count(low, "(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])") / n,
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")).cast("double") / n,
        "repeats": has(low, r"(.)\1{4,}|(..)\2{3,}|012345|123456|abcdef|qwerty"),
        "stands_in": has(low, "x{5,}|\\*{4,}|your|change-?_?me|insert|redacted|" + _EXAMPLE),
        "known": has(value, "^(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk[-_]|eyJ|glpat-|-----BEGIN)"),
        "assigned": has(left, rf"{_ASSIGN}$"),
        "quoted": has(left, "[\"']$"),
        "in_address": has(left, r"(?:https?://|www\.|/)\S*$"),
        "near_secret": has(near, f"(?:{_NAMES}|bearer|login)"),
        "near_digest": has(near, _DIGEST),
        "near_example": has(near, _EXAMPLE),
        "path_example": has(F.lower(path), _EXAMPLE + "|docs?/|spec"),
    }


def labelled_findings(spark: SparkSession, n: int = 6000, seed: int = 11) -> DataFrame:
    """Labelled findings (value, left, right, path, secret) made by rule: random credentials in the ways that code and
    logs hold them, and the things that scanners mistake for them. Digests of a counter stand for randomness."""
    h = lambda k: F.sha2(F.concat_ws("-", F.lit(seed), F.lit(k), F.col("id")), 256)
    listed = lambda options: F.array(*options) if isinstance(options[0], Column) else F.split(F.lit("\n".join(options)), "\n")
    pick = lambda k, options: F.element_at(listed(options), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    some = lambda k, lo, hi: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(hi - lo + 1)) + lo).cast("int")
    letters = F.translate(F.base64(F.unhex(F.concat(h("a"), h("b")))), "=", "A")
    word = lambda k: pick(k, DICTIONARY[::3])
    pairs = listed(PAIRS)
    prose = lambda k: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.element_at(pairs, (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k), i), F.lit(len(PAIRS))) + 1).cast("int"))), "")
    name = pick("name", ["token", "api_key", "API_KEY", "secret", "SECRET", "password", "access_key", "TOKEN", "auth", "pwd", "client_secret"])
    assigned = F.concat(word("l1"), F.lit(" "), prose("l2"), F.lit(" "), name, pick("eq", [" = \"", "=", ": ", " = ", ": '", "=\"", " : \""]))
    plain = F.concat(word("p1"), F.lit(" "), prose("p2"), F.lit(" "))
    digest = F.concat(plain, pick("dg", ["commit ", "sha256:", "md5 ", "checksum: ", "digest ", "revision ", "integrity sha1-", "uuid "]))
    kinds = [
        (1, F.substring(h("v"), 1, 40), assigned),
        (1, F.upper(F.substring(h("v"), 1, 40)), assigned),
        (1, F.substring(h("v"), 1, 32), assigned),
        (1, F.substr(letters, F.lit(1), some("n", 24, 64)), assigned),
        (1, F.substr(letters, F.lit(1), some("n", 10, 20)), assigned),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(letters, "+/", "XY"), 1, 16))), pick("c1", [assigned, plain])),
        (1, F.concat(pick("gh", ["ghp_", "gho_", "sk-", "xoxb-", "glpat-", "AIza"]), F.substring(F.translate(letters, "+/", "ab"), 1, 36)), pick("c2", [assigned, plain])),
        (1, F.concat(F.lit("-----BEGIN "), pick("pk", ["RSA ", "EC ", ""]), F.lit("PRIVATE KEY-----")), plain),
        (0, F.substring(h("v"), 1, 40), digest),
        (0, F.substring(h("v"), 1, 32), digest),
        (0, h("v"), digest),
        (0, F.concat(F.substring(h("v"), 1, 8), F.lit("-"), F.substring(h("v"), 9, 4), F.lit("-"), F.substring(h("v"), 13, 4), F.lit("-"), F.substring(h("v"), 17, 12)), plain),
        (0, F.concat_ws("_", word("w1"), word("w2"), word("w3"), some("d", 1, 99).cast("string")), pick("c3", [plain, assigned])),
        (0, F.concat_ws("/", word("w1"), word("w2"), word("w3"), F.concat(prose("w4"), some("d", 1, 9).cast("string"))), F.concat(plain, F.lit("/"))),
        (0, F.concat(prose("w5"), some("d", 10, 999).cast("string")), pick("c4", [plain, assigned])),
        (0, prose("w6"), assigned),
        (0, F.concat_ws("-", word("w1"), word("w2"), F.lit("2024"), some("d", 10, 99).cast("string"), word("w3")), F.concat(plain, F.lit("https://www."))),
        (0, pick("ph", ["xxxxxxxxxxxxxxxxxxxxxxxx1", "your_api_key_here_123456", "changeme123", "EXAMPLEKEY1234567890EXAMPLE", "********", "insert-your-token-here-1", "00000000000000000000000000000000"]), assigned),
        (0, F.concat(F.repeat(some("r", 0, 9).cast("string"), 4), F.lpad(some("r2", 0, 99999).cast("string"), 18, "1234567890")), plain),
        (0, F.concat(F.lit("AKIA"), F.lit("EXAMPLE"), F.upper(F.substring(h("v"), 1, 9))), F.concat(plain, F.lit("example "))),
    ]
    paths = {1: ["src0", "src/app.py", "config/prod.env", "src7", "logs/run.log"], 0: ["src0", "src/app.py", "tests/fixture.json", "docs/example.md", "src7", "logs/run.log"]}
    each = [
        spark.range(k, n, len(kinds), 1).select(value.alias("value"), left.alias("left"), F.concat(F.lit("\" "), prose("right")).alias("right"), pick("path", paths[truth]).alias("path"), F.lit(truth).alias("secret"))
        for k, (truth, value, left) in enumerate(kinds)
    ]
    return reduce(DataFrame.union, each)


def grow_forest(findings: DataFrame, seed: int = 5) -> list:
    """The trees of a forest grown on findings (value, left, right, path, secret): nested (feature, threshold, left, right) or a class.

    Rows with a null value or label are left out; at most FINDINGS rows are used. With one class
    only, every tree is that class; without rows the forest calls everything a secret.
    """
    rows = finding_features(findings)
    classes = [r["label"] for r in rows.groupBy("label").count().collect()]
    if len(classes) < 2:
        return [int(classes[0]) if classes else 1]
    return _parse(fit_forest(rows, seed).toDebugString, [c for c in rows.columns if c != "label"])


def finding_features(findings: DataFrame) -> DataFrame:
    """label and the features of at most FINDINGS findings, those that hash lowest."""
    rows = findings.where("value is not null and secret is not null").select("value", *[F.coalesce(c, F.lit("")).alias(c) for c in ("left", "right", "path")], F.col("secret").cast("double").alias("label"))
    work = Workspace(findings.sparkSession, "secrets")
    rows = work.stage(rows.orderBy(F.xxhash64("value", "left"), "value", "left").limit(FINDINGS), "findings")
    features = _features(F.col("value"), F.col("left"), F.col("right"), F.col("path"))
    return work.stage(rows.select("label", *[c.alias(n) for n, c in features.items()]), "features")


def fit_forest(rows: DataFrame, seed: int = 5) -> RandomForestClassificationModel:
    """Spark's forest over finding_features."""
    table = VectorAssembler(inputCols=[c for c in rows.columns if c != "label"], outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(table.select("label", "features"))


def _parse(text: str, names: list[str]) -> list:
    """Trees from Spark's printed form of a forest."""
    lines = iter([x.strip() for x in text.splitlines()[1:]])

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return int(float(line.split(":")[1]))
        at = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        low = node()
        next(lines)  # Else
        return names[int(at[1])], float(at[2]), low, node()

    return [node() for line in lines if line.startswith("Tree")]


def _tree(t, feature) -> Column:
    return F.lit(float(t)) if isinstance(t, int) else F.when(feature(t[0]) <= F.lit(t[1]), _tree(t[2], feature)).otherwise(_tree(t[3], feature))


def forest_score(trees: list, feature) -> Column:
    """Share of the trees that vote for a secret; feature(name) gives the column of a feature."""
    return reduce(lambda a, b: a + b, [_tree(t, feature) for t in trees]) / F.lit(float(len(trees)))


def parts_of(text: Column) -> Column:
    """The text in parts: what stands before the first candidate, it, what stands between it and the second, and so on.

    One pass of the pattern sets a mark about each candidate. The mark's own character is written
    as two others meanwhile.
    """
    mark, out, kept, own = "\u0001", "\u0002", "\u0004", "\u0003"
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(out), F.lit(out + kept)), F.lit(mark), F.lit(out + own))
    marked = F.split(F.regexp_replace(plain, CANDIDATE, f"$1{mark}$2$3$4{mark}"), mark, -1)
    return F.transform(marked, lambda p: F.replace(F.replace(p, F.lit(out + own), F.lit(mark)), F.lit(out + kept), F.lit(out)))


def _sums(sizes: Column, block: int = 256) -> Column:
    """The sum of the sizes before each, by blocks: an array that grows by one is copied each time."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(sizes) / block) - 1, F.lit(0)).cast("int")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))
    none = F.array().cast("array<int>")

    def running(xs: Column) -> Column:
        return F.aggregate(xs, F.struct(F.lit(0).alias("end"), none.alias("at")), lambda s, x: F.struct((s.end + x).alias("end"), F.array_append(s.at, s.end).alias("at")))

    def joined(b: Column) -> Column:
        return F.flatten(F.zip_with(b, running(F.transform(b, lambda x: x.end)).at, lambda x, base: F.transform(x.at, lambda y: y + base)))

    return F.transform(F.array(F.transform(blocks, running)), joined)[0]


def _candidates(parts: Column) -> Column:
    """(value, start, left, right) of the candidates in parts; start counts characters from 0."""

    def each(p: Column) -> Column:
        starts = _sums(F.transform(p, lambda x: F.length(x)))
        at = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i % 2 == 0))
        return F.transform(
            F.transform(F.array(starts), lambda s: F.transform(at, lambda i: F.struct(i.alias("i"), F.element_at(s, i).alias("start"))))[0],
            lambda x: F.struct(F.element_at(p, x.i).alias("value"), x.start.alias("start"), F.right(F.element_at(p, x.i - 1), F.lit(64)).alias("left"), F.left(F.element_at(p, x.i + 1), F.lit(64)).alias("right")),
        )

    none = F.array().cast("array<struct<value:string,start:int,left:string,right:string>>")
    return F.when(F.size(parts) > 1, F.transform(F.array(parts), each)[0]).otherwise(none)


def findings_of(parts: Column, path: Column, trees: list, threshold: float) -> Column:
    """All candidates of a text's parts in order, judged, as an array of structs."""
    path = F.coalesce(path, F.lit(""))

    def judged(x: Column) -> Column:
        seen = F.transform(F.array(F.struct(*[c.alias(n) for n, c in _features(x.value, x.left, x.right, path).items()])), lambda f: forest_score(trees, lambda n: f[n]))
        return F.struct(x.value.alias("value"), x.start.alias("start"), x.left.alias("left"), x.right.alias("right"), seen[0].alias("score"))

    scored = F.transform(_candidates(parts), judged)
    return F.transform(scored, lambda x: F.struct(x.value.alias("value"), x.start.alias("start"), F.length(x.value).alias("length"), x.left.alias("left"), x.right.alias("right"), x.score.alias("score"), (x.score >= threshold).alias("secret")))


def scan_secrets(
    docs: DataFrame,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    *,
    threshold: float = 0.5,
) -> DataFrame:
    """One row for each candidate: id, start and length of its span, value, left and right neighbours, score, and secret (score >= threshold).

    findings are labelled candidates (value, left, right, path, secret) that the forest is grown on;
    by default labelled_findings(). The scan has no shuffle: pattern, features and forest are
    expressions over the row's own text, however long. A null or empty text has no candidates; null
    ids and paths are allowed; repeated rows give repeated findings; an empty table gives an empty
    table. Candidates do not overlap; each starts where the last one ended or later.
    """
    trees = grow_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("_path"), F.transform(F.array(parts_of(F.col(text_col))), lambda p: findings_of(p, F.col(path_col).cast("string"), trees, threshold))[0].alias("_all"))
    # explode_outer: before explode, Spark would filter by the size of the array, and so compute it twice
    found = rows.select(F.col("_id"), F.explode_outer("_all").alias("_f")).where("_f is not null")
    return found.select(F.col("_id").alias(id_col), "_f.start", "_f.length", "_f.value", "_f.left", "_f.right", "_f.score", "_f.secret")


def redact_secrets(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text", path_col: str = "source", *, threshold: float = 0.5, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, with each secret in the text replaced by mark. Texts without secrets, null ones among them, are unchanged."""
    trees = grow_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    text, path = F.col(text_col), F.col(path_col).cast("string")

    def masked(p: Column) -> Column:
        verdicts = F.transform(findings_of(p, path, trees, threshold), lambda x: x.secret)
        return F.transform(F.array(verdicts), lambda v: F.array_join(F.transform(p, lambda x, i: F.when((i % 2 == 1) & F.element_at(v, F.greatest(((i + 1) / 2).cast("int"), F.lit(1))), F.lit(mark)).otherwise(x)), ""))[0]

    whole = F.transform(F.array(parts_of(text)), lambda p: F.when(F.size(p) > 1, masked(p)).otherwise(text))[0]
    return docs.withColumn(text_col, F.when(text.isNotNull(), whole))
