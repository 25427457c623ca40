"""Turns: starts, completions, traces, candidates and jobs as rows. What the store would refuse is an outcome, not an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.predicates import NOISE
from cartulary.functions.text import normal_statement, text_or_empty

#: Keys whose values are never kept.
SECRET_KEYS = ("token", "secret", "password", "cookie", "api_key", "authorization")
SOURCES = ("conversation", "tool_run", "external_source")


def json_text(value: Column) -> Column:
    """A string as JSON text; null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(value)), r"\A\[((?s:.*))\]\z", 1), F.lit("null"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with its keys in order, so that equal objects have equal text; the values are JSON text."""
    parts = [p for k in sorted(fields) for p in (F.lit(("{" if k == min(fields) else ", ") + f'"{k}": '), fields[k])]
    return F.concat(*parts, F.lit("}"))


def digest(fields: dict[str, Column], size: int = 64) -> Column:
    return F.left(F.sha2(canonical_json(fields), 256), F.lit(size))


def redacted(values: Column) -> Column:
    """A map of strings without the values of secret keys."""
    hidden = lambda k: F.lower(k).rlike("|".join(SECRET_KEYS))
    return F.transform_values(values, lambda k, v: F.when(hidden(k), F.lit("[REDACTED]")).otherwise(v))


def start_outcomes(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Outcomes of turn starts (seq, turn_id, session_id, query, namespace) against sessions (session_id, namespace).

    The first valid request of a turn starts it. A later one resumes it if session and query are the
    same, else it conflicts. Before that: text that is missing, unknown sessions, and a namespace
    that is not the session's. One window by turn; a turn has few requests.
    """
    s = sessions.select("session_id", F.col("namespace").alias("_own"))
    rows = requests.join(s, "session_id", "left")
    bad = (
        F.when((text_or_empty(F.col("session_id")) == "") | (text_or_empty(F.col("query")) == ""), "session_id and query are required").when(F.col("_own").isNull(), "unknown session_id")
        .when(F.col("namespace").isNotNull() & (text_or_empty(F.col("namespace")) == ""), "namespace is required").when(F.col("namespace").isNotNull() & (F.trim("namespace") != F.col("_own")), "namespace conflicts with session")
    )
    w = Window.partitionBy("turn_id")
    first = F.min_by(F.struct("session_id", F.trim("query").alias("query"), "seq"), F.when(F.col("_bad").isNull(), F.col("seq"))).over(w)
    out = rows.withColumn("_bad", bad).withColumn("_first", first)
    f = F.col("_first")
    outcome = F.coalesce(F.col("_bad"), F.when(F.col("seq") == f.seq, "started").when(F.col("session_id") != f.session_id, "turn_id conflicts with existing session_id").when(F.trim("query") != f.query, "turn_id conflicts with existing query").otherwise("resumed"))
    return out.withColumn("outcome", outcome).drop("_own", "_bad", "_first")


def trace_of_turn(turn: Column, query: Column, answer: Column) -> Column:
    """The id of a completed turn's trace: from what was said, so that the same completion has the same one."""
    fields = {"turn_id": json_text(turn), "query": json_text(F.trim(query)), "answer": json_text(F.trim(answer)), "status": F.lit('"succeeded"'), "content": F.lit("null")}
    return F.concat(F.lit("trace:"), digest(fields, 24))


def completion_outcomes(requests: DataFrame, turns: DataFrame) -> DataFrame:
    """Outcomes of completions (seq, turn_id, query, answer, status) of turns (turn_id), with trace_id.

    The first that counts is stored; the same again is deduplicated; another conflicts. A
    cancellation before it removes the turn, so that what follows is unknown; after it, it does
    nothing.
    """
    rows = requests.join(turns.select("turn_id", F.lit(True).alias("_known")).distinct(), "turn_id", "left")
    status = F.coalesce(F.nullif(text_or_empty(F.col("status")), F.lit("")), F.lit("succeeded"))
    empty = (text_or_empty(F.col("query")) == "") | (text_or_empty(F.col("answer")) == "")
    bad = F.when(~status.isin("succeeded", "cancelled"), "status must be succeeded or cancelled").when((status == "succeeded") & empty, "query and answer are required unless status is cancelled").when((status == "succeeded") & F.col("_known").isNull(), "unknown turn_id")
    rows = rows.withColumn("_bad", bad).withColumn("_cancel", F.col("_bad").isNull() & (status == "cancelled")).withColumn("trace_id", F.when(F.col("_bad").isNull() & (status == "succeeded"), trace_of_turn(F.col("turn_id"), F.col("query"), F.col("answer"))))
    w = Window.partitionBy("turn_id")
    stored = F.min(F.when(F.col("trace_id").isNotNull(), F.col("seq"))).over(w)
    gone = F.min(F.when(F.col("_cancel"), F.col("seq"))).over(w)
    rows = rows.withColumn("_stored", stored).withColumn("_gone", gone)
    removed = F.col("_gone").isNotNull() & (F.col("_stored").isNull() | (F.col("_gone") < F.col("_stored")))
    kept = F.min_by("trace_id", F.when(F.col("trace_id").isNotNull(), F.col("seq"))).over(w)
    rows = rows.withColumn("_kept", kept)
    outcome = F.coalesce(
        F.col("_bad"), F.when(F.col("_cancel"), "cancelled"), F.when(removed & (F.col("seq") > F.col("_gone")), "unknown turn_id"),
        F.when(F.col("seq") == F.col("_stored"), "stored").when(F.col("trace_id") == F.col("_kept"), "deduplicated").otherwise("turn completion conflicts with existing payload"),
    )
    return rows.withColumn("outcome", outcome).drop("_known", "_bad", "_cancel", "_stored", "_gone", "_kept")


def candidate_key(namespace: Column, answer: Column) -> Column:
    """What was said, in its normal form, within the namespace: so that it gathers evidence from many turns."""
    return F.concat(F.lit("conversation:"), namespace, F.lit(":"), digest({"value": json_text(normal_statement(F.coalesce(answer, F.lit(""))))}, 32))


def candidates_of(completed: DataFrame, state: DataFrame) -> DataFrame:
    """Candidates after completed turns (namespace, answer, episode, trace), with those there were (candidate_key, status): one for each statement, with distinct episodes and traces; rejected and promoted ones gather nothing more."""
    rows = completed.withColumn("candidate_key", candidate_key(F.col("namespace"), F.col("answer")))
    new = rows.groupBy("candidate_key").agg(F.countDistinct("episode").alias("episodes"), F.countDistinct("trace").alias("traces"))
    j = new.join(state.select("candidate_key", F.col("status").alias("_was")), "candidate_key", "full_outer")
    status, open_to = F.coalesce("_was", F.lit("pending")), F.coalesce(F.col("_was").isin("pending", "approved"), F.lit(True))
    return j.select("candidate_key", F.when(open_to, F.coalesce("episodes", F.lit(0))).otherwise(0).cast("long").alias("episodes"), F.when(open_to, F.coalesce("traces", F.lit(0))).otherwise(0).cast("long").alias("traces"), status.alias("status"))


def capture_errors(payload: DataFrame) -> DataFrame:
    """Traces (episode_id, session_id, source_type, source_id, agent_id, namespace, content, observed_at, refs): error, or trace_id and the digest of what it stands for. Identity is never made up."""
    c = lambda n: text_or_empty(F.col(n))
    kind = F.coalesce("source_type", F.lit("conversation"))
    error = (
        F.when((c("episode_id") == "") & (c("session_id") == ""), "episode_id or session_id is required; identity is never inferred").when(~kind.isin(*SOURCES), "source_type must be conversation, tool_run, or external_source")
        .when(c("content") == "", "content is required").when(F.exists(F.coalesce("refs", F.array().cast("array<string>")), lambda r: r.isNull() | (r == "")), "raw_source_refs must be a list of non-empty strings")
    )
    opt = lambda n: json_text(F.nullif(c(n), F.lit("")))
    fall = lambda n, rest: json_text(F.coalesce(F.nullif(c(n), F.lit("")), F.lit(rest)))
    identity = canonical_json({"episode_id": opt("episode_id"), "session_id": opt("session_id"), "agent_id": fall("agent_id", "unknown"), "namespace": fall("namespace", "private")})
    refs = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("refs", F.array().cast("array<string>")), lambda r: F.regexp_extract(F.to_json(F.array(r)), r"\A\[((?s:.*))\]\z", 1)), ", "), F.lit("]"))
    fields = {"identity": identity, "source_type": json_text(kind), "source_id": opt("source_id"), "content": json_text(c("content")), "raw_source_refs": refs, "observed_at": json_text(c("observed_at"))}
    out = payload.withColumn("error", error).withColumn("provenance_sha256", F.when(F.col("error").isNull(), digest(fields)))
    return out.withColumn("trace_id", F.when(F.col("error").isNull(), F.concat(F.lit("trace:"), F.left("provenance_sha256", F.lit(24)))))


def distilled(jobs: DataFrame, turns: DataFrame, candidates: DataFrame, worker: str = "to_candidate") -> DataFrame:
    """Jobs (job_id, stage, worker, status, input_ref, output_ref) run over turns (trace_id, said) and candidates (candidate_id, value): status, decision and the noise markers found.

    Both the turn and the candidate must be there; a job of another stage, or one that ended, fails.
    """
    j = jobs.join(turns.select(F.col("trace_id").alias("input_ref"), "said"), "input_ref", "left").join(candidates.select(F.col("candidate_id").alias("output_ref"), "value"), "output_ref", "left")
    other = (F.col("stage") != "distill") | (F.col("worker") != worker)
    error = F.when(other, "job is not a distillation job").when(~F.col("status").isin("queued", "pending", "running", "succeeded"), "job is not processable").when(F.col("said").isNull() | F.col("value").isNull(), "job input/output provenance could not be resolved")
    blob = F.lower(F.concat_ws("\n", "said", "value"))
    found = F.array_sort(F.filter(F.array(*[F.lit(m) for m in NOISE]), lambda m: F.contains(blob, m)))
    j = j.withColumn("error", error).withColumn("markers", F.when(F.col("error").isNull(), found))
    decision = F.when(F.col("error").isNull(), F.when(F.size("markers") > 0, "REJECT_SYSTEM_ECHO").otherwise("HOLD"))
    return j.select("job_id", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "error", F.col("error").isNotNull().alias("retryable"), decision.alias("decision"), "markers")


def promotions(events: DataFrame) -> DataFrame:
    """The status of candidates after events (candidate_id, seq, action, eligible): approve (eligible ones, or by force), reject, promote (approved ones). Rejected and promoted ones stay; forced counts approvals that were not eligible."""
    w = Window.partitionBy("candidate_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.col("eligible") | (F.col("action") == "force")
    approved = F.col("action").isin("approve", "force") & ok
    before = lambda c: F.coalesce(F.max(c.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumn("_ok", approved).withColumn("_was", before(F.col("_ok"))).withColumn("_promoted", (F.col("action") == "promote") & (F.col("_was") == 1)).withColumn("_rejected", F.col("action") == "reject")
    ends = F.col("_promoted") | F.col("_rejected")
    rows = rows.withColumn("_late", before(ends)).where("_late = 0")
    status = F.when(F.max(F.col("_promoted").cast("int")) == 1, "promoted").when(F.max(F.col("_rejected").cast("int")) == 1, "rejected").when(F.max(F.col("_ok").cast("int")) == 1, "approved").otherwise("pending")
    return rows.groupBy("candidate_id").agg(status.alias("status"), F.count_if(F.col("_ok") & ~F.col("eligible")).alias("forced"))


def released(attempts: Column, at: Column, hold: int = 30) -> tuple[Column, Column, Column]:
    """(status, attempts, not before) of a job that a worker gives back: one attempt more, and `hold` seconds of rest."""
    return F.lit("waiting"), attempts + 1, F.timestamp_seconds(F.unix_timestamp(at) + hold)


def worker_events(jobs: DataFrame) -> DataFrame:
    """What a worker's wrapper reports of each job (job_id, started, ended, failed): queued, running, and succeeded or failed, in order."""
    steps = F.array(F.struct(F.lit(0).alias("step"), F.lit("queued").alias("status"), F.col("started").alias("at")), F.struct(F.lit(1).alias("step"), F.lit("running").alias("status"), F.col("started").alias("at")), F.struct(F.lit(2).alias("step"), F.when(F.col("failed"), "failed").otherwise("succeeded").alias("status"), F.col("ended").alias("at")))
    return jobs.select("job_id", F.inline(steps))


def ready_to_join(chunks: DataFrame, group: str) -> DataFrame:
    """Groups all of whose chunk jobs ended, with how many succeeded: what waits for all of them may run."""
    ended = F.col("status").isin("succeeded", "failed", "cancelled")
    out = chunks.groupBy(group).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(ended).alias("ended"), F.count_if(F.col("status") == "succeeded").alias("succeeded"))
    return out.select(group, "chunks", "succeeded", (F.col("chunks") == F.col("ended")).alias("ready"))


class BoundedCache:
    """Answers of a provider by question, failures too; emptied when it is full."""

    def __init__(self, provider, most: int = 64):
        self.provider, self.most, self.held = provider, most, {}

    def __call__(self, question: str):
        if question not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            try:
                self.held[question] = self.provider(question)
            except Exception:  # noqa: BLE001 - any failure of a provider is kept as one
                self.held[question] = None
        return self.held[question]
