"""Transfer bookkeeping: settlements, incidents, recovery, admission, retention."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepoint.functions import identity
from tidepoint.model import NS_PER_DAY, NS_PER_SECOND

# --- Fixed values: outcomes and states ------------------------------------------
ACKED = "ACKED"
TOO_LARGE = "REJECTED_TOO_LARGE"
PARTIAL = "PARTIAL"
REJECTED = "REJECTED"
UNKNOWN = "UNKNOWN"
RUNNING = "RUNNING"
SUCCEEDED = "SUCCEEDED"
FAILED = "FAILED"
NEEDS_PARTIAL = "NEEDS_PARTIAL_DECISION"
NEEDS_UNKNOWN = "NEEDS_UNKNOWN_DECISION"
OFFSET_CONFLICT = "IMPORT_OFFSET_CONFLICT"
STATE_CONFLICT = "IMPORT_STATE_CONFLICT"
CHECKPOINT_CONFLICT = "IMPORT_CHECKPOINT_CONFLICT"
DETAIL_RETENTION_NS = 24 * 3600 * NS_PER_SECOND
RESOURCE_RETENTION_NS = 90 * NS_PER_DAY

_BODY = T.StructType([
    T.StructField("valid", T.BooleanType()),
    T.StructField("partial", T.BooleanType()),
    T.StructField("has_error", T.BooleanType()),
])


def _body_verdict(body: str) -> tuple[bool, bool, bool]:
    """(valid, partial, has_error) of one reply body.

    The parser reports every object, at any depth, so the two members of interest are
    gathered while it reads; the verdict is then a statement about the two lists.
    """
    found: dict[str, list] = {"partial": [], "error": []}

    def gather(pairs):
        for name, value in pairs:
            found.get(name.lower(), []).append(value)
        return gather  # stands for "an object"

    try:
        root = json.loads(body, object_pairs_hook=gather, parse_constant=int)
    except (ValueError, RecursionError):
        return False, False, False
    errors = [e for e in found["error"] if e is not None]
    texts = [e for e in errors if isinstance(e, str)]
    valid = root is gather and len(texts) == len(errors) and all(isinstance(p, bool) for p in found["partial"])
    partial = any(p is True for p in found["partial"]) or any("partial write" in e.lower() for e in texts)
    return valid, partial and root is gather, bool(texts) and root is gather


@F.pandas_udf(_BODY)
def _body_verdicts(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_body_verdict(b) if b else (True, False, False) for b in bodies], columns=["valid", "partial", "has_error"])


def inspect_body(body: Column) -> Column:
    """Verdict of reply bodies; empty ones, the usual reply, never reach Python as text."""
    return _body_verdicts(F.when(F.octet_length(body) > 0, body))


def classify_write_responses(responses: DataFrame, success: tuple[int, ...] = ()) -> DataFrame:
    """Rows (status, body, content_length) plus `outcome`. 204 is always a success code."""
    allowed = (204, *success)
    status = F.col("status")
    seen = responses.withColumn("_b", inspect_body(F.col("body")))
    clear = F.col("_b.valid") & ~F.col("_b.partial") & ~F.col("_b.has_error")
    spoiled = (status == 204) & (
        (F.coalesce(F.octet_length("body"), F.lit(0)) > 0) | (F.coalesce("content_length", F.lit(0)) > 0)
    )
    client_error = (status >= 400) & (status <= 499)
    outcome = (
        F.when(status.isNull() | (status >= 500), UNKNOWN)
        .when(client_error & F.col("_b.partial"), PARTIAL)
        .when((status == 413) & F.col("_b.valid"), TOO_LARGE)
        .when(client_error & F.col("_b.valid"), REJECTED)
        .when(status.isin(*allowed) & ~spoiled & clear, ACKED)
        .otherwise(UNKNOWN)
    )
    return seen.withColumn("outcome", outcome).drop("_b")


def halved(value: Column, times: Column) -> Column:
    """Integer halving `times` times, never below 1."""
    power = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(times, F.lit(62)).cast("int"))
    quotient = (value - F.pmod(value, power)) / power
    return F.greatest(F.lit(1).cast("bigint"), quotient.cast("bigint"))


def reduce_batch_limits(checkpoints: DataFrame, cuts: DataFrame) -> DataFrame:
    """checkpoints(job_id, sequence, logical_offset, adaptive_max_points, adaptive_max_bytes) and
    cuts(job_id, too_large_count) -> limits after that many too-large replies.

    The offset stays. A too-large reply when the limit is one point fails the job.
    """
    joined = checkpoints.join(cuts, "job_id", "left").withColumn("_k", F.coalesce("too_large_count", F.lit(0)))
    possible = F.floor(F.log2(F.col("adaptive_max_points"))).cast("bigint")
    used = F.least(F.col("_k"), possible)
    return joined.select(
        "job_id",
        (F.col("sequence") + used).alias("sequence"),
        "logical_offset",
        halved(F.col("adaptive_max_points"), used).alias("adaptive_max_points"),
        halved(F.col("adaptive_max_bytes"), used).alias("adaptive_max_bytes"),
        F.when(F.col("_k") > possible, FAILED).otherwise(RUNNING).alias("state"),
        F.when(F.col("_k") > 0, TOO_LARGE).alias("last_disposition"),
    )


def _with_stop(checkpoints: DataFrame, settled: DataFrame) -> DataFrame:
    """Settlements with `_stop`, why processing ends at this row, and nothing else ordered.

    A row is continuous when it starts where its predecessor (n - 1) left the offset; the
    predecessor is found by an equality join on (job, n), which spreads a long job.
    """
    left_at = F.when(F.col("outcome") == ACKED, F.col("end_offset")).otherwise(F.col("start_offset"))
    before = settled.select("job_id", (F.col("n") + 1).alias("n"), left_at.alias("_left"))
    start = checkpoints.select("job_id", F.lit(1).cast("bigint").alias("n"), F.col("logical_offset").alias("_left"))
    rows = settled.join(before.unionByName(start), ["job_id", "n"], "left")
    # Only the first few too-large rows of a job can matter; the limit is applied before the shuffle.
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("n"))
    cuts = settled.where(F.col("outcome") == TOO_LARGE).select("job_id", "n").withColumn("_rank", rank).where(
        F.col("_rank") <= 64
    )
    points = checkpoints.select("job_id", F.floor(F.log2(F.col("adaptive_max_points"))).cast("bigint").alias("_possible"))
    fatal = cuts.join(points, "job_id").where(F.col("_rank") == F.col("_possible") + 1).select(
        "job_id", "n", F.lit(True).alias("_fatal")
    )
    rows = rows.join(fatal, ["job_id", "n"], "left")
    return rows.withColumn(
        "_stop",
        F.when(~F.col("start_offset").eqNullSafe(F.col("_left")), OFFSET_CONFLICT)
        .when(F.col("outcome") == PARTIAL, NEEDS_PARTIAL)
        .when(F.col("outcome") == UNKNOWN, NEEDS_UNKNOWN)
        .when((F.col("outcome") == REJECTED) | F.coalesce("_fatal", F.lit(False)), FAILED),
    ).drop("_left", "_fatal")


def apply_settlements(checkpoints: DataFrame, settled: DataFrame) -> DataFrame:
    """Advance each job's checkpoint over its settled batches.

    checkpoints(job_id, sequence, logical_offset, adaptive_max_points, adaptive_max_bytes,
    staging_size); settled(job_id, n = 1, 2, ..., batch_id, start_offset, end_offset, outcome).
    An acknowledged batch moves the offset, a too-large one halves the limits; the first
    partial, unknown, rejected or ill-fitting one stops the job.
    """
    rows = _with_stop(checkpoints, settled)
    stops = rows.where(F.col("_stop").isNotNull()).groupBy("job_id").agg(
        F.min(F.struct("n", "_stop")).alias("_first")
    )
    effective = rows.join(stops, "job_id", "left").where(
        F.col("_first").isNull() | (F.col("n") < F.col("_first.n"))
    )
    totals = effective.groupBy("job_id").agg(
        F.count_if(F.col("outcome") == ACKED).alias("_acks"),
        F.count_if(F.col("outcome") == TOO_LARGE).alias("_cuts"),
        F.max_by(F.col("end_offset"), F.when(F.col("outcome") == ACKED, F.col("n"))).alias("_end"),
        F.max_by(F.struct("batch_id", "outcome"), F.col("n")).alias("_last"),
    )
    j = checkpoints.join(totals, "job_id", "left").join(stops, "job_id", "left")
    zero = F.lit(0).cast("bigint")
    acks, cuts = F.coalesce("_acks", zero), F.coalesce("_cuts", zero)
    offset = F.coalesce("_end", "logical_offset")
    stop = F.col("_first._stop")
    return j.select(
        "job_id",
        (F.col("sequence") + acks + cuts).alias("sequence"),
        offset.alias("logical_offset"),
        halved(F.col("adaptive_max_points"), cuts).alias("adaptive_max_points"),
        halved(F.col("adaptive_max_bytes"), cuts).alias("adaptive_max_bytes"),
        F.col("_last.batch_id").alias("last_settled_batch_id"),
        F.col("_last.outcome").alias("last_disposition"),
        F.when(stop.isin(NEEDS_PARTIAL, NEEDS_UNKNOWN, FAILED), stop)
        .when(stop.isNull() & (offset == F.col("staging_size")), SUCCEEDED)
        .otherwise(RUNNING).alias("state"),
        F.when(stop == OFFSET_CONFLICT, stop).alias("code"),
        F.col("_first.n").alias("stopped_at"),
    )


def resolve_incidents(jobs: DataFrame, incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply one decision per open incident.

    jobs(job_id, state, sequence, logical_offset, checkpoint_digest, lossy), incidents(incident_id,
    job_id, kind, status, parent_checkpoint_digest, batch_id, start_offset, end_offset),
    decisions(incident_id, decision, after_resolution = CONTINUE or PAUSE).
    A decision that the state or the incident kind does not allow changes nothing and gets a code.
    """
    i = incidents.withColumnRenamed("job_id", "_job")
    j = decisions.join(i, "incident_id", "left").join(jobs, F.col("_job") == jobs["job_id"], "left")
    decision, kind, state = F.col("decision"), F.col("kind"), F.col("state")
    waiting = state.isin(NEEDS_PARTIAL, NEEDS_UNKNOWN)
    current = (F.col("status") == "OPEN") & (F.col("parent_checkpoint_digest") == F.col("checkpoint_digest"))
    allowed = (
        (decision.isin("REPLAY_EXACT", "ABORT") & waiting)
        | ((decision == "ASSUME_COMMITTED") & (state == NEEDS_UNKNOWN) & (kind == UNKNOWN))
        | ((decision == "ACCEPT_PARTIAL") & (state == NEEDS_PARTIAL) & (kind == PARTIAL))
    )
    code = F.when(~F.coalesce(current, F.lit(False)), CHECKPOINT_CONFLICT).when(
        ~F.coalesce(allowed, F.lit(False)), STATE_CONFLICT
    )
    ok = code.isNull()
    moves = ok & decision.isin("ASSUME_COMMITTED", "ACCEPT_PARTIAL")
    pause = F.col("after_resolution") == "PAUSE"
    return j.select(
        "incident_id",
        F.coalesce("job_id", "_job").alias("job_id"),
        "decision",
        code.alias("code"),
        F.when(~ok, F.col("status")).when(decision == "ABORT", "ABORTED")
        .when(moves, "RESOLVED").otherwise(F.col("status")).alias("incident_status"),
        F.when(~ok, state).when(decision == "ABORT", "ABORTED")
        .when(moves & pause, "PAUSED_SAFE").otherwise(RUNNING).alias("state"),
        (F.col("sequence") + moves.cast("bigint")).alias("sequence"),
        F.when(moves, F.col("end_offset")).otherwise(F.col("logical_offset")).alias("logical_offset"),
        F.when(moves & (decision == "ASSUME_COMMITTED"), "ASSUMED_COMMITTED")
        .when(moves, "ACCEPTED_PARTIAL").alias("disposition"),
        (F.col("lossy") | (moves & (decision == "ACCEPT_PARTIAL"))).alias("lossy"),
    )


def recover_imports(jobs: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a stop: (jobs with their new state, new UNKNOWN incidents).

    Jobs in PREFLIGHTING or STAGING must be staged again. A running job with a batch in
    flight needs a decision, because nobody knows whether it arrived; without one it is safe.
    """
    flying = attempts.where(F.col("state") == "SENDING").select(
        "job_id", "attempt_id", "batch_id", "run_segment_id", "parent_checkpoint_digest",
        "start_offset", "end_offset", "payload_digest",
    )
    j = jobs.join(flying, "job_id", "left")
    state = F.col("state")
    in_flight = (state == RUNNING) & F.col("attempt_id").isNotNull()
    new_state = (
        F.when(state.isin("PREFLIGHTING", "STAGING"), "PAUSED_RESTAGE")
        .when(in_flight, NEEDS_UNKNOWN).when(state == RUNNING, "PAUSED_SAFE").otherwise(state)
    )
    reason = (
        F.when(state.isin("PREFLIGHTING", "STAGING"), "RESTAGE_REQUIRED")
        .when(in_flight, "UNKNOWN_ON_RESTART").when(state == RUNNING, "LOST_ON_RESTART")
    )
    states = j.select("job_id", state.alias("old_state"), new_state.alias("state"), reason.alias("code"))
    opened = j.where(in_flight).select(
        identity.uuid5_oid(F.concat("job_id", F.lit("\0UNKNOWN\0"), "attempt_id")).alias("incident_id"),
        "job_id", F.lit(UNKNOWN).alias("kind"), F.lit("OPEN").alias("status"), "parent_checkpoint_digest",
        "run_segment_id", "batch_id", "attempt_id", "start_offset", "end_offset", "payload_digest",
    )
    return states, opened


def recover_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts in flight become UNKNOWN."""
    return attempts.withColumn("state", F.when(F.col("state") == "SENDING", UNKNOWN).otherwise(F.col("state")))


def recover_segments(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Live run segments of running jobs are closed."""
    running = jobs.where(F.col("state") == RUNNING).select("job_id", F.lit(True).alias("_run"))
    live = F.coalesce("_run", F.lit(False)) & F.col("state").isin("ACTIVE", "STOPPING")
    j = segments.join(running, "job_id", "left")
    return j.withColumn("_live", live).select(
        *[c for c in segments.columns if c not in ("state", "active_attempt_id", "stop_reason")],
        F.when(F.col("_live"), "CLOSED").otherwise(F.col("state")).alias("state"),
        F.when(~F.col("_live"), F.col("active_attempt_id")).alias("active_attempt_id"),
        F.when(F.col("_live"), "LOST_ON_RESTART").otherwise(F.col("stop_reason")).alias("stop_reason"),
    )


def recover_tasks(tasks: DataFrame) -> DataFrame:
    """Unfinished tasks (id, kind, state, terminal) -> new state; others come back unchanged."""
    kind, state, live = F.col("kind"), F.col("state"), ~F.col("terminal")
    new_state = (
        F.when(live & (kind == "QUERY"), "INTERRUPTED")
        .when(live & (kind == "OPERATION") & (state == "QUEUED"), "INTERRUPTED_NOT_SENT")
        .when(live & (kind == "OPERATION") & (state == "DISPATCHING"), "OUTCOME_UNKNOWN")
        .when(live & (kind == "EXPORT"), "PAUSED_RESTARTABLE")
    )
    changed = new_state.isNotNull()
    return tasks.select(
        "id", "kind", state.alias("old_state"), F.coalesce(new_state, state).alias("state"),
        F.when(changed, kind != "EXPORT").otherwise(F.col("terminal")).alias("terminal"),
        F.when(changed & (kind == "QUERY"), "LOST_ON_RESTART").alias("code"),
        changed.alias("changed"),
    )


def recover_exports(jobs: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queued and active exports pause; their half-written fragments become CORRUPT."""
    active = F.col("state").isin("QUEUED", "RUNNING", "FINALIZING")
    states = jobs.select(
        "job_id", F.col("state").alias("old_state"),
        F.when(active, "PAUSED_RESTARTABLE").otherwise(F.col("state")).alias("state"),
        F.when(active, "LOST_ON_RESTART").alias("code"),
    )
    paused = jobs.where(active).select("job_id", F.lit(True).alias("_paused"))
    parts = fragments.join(paused, "job_id", "left").withColumn(
        "state",
        F.when(F.coalesce("_paused", F.lit(False)) & (F.col("state") == "WRITING"), "CORRUPT").otherwise(F.col("state")),
    ).drop("_paused")
    return states, parts


def admit_once(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """requests(scope, request_digest, resource_id, arrival) against ledger(scope, request_digest,
    resource_id): decision NEW, REPLAY or CONFLICT, with the resource that the scope belongs to.

    The first request of a scope (by arrival, then resource) is found by a map-side minimum, so a scope that is retried
    very often costs one row per task.
    """
    stored = ledger.select(
        "scope", F.col("request_digest").alias("l_digest"), F.col("resource_id").alias("l_resource")
    )
    firsts = requests.groupBy("scope").agg(
        F.min(F.struct("arrival", "resource_id", "request_digest")).alias("first")
    )
    owners = firsts.join(stored, "scope", "left").select(
        "scope",
        F.coalesce("l_digest", "first.request_digest").alias("o_digest"),
        F.coalesce("l_resource", "first.resource_id").alias("o_resource"),
        F.when(F.col("l_digest").isNull(), F.col("first")).alias("o_first"),
    )
    return requests.join(owners, "scope").select(
        *requests.columns,
        F.when(
            F.struct("arrival", "resource_id", "request_digest").eqNullSafe(F.col("o_first")), "NEW")
        .when(F.col("request_digest") == F.col("o_digest"), "REPLAY")
        .otherwise("CONFLICT").alias("decision"),
        F.when(F.col("request_digest") == F.col("o_digest"), F.col("o_resource")).alias("owner_id"),
    )


def ledger_after(ledger: DataFrame, admitted: DataFrame) -> DataFrame:
    """The ledger with the newly admitted requests."""
    new = admitted.where(F.col("decision") == "NEW").select("scope", "request_digest", "resource_id")
    return ledger.select("scope", "request_digest", "resource_id").unionByName(new)


DETAIL_TEXT = (
    "profile_id", "profile_revision", "connection_id", "connection_generation",
    "statement_count", "series_count", "row_count",
)


def sweep_retention(sessions: DataFrame, now_ns: int) -> tuple[DataFrame, DataFrame]:
    """(kept sessions, purged session ids). Finished sessions lose their details after 24 hours
    and everything after 90 days; both borders count as reached."""
    ended = F.col("terminal") & F.col("terminal_at_ns").isNotNull()
    age = F.lit(now_ns).cast("bigint") - F.col("terminal_at_ns")
    purge = F.coalesce(ended & (age >= RESOURCE_RETENTION_NS), F.lit(False))
    blank = F.coalesce(ended & ~F.col("archived") & (age >= DETAIL_RETENTION_NS), F.lit(False))
    kept = sessions.where(~purge)
    columns = []
    for name in sessions.columns:
        c = F.col(name)
        if name in DETAIL_TEXT:
            c = F.when(~blank, c)
        elif name in ("has_statement_errors", "complete", "result_available"):
            c = c & ~blank
        elif name in ("closed", "archived"):
            c = c | blank
        columns.append(c.alias(name))
    return kept.select(*columns), sessions.where(purge).select("session_id")


def purge_ledger(ledger: DataFrame, purged: DataFrame) -> DataFrame:
    """Ledger rows whose query session is still there."""
    gone = purged.select(F.col("session_id").alias("resource_id"), F.lit("QUERY").alias("resource_kind"))
    return ledger.join(gone, ["resource_kind", "resource_id"], "left_anti")
