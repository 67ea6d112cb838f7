"""Event log jobs: slices of the log, sequence checks, newest states, checkpoint chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepoint.functions import identity, numbers

# Fixed value: longest page of events.
MAX_EVENTS = 1000


def read_task_events(events: DataFrame, after: str, limit: int = MAX_EVENTS) -> DataFrame:
    """The next events after a sequence number, at most 1000, in order (a top-k, not a full sort)."""
    if not after.isdigit() or (len(after) > 1 and after[0] == "0"):
        raise ValueError("not a canonical decimal")
    if not 0 < limit <= MAX_EVENTS:
        raise ValueError(f"a page holds 1 to {MAX_EVENTS} events, not {limit}")
    later = numbers.compare_decimal(F.col("seq"), F.lit(after)) > 0
    return events.where(later).orderBy(*numbers.decimal_order(F.col("seq"))).limit(limit)


def valid_event() -> F.Column:
    return F.coalesce(
        (F.col("schema_version") == 1)
        & numbers.is_canonical_decimal(F.col("seq"))
        & numbers.is_canonical_decimal(F.col("resource_revision"))
        & F.col("kind").isNotNull() & (F.col("resource_id") != ""),
        F.lit(False),
    )


def verify_event_sequence(events: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Problems of event logs: log_id, seq, problem (GAP, DUPLICATE, INVALID), events.

    A GAP row names the first missing number of each hole. `after` (log_id, seq) is the last
    number seen before these events; without it a log may start anywhere.

    Every event announces its own number and asks for the next one; one aggregation per
    (log, number) shows which was asked for and not there. It combines on the map side and
    spreads even a single long log over all tasks, which an ordered window would not.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def claim(seq, have, want, bad):
        return F.struct(seq.alias("seq"), have.alias("have"), want.alias("want"), bad.alias("bad"))

    seq = F.col("seq")
    claims = events.select("log_id", F.explode(
        F.when(valid_event(), F.array(claim(seq, one, zero, zero), claim(numbers.increment_decimal(seq), zero, one, zero)))
        .otherwise(F.array(claim(seq, zero, zero, one)))
    ).alias("c")).select("log_id", "c.*")
    if after is not None:
        claims = claims.unionByName(after.select("log_id", claim(numbers.increment_decimal(seq), zero, one, zero).alias("c")).select("log_id", "c.*"))
    per_number = claims.groupBy("log_id", "seq").agg(
        F.sum("have").alias("have"), F.max("want").alias("want"), F.sum("bad").alias("bad"))
    # The numbers that are there name the head too: both sides below share one scan and one shuffle.
    heads = per_number.groupBy("log_id").agg(
        F.max(F.when(F.col("have") > 0, F.struct(F.length("seq").alias("n"), seq.alias("seq")))).alias("head")
    ).select("log_id", F.col("head.seq").alias("head"))
    # Few rows reach this join: numbers that are missing, doubled or invalid, and one end mark per log.
    odd = per_number.where((F.col("have") != 1) | (F.col("bad") > 0)).join(heads, "log_id")
    gap = (F.col("have") == 0) & (F.col("want") > 0) & (numbers.compare_decimal(seq, F.col("head")) <= 0)
    found = F.array_compact(F.array(
        F.when(F.col("have") > 1, F.struct(F.lit("DUPLICATE").alias("problem"), F.col("have").alias("events"))),
        F.when(gap, F.struct(F.lit("GAP").alias("problem"), F.col("have").alias("events"))),
        F.when(F.col("bad") > 0, F.struct(F.lit("INVALID").alias("problem"), F.col("bad").alias("events"))),
    ))
    return odd.select("log_id", "seq", F.explode(found).alias("p")).select("log_id", "seq", "p.problem", "p.events")


def latest_snapshot(events: DataFrame) -> DataFrame:
    """Newest state per (kind, resource): a map-side max, no sort."""
    order = F.struct(
        F.length("resource_revision").alias("a"), F.col("resource_revision").alias("b"),
        F.length("seq").alias("c"), F.col("seq").alias("d"),
    )
    rest = [c for c in events.columns if c not in ("kind", "resource_id")]
    newest = events.groupBy("kind", "resource_id").agg(
        F.max_by(F.struct(*rest), order).alias("newest")
    )
    return newest.select("kind", "resource_id", "newest.*")


def chain_checkpoints(checkpoints: DataFrame, position: str) -> DataFrame:
    """`checkpoints` (job_id, a 0-based position, checkpoint columns but parent_digest) with parent_digest and digest.

    A digest covers its parent's, so each job's digests are folded in order, over its list of checkpoints: one for each batch that was
    settled, a few hundred bytes each.
    """
    names = [c for c, _, _ in identity.CHECKPOINT_KEYS if c != "parent_digest"]
    lists = checkpoints.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(position, *names))).alias("_steps"))

    def parent(done):
        return F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))

    def step(done, x):
        own = identity.checkpoint_digest(member=lambda c: parent(done) if c == "parent_digest" else x[c])
        return F.concat(done, F.array(own))

    digests = lists.withColumn("_digests", F.aggregate("_steps", F.array().cast("array<string>"), step))
    before = F.try_element_at("_digests", F.col("_at"))
    return digests.select("job_id", "_digests", F.posexplode("_steps").alias("_at", "_x")).select(
        "job_id", f"_x.{position}", *[f"_x.{c}" for c in names], F.when(F.col("_at") > 0, before).alias("parent_digest"),
        F.get("_digests", "_at").alias("digest"))


def verify_checkpoint_chain(
    checkpoints: DataFrame, transitions: DataFrame, attempts: DataFrame, incidents: DataFrame,
    check_digest: bool = True,
) -> DataFrame:
    """Broken links of import checkpoint chains: job_id, digest, sequence, problem.

    checkpoints(job_id, digest + checkpoint columns), transitions(job_id, cause,
    parent_checkpoint_digest, child_checkpoint_digest, attempt_id, incident_id),
    attempts(attempt_id, end_offset), incidents(incident_id, end_offset).
    Each link is found by its digests, so a long chain needs no ordered pass. check_digest=False
    trusts the stored digests (for tables digested under another rule).
    """
    c = checkpoints.withColumn("_own", identity.checkpoint_digest()).alias("c")
    p = checkpoints.select(
        F.col("job_id").alias("p_job"), F.col("digest").alias("p_digest"),
        F.col("sequence").alias("p_sequence"), F.col("logical_offset").alias("p_offset"),
        F.col("adaptive_max_points").alias("p_points"), F.col("adaptive_max_bytes").alias("p_bytes"),
    )
    t = transitions.select(
        F.col("job_id").alias("t_job"), F.col("child_checkpoint_digest").alias("t_child"), "cause",
        F.col("parent_checkpoint_digest").alias("t_parent"), "attempt_id", "incident_id",
    )
    a = attempts.select("attempt_id", F.col("end_offset").alias("a_end"))
    i = incidents.select("incident_id", F.col("end_offset").alias("i_end"))
    joined = (
        c.join(p, (F.col("c.job_id") == F.col("p_job")) & (F.col("c.parent_digest") == F.col("p_digest")), "left")
        .join(t, (F.col("c.job_id") == F.col("t_job")) & (F.col("c.digest") == F.col("t_child")), "left")
        .join(a, "attempt_id", "left").join(i, "incident_id", "left")
    )
    first = F.coalesce(F.col("c.parent_digest"), F.lit("")) == ""
    settled = F.col("cause").isin("ACK", "REPLAY_ACK")
    decided = F.col("cause").isin("ASSUME_COMMITTED", "ACCEPT_PARTIAL")
    cut = F.col("cause") == "BATCH_LIMIT_REDUCED"

    def half(column):
        n = F.col(column).try_cast("decimal(38,0)")
        return F.greatest(F.floor(n / 2), F.lit(1)).cast("string")

    problem = (
        F.when(F.lit(check_digest) & (F.col("_own") != F.col("c.digest")), "DIGEST")
        .when(first & (F.col("c.sequence") != "0"), "SEQUENCE")
        .when(first, F.lit(None))
        .when(F.col("p_digest").isNull(), "PARENT_MISSING")
        .when(F.col("t_child").isNull() | (F.col("t_parent") != F.col("c.parent_digest")), "TRANSITION")
        .when(numbers.increment_decimal(F.col("p_sequence")) != F.col("c.sequence"), "SEQUENCE")
        .when(settled & ~F.col("c.logical_offset").eqNullSafe(F.col("a_end").cast("string")), "OFFSET")
        .when(decided & ~F.col("c.logical_offset").eqNullSafe(F.col("i_end").cast("string")), "OFFSET")
        .when(cut & (F.col("c.logical_offset") != F.col("p_offset")), "OFFSET")
        .when(cut & ((F.col("c.adaptive_max_points") != half("p_points"))
                     | (F.col("c.adaptive_max_bytes") != half("p_bytes"))), "LIMITS")
        .when(~F.coalesce(settled | decided | cut, F.lit(False)), "CAUSE")
    )
    return joined.select(
        F.col("c.job_id").alias("job_id"), F.col("c.digest").alias("digest"),
        F.col("c.sequence").alias("sequence"), problem.alias("problem"),
    ).where(F.col("problem").isNotNull())
