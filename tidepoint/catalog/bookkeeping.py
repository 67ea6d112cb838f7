"""Event logs and transfer bookkeeping as table jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepoint.catalog.registry import DAY, E, O, ORACLES, SECOND, query, shared_dir, table
from tidepoint.functions import identity
from tidepoint.operators import select
from tidepoint.plans import events as logs
from tidepoint.plans import transfers
from tidepoint.sources.write_replies import read_write_responses


def _event_log(spark, sf):
    """The events table as a task log; numbers run past 64 bits."""
    e = table(spark, sf, "events")
    return e.select(
        F.lit("tasks").alias("log_id"), F.lit(1).alias("schema_version"),
        F.concat(F.lit("9000000000000000000"), F.col("event_id")).alias("seq"),
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("resource_id"),
        F.col("event_id").cast("string").alias("resource_revision"), F.col("props").alias("state"),
    )


@query(
    "read_task_events",
    """
    SELECT '9000000000000000000' || event_id AS seq, event_type AS kind, CAST(user_id AS VARCHAR) AS resource_id FROM events
    WHERE event_id >= 10 AND (event_id > 77 OR length(CAST(event_id AS VARCHAR)) > 2)
    ORDER BY length(CAST(event_id AS VARCHAR)), event_id LIMIT 1000
    """,
)
def read_task_events(spark, sf):
    return logs.read_task_events(_event_log(spark, sf), "900000000000000000077").select("seq", "kind", "resource_id")


@query(
    "latest_snapshot",
    """
    SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS resource_id, CAST(max(event_id) AS VARCHAR) AS resource_revision,
           arg_max(props, event_id) AS state FROM events GROUP BY 1, 2
    """,
)
def latest_snapshot(spark, sf):
    return logs.latest_snapshot(_event_log(spark, sf)).select("kind", "resource_id", "resource_revision", "state")


@query(
    "verify_event_sequence",
    """
    WITH n AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2),
         m AS (SELECT l_orderkey, max(l_linenumber) AS top FROM n GROUP BY 1)
    SELECT CAST(l_orderkey AS VARCHAR) AS log_id, CAST(l_linenumber AS VARCHAR) AS seq, 'DUPLICATE' AS problem, c AS events FROM n WHERE c > 1
    UNION ALL
    SELECT CAST(n.l_orderkey AS VARCHAR), CAST(n.l_linenumber + 1 AS VARCHAR), 'GAP', 0 FROM n JOIN m USING (l_orderkey)
    WHERE n.l_linenumber < m.top AND NOT EXISTS (SELECT 1 FROM n o WHERE o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber + 1)
    """,
)
def verify_event_sequence(spark, sf):
    log = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("log_id"), F.lit(1).alias("schema_version"),
        F.col("l_linenumber").cast("string").alias("seq"), F.lit("LINE").alias("kind"),
        F.col("l_partkey").cast("string").alias("resource_id"), F.col("l_suppkey").cast("string").alias("resource_revision"),
    )
    return logs.verify_event_sequence(log)


def _chain(spark, sf):
    """One checkpoint per conversation turn; users cut the limits, assistants acknowledge."""
    c = table(spark, sf, "conversations")
    # A conversation has few turns, so an ordered pass per conversation is bounded.
    turns = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("off", F.sum(F.octet_length("text") + 1).over(turns).cast("string"))
    return c.select(F.col("conv_id").cast("string").alias("job_id"), "turn", "role", "off")


@query(
    "verify_checkpoint_chain",
    """
    WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) - 1 AS last FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(CASE WHEN conv_id % 8 = 2 AND p > 0 THEN p + 1 ELSE p END AS VARCHAR) AS sequence,
           CASE conv_id % 8 WHEN 1 THEN 'DIGEST' WHEN 2 THEN 'SEQUENCE' WHEN 3 THEN 'PARENT_MISSING' WHEN 4 THEN 'TRANSITION' WHEN 5 THEN 'OFFSET'
                WHEN 6 THEN 'LIMITS' ELSE 'CAUSE' END AS problem
    FROM c WHERE conv_id % 8 > 0 AND CASE WHEN conv_id % 8 = 1 THEN p = last ELSE p = 1 END
    """,
)
def verify_checkpoint_chain(spark, sf):
    """Whole chains of real digests, one for each conversation; seven of eight hold one break each, every kind of break among them."""
    turns = Window.partitionBy("job_id").orderBy("turn")  # a conversation has few turns
    c = _chain(spark, sf).withColumn("p", F.row_number().over(turns) - 1).withColumn("kind", F.col("job_id").cast("long") % 8)
    cut = (F.col("kind") == 6) & (F.col("p") == 1)
    rows = c.withColumns({
        "sequence": F.when((F.col("kind") == 2) & (F.col("p") > 0), F.col("p") + 1).otherwise(F.col("p")).cast("string"),
        "logical_offset": F.when(cut, F.lag("off").over(turns)).otherwise(F.col("off")),
        "last_settled_batch_id": F.col("role"), "last_disposition": F.lit("ACKED"), "adaptive_max_points": F.lit("5000"),
        "adaptive_max_bytes": F.lit("5242880"), "source_sha256": F.lit("s"), "staging_sha256": F.lit("t"), "normalization_version": F.lit("v1"),
        "spec_digest": F.lit("p"), "target_digest": F.lit("q"), "lossy": F.lit(False),
    })
    chained = logs.chain_checkpoints(rows, "p").withColumn("kind", F.col("job_id").cast("long") % 8)
    second = F.col("p") == 1
    last = F.col("p") == F.max("p").over(Window.partitionBy("job_id"))
    transitions = chained.where((F.col("p") > 0) & ~((F.col("kind") == 4) & second)).select(
        "job_id", F.col("parent_digest").alias("parent_checkpoint_digest"), F.col("digest").alias("child_checkpoint_digest"),
        F.when((F.col("kind") == 6) & second, "BATCH_LIMIT_REDUCED").when((F.col("kind") == 7) & second, "OTHER").otherwise("ACK").alias("cause"),
        F.concat_ws("/", "job_id", "p").alias("attempt_id"), F.lit(None).cast("string").alias("incident_id"),
    )
    attempts = c.select(F.concat_ws("/", "job_id", "p").alias("attempt_id"),
                        F.when((F.col("kind") == 5) & second, F.concat("off", F.lit("0"))).otherwise(F.col("off")).alias("end_offset"))
    incidents = attempts.where(F.lit(False)).withColumnRenamed("attempt_id", "incident_id")
    changed = chained.withColumn("lossy", (F.col("kind") == 1) & last).where(~((F.col("kind") == 3) & (F.col("p") == 0)))
    return logs.verify_checkpoint_chain(changed, transitions, attempts, incidents).select("job_id", "sequence", "problem")


@query(
    "checkpoint_digest",
    """
    SELECT CAST(conv_id AS VARCHAR) AS job_id, turn, sha256('{"schemaVersion":1,"checkpoint":{"sequence":"' || turn || '","logicalOffset":"' || off ||
      '","lastSettledBatchId":"' || role || '","adaptiveMaxPoints":"5000","adaptiveMaxBytes":"5242880","sourceSha256":"s","stagingSha256":"t",' ||
      '"normalizationVersion":"v1","specDigest":"p","targetDigest":"q","lossy":false}}') AS digest
    FROM (SELECT conv_id, turn, role, CAST(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS off FROM conversations)
    """,
)
def checkpoint_digest(spark, sf):
    c = _chain(spark, sf).withColumns({
        "sequence": F.col("turn").cast("string"), "parent_digest": F.lit(""), "logical_offset": F.col("off"),
        "last_settled_batch_id": F.col("role"), "last_disposition": F.lit(None).cast("string"),
        "adaptive_max_points": F.lit("5000"), "adaptive_max_bytes": F.lit("5242880"), "source_sha256": F.lit("s"),
        "staging_sha256": F.lit("t"), "normalization_version": F.lit("v1"), "spec_digest": F.lit("p"),
        "target_digest": F.lit("q"), "lossy": F.lit(False),
    })
    return c.select("job_id", "turn", identity.checkpoint_digest().alias("digest"))


@query(
    "list_recoverable_jobs",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderdate AS created_at FROM orders
    WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
    ORDER BY o_orderdate DESC, job_id LIMIT 500
    """,
)
def list_recoverable_jobs(spark, sf):
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "RUNNING").when(
        F.col("o_orderpriority") == "2-HIGH", "PAUSED_SAFE").otherwise("SUCCEEDED")
    jobs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"), (F.col("o_orderstatus") != "F").alias("retained"),
        state.alias("state"), F.col("o_custkey").cast("string").alias("profile_id"), F.col("o_orderdate").alias("created_at"),
    )
    return select.list_recoverable_jobs(jobs, limit=500).select("job_id", "created_at")


RESPONSES = """
    CASE event_type WHEN 'click' THEN 204 WHEN 'view' THEN 400 WHEN 'signup' THEN 413 WHEN 'purchase' THEN 401 ELSE 503 END
"""


@query(
    "classify_write_responses",
    """
    SELECT event_id, CASE event_type
        WHEN 'click' THEN CASE WHEN user_id < 50 THEN 'ACKED' ELSE 'UNKNOWN' END
        WHEN 'view' THEN 'PARTIAL' WHEN 'signup' THEN 'REJECTED_TOO_LARGE'
        WHEN 'purchase' THEN CASE WHEN value > 40 THEN 'UNKNOWN' ELSE 'REJECTED' END ELSE 'UNKNOWN' END AS outcome
    FROM events
    """,
)
def classify_write_responses(spark, sf):
    return transfers.classify_write_responses(_replies(spark, sf)).select("event_id", "outcome")


@query("write_responses_files", ORACLES["classify_write_responses"].replace("SELECT event_id,", "SELECT CAST(event_id AS VARCHAR) AS batch_id,"))
def write_responses_files(spark, sf):
    """The same replies captured in files and read back."""
    path = shared_dir(spark, "replies")
    _replies(spark, sf).select(
        F.col("event_id").cast("string").alias("batch_id"), "status", "body", F.col("content_length").alias("contentLength")
    ).write.json(path)
    return read_write_responses(spark, path).select("batch_id", "outcome")


def _replies(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    status = F.when(kind == "click", 204).when(kind == "view", 400).when(kind == "signup", 413).when(kind == "purchase", 401).otherwise(503)
    body = (
        F.when(kind == "click", F.when(F.col("user_id") < 50, F.lit("")).otherwise(F.col("props")))
        .when(kind == "view", F.concat(F.lit('{"results":[{"Error":"Partial Write: dropped='), F.col("user_id"), F.lit('"}]}')))
        .when(kind == "purchase", F.when(F.col("value") > 40, F.concat(F.col("props"), F.lit("}"))).otherwise(F.col("props")))
        .otherwise(F.col("props"))
    )
    return e.select("event_id", status.alias("status"), body.alias("body"), F.octet_length(body).cast("bigint").alias("content_length"))


@query(
    "reduce_batch_limits",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS job_id, least(k, 3) AS sequence, o_custkey AS logical_offset,
           CAST(10 >> CAST(least(k, 3) AS BIGINT) AS BIGINT) AS adaptive_max_points, CAST(5242880 >> CAST(least(k, 3) AS BIGINT) AS BIGINT) AS adaptive_max_bytes,
           CASE WHEN k > 3 THEN 'FAILED' ELSE 'RUNNING' END AS state
    FROM (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS k FROM orders)
    """,
)
def reduce_batch_limits(spark, sf):
    jobs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.lit(0).cast("bigint").alias("sequence"),
        F.col("o_custkey").alias("logical_offset"), F.lit(10).cast("bigint").alias("adaptive_max_points"),
        F.lit(5242880).cast("bigint").alias("adaptive_max_bytes"),
    )
    cuts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("job_id")).agg(
        F.count(F.lit(1)).alias("too_large_count"))
    return transfers.reduce_batch_limits(jobs, cuts).drop("last_disposition")


SETTLED = """
    WITH c AS (SELECT conv_id, turn, role, text, CAST(sum(CASE WHEN role = 'assistant' THEN strlen(text) + 1 ELSE 0 END)
                      OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS after_turn FROM conversations),
         s AS (SELECT conv_id, turn + 1 AS n, after_turn,
                 after_turn - CASE WHEN role = 'assistant' THEN strlen(text) + 1 ELSE 0 END AS off,
                 CASE WHEN role = 'assistant' THEN 'ACKED' WHEN role = 'system' THEN 'PARTIAL' ELSE 'REJECTED_TOO_LARGE' END AS outcome,
                 sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS cuts,
                 max(after_turn) OVER (PARTITION BY conv_id) AS total FROM c),
         f AS (SELECT conv_id, min(n) AS stop FROM s WHERE outcome = 'PARTIAL' OR (outcome = 'REJECTED_TOO_LARGE' AND cuts > 3) GROUP BY 1)
"""


@query(
    "apply_settlements",
    SETTLED + """
    SELECT CAST(s.conv_id AS VARCHAR) AS job_id, count(*) FILTER (WHERE s.n < coalesce(stop, 1000000)) AS sequence,
           coalesce(max(after_turn) FILTER (WHERE s.n < coalesce(stop, 1000000)), 0) AS logical_offset,
           CAST(8 >> CAST(count(*) FILTER (WHERE s.n < coalesce(stop, 1000000) AND outcome = 'REJECTED_TOO_LARGE') AS BIGINT) AS BIGINT) AS adaptive_max_points,
           CASE WHEN bool_or(s.n = stop AND outcome = 'PARTIAL') THEN 'NEEDS_PARTIAL_DECISION'
                WHEN max(stop) IS NOT NULL THEN 'FAILED'
                WHEN max(after_turn) = max(total) THEN 'SUCCEEDED' ELSE 'RUNNING' END AS state
    FROM s LEFT JOIN f USING (conv_id) GROUP BY s.conv_id
    """,
)
def apply_settlements(spark, sf):
    c = table(spark, sf, "conversations")
    turns = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("role") == "assistant", F.octet_length("text") + 1).otherwise(0).cast("bigint")
    c = c.withColumn("step", step).withColumn("after", F.sum("step").over(turns))
    settled = c.select(
        F.col("conv_id").cast("string").alias("job_id"), (F.col("turn") + 1).alias("n"),
        F.concat_ws("/", "conv_id", "turn").alias("batch_id"), (F.col("after") - F.col("step")).alias("start_offset"),
        (F.col("after") - F.col("step") + F.octet_length("text") + 1).alias("end_offset"),
        F.when(F.col("role") == "assistant", "ACKED").when(F.col("role") == "system", "PARTIAL").otherwise("REJECTED_TOO_LARGE").alias("outcome"),
    )
    zero = F.lit(0).cast("bigint")
    jobs = c.groupBy(F.col("conv_id").cast("string").alias("job_id")).agg(F.max("after").alias("staging_size")).select(
        "job_id", zero.alias("sequence"), zero.alias("logical_offset"), F.lit(8).cast("bigint").alias("adaptive_max_points"),
        F.lit(5242880).cast("bigint").alias("adaptive_max_bytes"), "staging_size",
    )
    out = transfers.apply_settlements(jobs, settled)
    return out.select("job_id", "sequence", "logical_offset", "adaptive_max_points", "state")


@query(
    "resolve_incidents",
    """
    WITH i AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'PARTIAL' ELSE 'UNKNOWN' END AS kind,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'REPLAY_EXACT' WHEN '2-HIGH' THEN 'ASSUME_COMMITTED' WHEN '3-MEDIUM' THEN 'ACCEPT_PARTIAL'
             WHEN '4-NOT SPECIFIED' THEN 'ABORT' ELSE 'OTHER' END AS decision FROM orders),
      k AS (SELECT *, CASE WHEN decision IN ('REPLAY_EXACT', 'ABORT') THEN NULL
                           WHEN decision = 'ASSUME_COMMITTED' AND kind = 'UNKNOWN' THEN NULL
                           WHEN decision = 'ACCEPT_PARTIAL' AND kind = 'PARTIAL' THEN NULL ELSE 'IMPORT_STATE_CONFLICT' END AS code FROM i)
    SELECT CAST(o_orderkey AS VARCHAR) AS incident_id, code,
      CASE WHEN code IS NOT NULL THEN 'OPEN' WHEN decision = 'ABORT' THEN 'ABORTED' WHEN decision = 'REPLAY_EXACT' THEN 'OPEN' ELSE 'RESOLVED' END AS incident_status,
      CASE WHEN code IS NOT NULL THEN CASE WHEN kind = 'PARTIAL' THEN 'NEEDS_PARTIAL_DECISION' ELSE 'NEEDS_UNKNOWN_DECISION' END
           WHEN decision = 'ABORT' THEN 'ABORTED' WHEN decision = 'REPLAY_EXACT' THEN 'RUNNING'
           WHEN o_orderstatus = 'F' THEN 'PAUSED_SAFE' ELSE 'RUNNING' END AS state,
      CASE WHEN code IS NULL AND decision IN ('ASSUME_COMMITTED', 'ACCEPT_PARTIAL') THEN o_custkey + 100 ELSE o_custkey END AS logical_offset,
      code IS NULL AND decision = 'ACCEPT_PARTIAL' AS lossy
    FROM k
    """,
)
def resolve_incidents(spark, sf):
    o = table(spark, sf, "orders")
    key, partial = F.col("o_orderkey").cast("string"), F.col("o_orderstatus") == "P"
    jobs = o.select(
        key.alias("job_id"), F.when(partial, "NEEDS_PARTIAL_DECISION").otherwise("NEEDS_UNKNOWN_DECISION").alias("state"),
        F.lit(5).cast("bigint").alias("sequence"), F.col("o_custkey").alias("logical_offset"), F.sha2(key, 256).alias("checkpoint_digest"),
        F.lit(False).alias("lossy"),
    )
    incidents = o.select(
        key.alias("incident_id"), key.alias("job_id"), F.when(partial, "PARTIAL").otherwise("UNKNOWN").alias("kind"),
        F.lit("OPEN").alias("status"), F.sha2(key, 256).alias("parent_checkpoint_digest"), F.lit("b").alias("batch_id"),
        F.col("o_custkey").alias("start_offset"), (F.col("o_custkey") + 100).alias("end_offset"),
    )
    p = F.col("o_orderpriority")
    decision = F.when(p == "1-URGENT", "REPLAY_EXACT").when(p == "2-HIGH", "ASSUME_COMMITTED").when(
        p == "3-MEDIUM", "ACCEPT_PARTIAL").when(p == "4-NOT SPECIFIED", "ABORT").otherwise("OTHER")
    decisions = o.select(key.alias("incident_id"), decision.alias("decision"),
                         F.when(F.col("o_orderstatus") == "F", "PAUSE").otherwise("CONTINUE").alias("after_resolution"))
    out = transfers.resolve_incidents(jobs, incidents, decisions)
    return out.select("incident_id", "code", "incident_status", "state", "logical_offset", "lossy")


def _import_jobs(spark, sf):
    p = F.col("o_orderpriority")
    state = F.when(p == "1-URGENT", "RUNNING").when(p == "2-HIGH", "STAGING").when(p == "3-MEDIUM", "PREFLIGHTING").when(
        p == "5-LOW", "SUCCEEDED").otherwise("RUNNING")
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), state.alias("state"))
    attempts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("job_id")).agg(
        F.min("l_linestatus").alias("s"), F.min("l_partkey").alias("start_offset")
    ).select(
        "job_id", F.concat(F.lit("a"), "job_id").alias("attempt_id"), F.lit("b").alias("batch_id"), F.lit("r").alias("run_segment_id"),
        F.when(F.col("s") == "F", "SENDING").otherwise("ACKED").alias("state"), F.lit("d").alias("parent_checkpoint_digest"),
        "start_offset", (F.col("start_offset") + 10).alias("end_offset"), F.lit("p").alias("payload_digest"),
    )
    return jobs, attempts


IMPORT_JOBS = """
    (SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
        CASE o_orderpriority WHEN '2-HIGH' THEN 'STAGING' WHEN '3-MEDIUM' THEN 'PREFLIGHTING' WHEN '5-LOW' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS state,
        EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AS flying,
        (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS start_offset FROM orders)
"""


@query(
    "recover_imports",
    f"""
    SELECT job_id, state AS old_state, CASE WHEN state IN ('STAGING', 'PREFLIGHTING') THEN 'PAUSED_RESTAGE'
        WHEN state = 'RUNNING' AND flying THEN 'NEEDS_UNKNOWN_DECISION' WHEN state = 'RUNNING' THEN 'PAUSED_SAFE' ELSE state END AS state,
        CASE WHEN state IN ('STAGING', 'PREFLIGHTING') THEN 'RESTAGE_REQUIRED'
        WHEN state = 'RUNNING' AND flying THEN 'UNKNOWN_ON_RESTART' WHEN state = 'RUNNING' THEN 'LOST_ON_RESTART' END AS code
    FROM {IMPORT_JOBS}
    """,
)
def recover_imports(spark, sf):
    return transfers.recover_imports(*_import_jobs(spark, sf))[0]


@query(
    "recover_incidents",
    f"""SELECT job_id, 'a' || job_id AS attempt_id, 'UNKNOWN' AS kind, 'OPEN' AS status, start_offset, start_offset + 10 AS end_offset
    FROM {IMPORT_JOBS} WHERE state = 'RUNNING' AND flying""",
)
def recover_incidents(spark, sf):
    opened = transfers.recover_imports(*_import_jobs(spark, sf))[1]
    return opened.select("job_id", "attempt_id", "kind", "status", "start_offset", "end_offset")


@query(
    "recover_attempts",
    """
    SELECT 'a' || l_orderkey AS attempt_id, CASE WHEN min(l_linestatus) = 'F' THEN 'UNKNOWN' ELSE 'ACKED' END AS state
    FROM lineitem GROUP BY l_orderkey
    """,
)
def recover_attempts(spark, sf):
    return transfers.recover_attempts(_import_jobs(spark, sf)[1]).select("attempt_id", "state")


@query(
    "recover_segments",
    f"""
    SELECT job_id, CASE WHEN state = 'RUNNING' THEN 'CLOSED' ELSE 'ACTIVE' END AS state,
           CASE WHEN state = 'RUNNING' THEN NULL ELSE 'a' || job_id END AS active_attempt_id,
           CASE WHEN state = 'RUNNING' THEN 'LOST_ON_RESTART' END AS stop_reason FROM {IMPORT_JOBS}
    """,
)
def recover_segments(spark, sf):
    jobs, _ = _import_jobs(spark, sf)
    segments = jobs.select(
        "job_id", F.lit("ACTIVE").alias("state"), F.concat(F.lit("a"), "job_id").alias("active_attempt_id"),
        F.lit(None).cast("string").alias("stop_reason"),
    )
    return transfers.recover_segments(segments, jobs).select("job_id", "state", "active_attempt_id", "stop_reason")


@query(
    "recover_tasks",
    """
    SELECT CAST(event_id AS VARCHAR) AS id,
      CASE WHEN event_type = 'click' THEN 'INTERRUPTED'
           WHEN event_type = 'view' THEN CASE WHEN value > 60 THEN 'INTERRUPTED_NOT_SENT' ELSE 'OUTCOME_UNKNOWN' END
           WHEN event_type = 'error' THEN 'PAUSED_RESTARTABLE' ELSE CASE WHEN value > 60 THEN 'QUEUED' ELSE 'DISPATCHING' END END AS state,
      event_type IN ('click', 'view', 'signup') AS terminal, event_type IN ('click', 'view', 'error') AS changed
    FROM events
    """,
)
def recover_tasks(spark, sf):
    kind = F.col("event_type")
    tasks = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(kind == "click", "QUERY").when(kind == "view", "OPERATION").when(kind == "error", "EXPORT")
        .when(kind == "signup", "QUERY").otherwise("IMPORT").alias("kind"),
        F.when(F.col("value") > 60, "QUEUED").otherwise("DISPATCHING").alias("state"), (kind == "signup").alias("terminal"),
    )
    return transfers.recover_tasks(tasks).select("id", "state", "terminal", "changed")


def _export_tables(spark, sf):
    o = table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "P", "QUEUED").otherwise("SUCCEEDED")
    jobs = o.select(F.col("o_orderkey").cast("string").alias("job_id"), state.alias("state"))
    parts = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"), F.col("l_linenumber").alias("ordinal"),
        F.when(F.col("l_linestatus") == "F", "WRITING").otherwise("COMPLETE").alias("state"),
    )
    return jobs, parts


@query(
    "recover_exports",
    "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'PAUSED_RESTARTABLE' ELSE 'SUCCEEDED' END AS state, "
    "CASE WHEN o_orderstatus IN ('O', 'P') THEN 'LOST_ON_RESTART' END AS code FROM orders",
)
def recover_exports(spark, sf):
    return transfers.recover_exports(*_export_tables(spark, sf))[0].select("job_id", "state", "code")


@query(
    "recover_fragments",
    """
    SELECT CAST(l_orderkey AS VARCHAR) AS job_id, l_linenumber AS ordinal,
           CASE WHEN l_linestatus = 'F' THEN CASE WHEN o_orderstatus IN ('O', 'P') THEN 'CORRUPT' ELSE 'WRITING' END ELSE 'COMPLETE' END AS state
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    """,
)
def recover_fragments(spark, sf):
    return transfers.recover_exports(*_export_tables(spark, sf))[1].select("job_id", "ordinal", "state")


def _requests(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("request_digest"),
        F.concat(F.lit("r"), F.col("event_id")).alias("resource_id"), F.col("event_id").alias("arrival"),
    )
    ledger = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").cast("string").alias("scope"), F.lit("click").alias("request_digest"),
        F.concat(F.lit("c"), F.col("c_custkey")).alias("resource_id"),
    )
    return e, ledger


@query(
    "admit_once",
    """
    WITH f AS (SELECT user_id, min(event_id) AS first, arg_min(event_type, event_id) AS digest FROM events GROUP BY 1),
         w AS (SELECT f.user_id, c_custkey, first, CASE WHEN c_custkey IS NULL THEN digest ELSE 'click' END AS digest,
                      CASE WHEN c_custkey IS NULL THEN 'r' || first ELSE 'c' || c_custkey END AS owner
               FROM f LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = user_id)
    SELECT event_id AS arrival, CASE WHEN c_custkey IS NULL AND event_id = first THEN 'NEW' WHEN event_type = digest THEN 'REPLAY' ELSE 'CONFLICT' END AS decision,
           CASE WHEN event_type = digest THEN owner END AS owner_id
    FROM events JOIN w USING (user_id)
    """,
)
def admit_once(spark, sf):
    return transfers.admit_once(*_requests(spark, sf)).select("arrival", "decision", "owner_id")


def _sessions(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_custkey").cast("string").alias("profile_id"),
        (F.col("o_orderstatus") != "O").alias("terminal"), F.lit(True).alias("complete"), F.lit(False).alias("closed"),
        (F.col("o_orderpriority") == "1-URGENT").alias("archived"),
        F.when(F.col("o_orderstatus") != "O", F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("terminal_at_ns"),
    )


SWEEP_NOW = 996_624_000 * SECOND  # 2001-08-01T00:00:00Z


@query(
    "sweep_retention",
    f"""
    WITH s AS (SELECT *, o_orderstatus <> 'O' AND {SWEEP_NOW} - time_ns >= 90 * {DAY} AS purge,
                 o_orderstatus <> 'O' AND o_orderpriority <> '1-URGENT' AND {SWEEP_NOW} - time_ns >= {DAY} AS blank FROM {O})
    SELECT CAST(o_orderkey AS VARCHAR) AS session_id, CASE WHEN NOT blank THEN CAST(o_custkey AS VARCHAR) END AS profile_id,
           NOT blank AS complete, blank AS closed, o_orderpriority = '1-URGENT' OR blank AS archived FROM s WHERE NOT purge
    """,
)
def sweep_retention(spark, sf):
    kept, _ = transfers.sweep_retention(_sessions(spark, sf), SWEEP_NOW)
    return kept.select("session_id", "profile_id", "complete", "closed", "archived")


@query(
    "purge_ledger",
    f"""
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM {O} WHERE o_orderkey = l_orderkey AND l_returnflag <> 'N'
        AND o_orderstatus <> 'O' AND {SWEEP_NOW} - time_ns >= 90 * {DAY})
    """,
)
def purge_ledger(spark, sf):
    _, purged = transfers.sweep_retention(_sessions(spark, sf), SWEEP_NOW)
    ledger = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("resource_id"),
        F.when(F.col("l_returnflag") == "N", "IMPORT").otherwise("QUERY").alias("resource_kind"), "l_orderkey", "l_linenumber",
    )
    return transfers.purge_ledger(ledger, purged).select("l_orderkey", "l_linenumber")
