"""Incremental secret scan: a ledger of (blob, rule version) pairs, scanned once, joined back to every path.

Every version of every path is named by the SHA-256 of its text. Blobs already in the ledger
under the rule version in force are not scanned again; the findings of new blobs are added to
the ledger, and all findings, old and new, are joined back to all paths that hold the blob.
Copies of one text are therefore scanned once, whatever their number.

A rule is (kind, pattern, group, least length): leftmost non-overlapping matches, of which those
with a shorter group are dropped. Positions are code points, end exclusive: the gaps between
matches (`split`) and the matches themselves alternate, so a running sum over both gives them.
Everything is a native expression; no Python runs on the executors.

Null text counts as empty text, an empty text has no findings. Repeated rows give repeated
result rows. A null path is a path of its own. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepoint.functions.points import evaluate_once
from tidepoint.llm.catalog import query
from tidepoint.llm.common import stored, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int


# The base rules. A run of hex digits or of an access key is matched whole or not at
# all, so its least length may stand in the pattern, which spares a match for every single letter.
BASE_RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# What this library adds: key blocks, signed tokens and bearer headers.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{16,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "2"
LEDGER = "blob_id string, rule_version string, findings array<struct<start:int,place:int,kind:string,finish:int>>"


def addressed(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob_id, text of every version."""
    held = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(held, 256).alias("blob_id"), held.alias("text"))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: DataFrame, rules=RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of the blobs in `versions` (path, blob_id, text) that the ledger lacks under this rule version."""
    seen = ledger.where(F.col("rule_version") == rule_version).select("blob_id")
    blobs = versions.join(seen, "blob_id", "left_anti").groupBy("blob_id").agg(F.first("text").alias("text"))
    found = evaluate_once(blobs.select("blob_id", F.array_compact(F.array(*[
        # A rule without a match costs one search and leaves no entry.
        F.when(F.col("text").rlike(r.pattern), F.struct(
            F.lit(place).alias("place"),
            F.transform(F.split("text", r.pattern, -1), F.length).alias("gaps"),
            F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.length).alias("sizes"),
            F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), F.length).alias("cores"),
        ))
        for place, r in enumerate(rules)
    ])).alias("hits")))
    one = found.select("blob_id", F.explode("hits").alias("h")).select(
        "blob_id", "h.place", F.posexplode(F.arrays_zip("h.gaps", "h.sizes", "h.cores")).alias("at", "m")
    ).where(F.col("m.sizes").isNotNull())
    # All matches of one rule in one text: no more than that text holds.
    running = Window.partitionBy("blob_id", "place").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    kinds, least = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.least) for r in rules])
    spans = one.withColumn("finish", F.sum(F.col("m.gaps") + F.col("m.sizes")).over(running).cast("int")).where(
        F.col("m.cores") >= F.get(least, F.col("place"))
    ).groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("finish") - F.col("m.sizes")).alias("start"), "place", F.get(kinds, F.col("place")).alias("kind"), "finish",
    ))).alias("findings"))
    return found.select("blob_id").join(spans, "blob_id", "left").select(
        "blob_id", F.lit(rule_version).alias("rule_version"),
        F.coalesce("findings", F.array().cast("array<struct<start:int,place:int,kind:string,finish:int>>")).alias("findings"),
    )


def findings(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """path, blob_id, findings: the ledger's findings joined back to every path, none as an empty array."""
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob_id", "findings")
    return versions.select("path", "blob_id").join(hits, "blob_id", "left").withColumn(
        "findings", F.coalesce("findings", F.array().cast("array<struct<start:int,place:int,kind:string,finish:int>>"))
    )


def commit(versions: DataFrame, ledger: DataFrame, rules=RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger with the blobs of this batch added; scanning a batch twice adds nothing."""
    return ledger.unionByName(stored(scan(versions, ledger, rules, rule_version), "secret-ledger"))


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["finish"])))


def _rule_sql(r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    place = RULES.index(r)
    return f"""
    SELECT r, {place} AS place, '{r.kind}' AS kind, s + list_sum(g[:i]) + coalesce(list_sum(m[:i - 1]), 0) AS start,
           list_sum(g[:i]) + list_sum(m[:i]) AS finish
    FROM (SELECT r, g, m, c, 0 AS s, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT r, [length(x) FOR x IN string_split_regex(t, '{p}')] AS g,
               [length(x) FOR x IN regexp_extract_all(t, '{p}')] AS m,
               [length(x) FOR x IN regexp_extract_all(t, '{p}', {r.group})] AS c
        FROM d WHERE regexp_matches(t, '{p}')
    )) WHERE c[i] >= {r.least}"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(map(_rule_sql, RULES))}),
a AS (
    SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
           count(*) FILTER (place = 2) AS n_hex,
           string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, place) FILTER (place < 3) AS base,
           string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, place) AS spans
    FROM f GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


@query("op1_secret_ledger", SQL)
def secret_ledger(spark, sf):
    versions = addressed(table(spark, sf, "documents"))
    ledger = commit(versions, empty_ledger(spark))
    base = F.filter("findings", lambda s: s["place"] < len(BASE_RULES))

    def count(place: int):
        return F.size(F.filter("findings", lambda s: s["place"] == place)).cast("long")

    return findings(versions, ledger).select(
        F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"),
    )
