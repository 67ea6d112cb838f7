"""Identities and digests as native expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepoint.functions.text import standard_json

# Fixed value: the RFC 4122 namespace for OIDs.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def _prefixed(c: Column) -> Column:
    """8-byte big-endian byte length followed by the bytes."""
    length = F.lpad(F.hex(F.octet_length(c).cast("bigint")), 16, "0")
    return F.concat(F.unhex(length), F.to_binary(c, F.lit("utf-8")))


def series_id(statement_id: Column, measurement: Column, tags: Column) -> Column:
    """SHA-256 over length-prefixed statement, measurement and tags in key order."""
    entries = F.array_sort(F.map_entries(tags))
    packed = F.aggregate(
        entries,
        F.concat(_prefixed(statement_id.cast("string")), _prefixed(measurement)),
        lambda acc, e: F.concat(acc, _prefixed(e["key"]), _prefixed(e["value"])),
    )
    bare = F.concat(_prefixed(statement_id.cast("string")), _prefixed(measurement))
    return F.sha2(F.coalesce(packed, bare), 256)


def uuid5_oid(name: Column) -> Column:
    """Version-5 UUID of a name in the OID namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), F.to_binary(name, F.lit("utf-8"))))
    # 13th digit is the version; the two top bits of the 17th are the variant.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def fragment_id(job_id: Column, ordinal: Column) -> Column:
    return uuid5_oid(F.concat(job_id, F.lit("\0DATA\0"), ordinal.cast("string")))


def struct_digest(*columns: Column) -> Column:
    """SHA-256 of a JSON object whose key order is the column order; NULL members are left out.

    The digested text spells the characters < > & as JSON escapes.
    """
    text = standard_json(F.to_json(F.struct(*columns)))
    for plain, escaped in (("<", r"\u003c"), (">", r"\u003e"), ("&", r"\u0026")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.sha2(text, 256)


# The wire order of a checkpoint's members.
CHECKPOINT_KEYS = [
    # column, JSON key, leave out when empty
    ("sequence", "sequence", False),
    ("parent_digest", "parentDigest", True),
    ("logical_offset", "logicalOffset", False),
    ("last_settled_batch_id", "lastSettledBatchId", True),
    ("last_disposition", "lastDisposition", True),
    ("adaptive_max_points", "adaptiveMaxPoints", False),
    ("adaptive_max_bytes", "adaptiveMaxBytes", False),
    ("source_sha256", "sourceSha256", False),
    ("staging_sha256", "stagingSha256", False),
    ("normalization_version", "normalizationVersion", False),
    ("spec_digest", "specDigest", False),
    ("target_digest", "targetDigest", False),
    ("lossy", "lossy", False),
]


def checkpoint_digest(prefix: str = "", member: Callable[[str], Column] | None = None) -> Column:
    """Digest of a checkpoint row, from columns named as in CHECKPOINT_KEYS (or from what `member` gives for each name)."""
    members = []
    for column, key, omit_empty in CHECKPOINT_KEYS:
        c = member(column) if member else F.col(prefix + column)
        if omit_empty:
            c = F.when(c != "", c)
        members.append(c.alias(key))
    return struct_digest(
        F.lit(1).alias("schemaVersion"), F.struct(*members).alias("checkpoint")
    )


def target_digest(database: Column, retention_policy: Column) -> Column:
    return struct_digest(
        F.lit(1).alias("schemaVersion"),
        database.alias("database"),
        F.coalesce(retention_policy, F.lit("")).alias("retentionPolicy"),
    )


def source_identity_digest(sha256: Column, size_bytes: Column) -> Column:
    return struct_digest(
        F.lit(1).alias("schemaVersion"),
        F.lower(sha256).alias("sha256"),
        size_bytes.cast("string").alias("sizeBytes"),
    )


# The normalisation and the first batch limits that an import starts with.
NORMALIZATION, FIRST_POINTS, FIRST_BYTES = "canonical-lp-v1", "5000", "5242880"


def spec_digest(kind: str, csv: dict | None = None, numeric: list[tuple[str, str, str]] | None = None) -> Column:
    """Digest of an import's specification: format (LP, JSONL, CSV), CSV mapping and numeric mapping.

    `csv` has the members of sources.mapped_csv.CsvMapping. Columns are listed by their source name,
    numeric mappings by measurement and field.
    """
    def text(value):
        return F.lit(value or None).cast("string")

    def listed(rows, names):
        items = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in sorted(rows)]
        return [F.array(*items)] if items else []

    members = [
        F.lit(1).alias("schemaVersion"), F.lit(kind).alias("format"), F.lit(NORMALIZATION).alias("normalizationVersion"),
        F.lit(FIRST_POINTS).alias("adaptiveMaxPoints"), F.lit(FIRST_BYTES).alias("adaptiveMaxBytes"),
    ]
    if csv:
        tags = listed(csv.get("tag_columns", {}).items(), ("source", "target"))
        fields = listed([(s, t, k) for s, (t, k) in csv["field_columns"].items()], ("source", "target", "kind"))
        members.append(F.struct(
            text(csv.get("static_measurement")).alias("staticMeasurement"), text(csv.get("measurement_column")).alias("measurementColumn"),
            F.lit(csv["timestamp_column"]).alias("timestampColumn"), *[c.alias("tags") for c in tags], *[c.alias("fields") for c in fields],
        ).alias("csv"))
    members += [c.alias("numericMappings") for c in listed(numeric or [], ("measurement", "field", "kind"))]
    return struct_digest(*members)


def text_list_digest(texts: list[str]) -> str:
    """One digest per plan: every text with its byte length in front."""
    digest = hashlib.sha256()
    for text in texts:
        raw = text.encode()
        digest.update(f"{len(raw)}:".encode() + raw)
    return digest.hexdigest()


def series_id_of(statement_id: int, measurement: str, tags: dict[str, str]) -> str:
    """series_id of one known series, for use as a filter value."""
    parts = [str(statement_id), measurement]
    for key in sorted(tags, key=str.encode):
        parts += [key, tags[key]]
    packed = b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)
    return hashlib.sha256(packed).hexdigest()
