"""Exports: canonical lines per slice, CSV, typed JSON lines, manifest, batches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.functions import points, text
from tidepoint.model import MAX_RESULT_ROWS, MAX_SLICES, RejectedInput
from tidepoint.sinks import commit, files
from tidepoint.sources import artifacts

MANIFEST_VERSION = "tidepoint.logical-export.v1"
# Fixed value: white space that makes a leading character need quotes.
SPACE_FIRST = r"^[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
AMBIGUOUS = "NUMERIC_TYPE_AMBIGUOUS"
WARNING = "A logical export is neither a backup nor a snapshot; it is not consistent at one point in time."


def write_canonical_lp(points_df: DataFrame, slices: DataFrame, directory: str) -> DataFrame:
    """One gzip file data-NNNNNN.lp.gz per slice; returns the fragment table.

    `points_df` carries slice_ordinal (see plans.slices). A file is one gzip member, so a slice is written by one task with an
    external sort; plans.slices.plan_bounded_slices bounds the points of the fullest slice. Files get their names in tasks
    (sinks.commit).
    """
    spark = points_df.sparkSession
    # A point that cannot be written stops the write where it is met; nothing is evaluated beforehand.
    line = F.coalesce("canonical_lp", F.raise_error(F.lit(AMBIGUOUS)).cast("string"))
    work = directory.rstrip("/") + "/_attempts"
    placed = (
        points_df.select(F.col("slice_ordinal").cast("long").alias("ordinal"), "series_key", "time_ns", line.alias("line"))
        .repartition("ordinal").sortWithinPartitions("ordinal", "series_key", "time_ns", "line").select("ordinal", "line")
    )
    try:
        attempts = commit.write_attempts(placed, work)
    except Exception as error:
        if AMBIGUOUS in str(error):
            raise RejectedInput(AMBIGUOUS) from error
        raise
    commit.commit(slices, attempts, directory)
    files.delete(spark, work)
    return fragments(spark, slices, directory)


def fragments(spark: SparkSession, slices: DataFrame, directory: str) -> DataFrame:
    """Slices joined with what is on disk: sizes, digest, point count, validity."""
    verdicts = artifacts.verify_artifacts(spark, directory.rstrip("/") + "/data-*.lp.gz").withColumn(
        "file", F.element_at(F.split("path", "/"), -1)
    )
    return slices.join(verdicts, "file", "left").select(
        "ordinal", "fragment_id", "file", "start_ns", "end_ns", "compressed_size", "uncompressed_size",
        "sha256", F.col("line_count").alias("point_count"), F.coalesce("valid", F.lit(False)).alias("valid"),
    )


def _csv_field(c: Column, crlf: bool) -> Column:
    needs = (c == r"\.") | c.rlike(r'[",\r\n]') | c.rlike(SPACE_FIRST)
    body = F.replace(c, F.lit('"'), F.lit('""'))
    if crlf:
        body = F.replace(F.replace(body, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\r\n"))
    return F.when(needs, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(c)


def csv_record(cells: list[Column], crlf: bool = False) -> Column:
    return F.concat_ws(",", *[_csv_field(F.coalesce(c, F.lit("")), crlf) for c in cells])


def write_exact_csv(df: DataFrame, directory: str) -> None:
    """Every cell as its exact text (NULL -> empty). Part files in name order form one document with one header."""
    names = [F.lit(f.name) for f in df.schema.fields]
    header = df.sparkSession.range(1).select(csv_record(names).alias("value"))
    body = df.select(csv_record([F.col(f"`{f.name}`").cast("string") for f in df.schema.fields]).alias("value"))
    # A union keeps the order of its parts, so the header's task comes first.
    header.unionByName(body).write.mode("errorifexists").text(directory)


def result_csv_record(cells: Column, width: int, offset_minutes: int) -> Column:
    """Scalar array -> one spreadsheet-safe record: only text is neutralised, never a number."""
    texts = []
    for i in range(width):
        cell = F.get(cells, F.lit(i))
        kind = cell["kind"]
        texts.append(
            F.when(kind == "string", text.neutralise_formula(cell["string_value"]))
            .when(kind == "timestamp_ns", text.format_time_text(cell["decimal_text"], offset_minutes))
            .otherwise(points.scalar_text(cell))
        )
    return csv_record(texts, crlf=True)


def write_result_csv(
    rows: DataFrame, columns: list[str], directory: str, offset_minutes: int = 0, single_file: bool = False
) -> None:
    """Result rows of one series in row order, with BOM, CRLF and a header.

    Part files in name order form the document: the header is the row before the first. A
    single file is written only for results inside the row cap.
    """
    spark = rows.sparkSession
    header = spark.createDataFrame([(c,) for c in columns], "c string").agg(
        F.collect_list("c").alias("h")
    ).select(
        F.lit(-1).cast("bigint").alias("row_index"),
        F.concat(
            F.lit("\N{ZERO WIDTH NO-BREAK SPACE}"),
            csv_record([text.neutralise_formula(F.get("h", F.lit(i))) for i in range(len(columns))], crlf=True),
        ).alias("value"),
    )
    body = rows.select(
        "row_index", result_csv_record(F.col("cells"), len(columns), offset_minutes).alias("value")
    )
    out = header.unionByName(body).orderBy("row_index")
    if single_file:
        if rows.limit(MAX_RESULT_ROWS + 1).count() > MAX_RESULT_ROWS:
            raise RejectedInput("RESULT_TOO_LARGE", "write part files instead")
        out = out.coalesce(1)
    out.select("value").write.mode("errorifexists").option("lineSep", "\r\n").text(directory)


def _json_text(c: Column) -> Column:
    """JSON string literal of a text column."""
    wrapped = F.to_json(F.array(c))
    return text.standard_json(F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))


def json_scalar(cell: Column) -> Column:
    """Tagged scalar as JSON text; no number is ever a bare JSON number."""
    kind = cell["kind"]
    head = F.concat(F.lit('{"kind":"'), kind, F.lit('"'))
    return (
        F.when(kind == "null", F.concat(head, F.lit("}")))
        .when(kind == "string", F.concat(head, F.lit(',"value":'), _json_text(cell["string_value"]), F.lit("}")))
        .when(kind == "boolean", F.concat(head, F.lit(',"value":'), cell["bool_value"].cast("string"), F.lit("}")))
        .otherwise(F.concat(head, F.lit(',"decimalText":"'), cell["decimal_text"], F.lit('"}')))
    )


def typed_json(columns: Column, cells: Column) -> Column:
    """Column names and scalar cells -> one JSON object, members in byte order of their names."""
    members = F.array_sort(F.zip_with(
        columns, cells, lambda n, c: F.struct(n.alias("n"), json_scalar(c).alias("j"))
    ))
    joined = F.array_join(F.transform(members, lambda m: F.concat(_json_text(m["n"]), F.lit(":"), m["j"])), ",")
    return F.concat(F.lit("{"), joined, F.lit("}"))


def write_typed_jsonl(rows: DataFrame, directory: str) -> None:
    rows.select(typed_json(F.col("columns"), F.col("cells")).alias("value")).write.mode("errorifexists").text(directory)


def build_manifest(spec: dict, schema_rows: list[dict], query_digest: str, fragment_rows: list[dict]) -> dict:
    return {
        "schemaVersion": MANIFEST_VERSION,
        "exportKind": "LOGICAL_EXPORT",
        "database": spec["database"],
        "retentionPolicy": spec["retention_policy"],
        "measurement": spec["measurement"],
        "range": {"startNs": str(spec["start_ns"]), "endNs": str(spec["end_ns"])},
        "schema": {
            "tagKeys": sorted(r["name"] for r in schema_rows if r["role"] == "tag"),
            "fields": sorted(
                ({"name": r["name"], "kind": r["kind"]} for r in schema_rows if r["role"] == "field"),
                key=lambda f: f["name"],
            ),
        },
        "queryDigestSha256": query_digest,
        "checksumAlgorithm": "SHA-256",
        "snapshotConsistent": False,
        "typePreserving": True,
        "lossy": False,
        "warnings": [WARNING],
        "fragments": [
            {
                "file": r["file"], "startNs": str(r["start_ns"]), "endNs": str(r["end_ns"]),
                "compressedSize": str(r["compressed_size"]), "uncompressedSize": str(r["uncompressed_size"]),
                "sha256": r["sha256"], "pointCount": str(r["point_count"]),
            }
            for r in fragment_rows
        ],
    }


def write_manifest(
    spark: SparkSession, fragment_table: DataFrame, schema: DataFrame, spec: dict, query_digest: str, path: str
) -> dict:
    """Write manifest.json last and read it back; refuses fragments that did not verify.

    A manifest is one document with one entry per slice; plans hold at most a million slices.
    """
    if files.exists(spark, path):
        raise RejectedInput("ARTIFACT_STATE", f"{path} exists")
    ordered = fragment_table.orderBy("ordinal").limit(MAX_SLICES + 1).collect()
    if len(ordered) > MAX_SLICES or not all(r["valid"] for r in ordered):
        raise RejectedInput("ARTIFACT_STATE", "a fragment is missing or broken")
    manifest = build_manifest(
        spec, [r.asDict() for r in schema.collect()], query_digest, [r.asDict() for r in ordered]
    )
    files.write_bytes(spark, path, json.dumps(manifest, separators=(",", ":"), ensure_ascii=False).encode())
    if json.loads(files.read_text(spark, path)) != manifest:
        raise RejectedInput("ARTIFACT_STATE", "manifest differs after writing")
    return manifest


def write_batches(payloads: DataFrame, directory: str) -> None:
    payloads.write.mode("errorifexists").parquet(directory)
