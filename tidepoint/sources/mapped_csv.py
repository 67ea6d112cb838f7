"""CSV with a header and an explicit mapping of every column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepoint.functions import numbers, points, text
from tidepoint.functions.joins import BROADCAST_ROWS, bounded_broadcast
from tidepoint.functions.work import stored
from tidepoint.model import (
    CSV_MAPPING_INVALID,
    EMPTY,
    FIELD_KINDS,
    INVALID_INPUT,
    MAX_CSV_RECORD_BYTES,
    POINT_TOO_LARGE,
    RejectedInput,
    TIMESTAMP_REQUIRED,
)
from tidepoint.sources import lines
from tidepoint.sources.line_protocol import fail_on_first

# Spellings of a boolean cell.
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_WORDS = ("0", "f", "F", "FALSE", "false", "False")


@dataclass(frozen=True)
class CsvMapping:
    """Where each header column goes. Exactly one of the measurement members is set."""

    timestamp_column: str
    field_columns: dict[str, tuple[str, str]]  # source -> (target, kind)
    tag_columns: dict[str, str] = field(default_factory=dict)  # source -> target
    static_measurement: str = ""
    measurement_column: str = ""


def _name_ok(value: str) -> bool:
    return bool(value) and not any(ch in value for ch in "\r\n\0")


def check_csv_mapping(header: list[str], mapping: CsvMapping) -> None:
    """Raise RejectedInput unless every header column is mapped exactly once."""

    def reject(why: str):
        raise RejectedInput(CSV_MAPPING_INVALID, why)

    if not header or bool(mapping.static_measurement) == bool(mapping.measurement_column):
        reject("exactly one measurement source is needed")
    if not mapping.timestamp_column or not mapping.field_columns:
        reject("a timestamp column and a field are needed")
    if mapping.static_measurement and not _name_ok(mapping.static_measurement):
        reject("bad static measurement")
    if not all(map(_name_ok, header)) or len(set(header)) != len(header):
        raise RejectedInput(INVALID_INPUT, "bad or duplicate header column")
    sources = [c for c in (mapping.measurement_column, mapping.timestamp_column) if c]
    sources += [*mapping.tag_columns, *mapping.field_columns]
    if len(set(sources)) != len(sources):
        reject("a column is used twice")
    if set(sources) != set(header):
        reject("mapping and header cover different columns")
    targets = [*mapping.tag_columns.values(), *(t for t, _ in mapping.field_columns.values())]
    if not all(map(_name_ok, targets)) or len(set(targets)) != len(targets):
        reject("bad or duplicate target")
    if any(kind not in FIELD_KINDS for _, kind in mapping.field_columns.values()):
        reject("unknown field kind")


def check_headers(headers: DataFrame, mapping: CsvMapping, column: str = "header") -> DataFrame:
    """`headers` with the `code` that check_csv_mapping gives each of them (null: every column is mapped once)."""
    def code(header) -> str | None:
        try:
            check_csv_mapping(list([] if header is None else header), mapping)
        except RejectedInput as problem:
            return problem.code
        return None

    def run(batches):
        for batch in batches:
            yield batch.assign(code=[code(h) for h in batch[column]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in headers.schema.fields)
    return headers.mapInPandas(run, f"{fields}, code string")


def points_from_csv(df: DataFrame, mapping: CsvMapping, keep: list[str] | None = None) -> DataFrame:
    """All-STRING rows (columns named as the header) -> point columns plus `code`.

    A column `_corrupt`, when present, marks rows whose width did not fit.
    """
    keep = list(keep or [])

    def cell(name):
        return F.coalesce(F.col(f"`{name}`"), F.lit(""))

    measurement = (
        F.lit(mapping.static_measurement) if mapping.static_measurement else cell(mapping.measurement_column)
    )
    stamp = cell(mapping.timestamp_column)
    stamp_text = numbers.canonical_int64(stamp)
    tags, fields, checks = [], [], [text.valid_name(measurement)]
    for source, target in mapping.tag_columns.items():
        tags.append(F.struct(F.lit(target).alias("key"), cell(source).alias("value")))
        checks.append(text.valid_name(cell(source)))
    for source, (target, kind) in mapping.field_columns.items():
        value = cell(source)
        key = F.lit(target)
        if kind == "string":
            fields.append(points.raw_field(key, kind, string_value=value))
            checks.append(F.is_valid_utf8(value) & ~text.has_control(value))
        elif kind == "boolean":
            fields.append(points.raw_field(key, kind, bool_value=value.isin(*TRUE_WORDS)))
            checks.append(value.isin(*TRUE_WORDS, *FALSE_WORDS))
        else:
            fields.append(points.raw_field(key, kind, text_=value))
    all_ok = checks[0]
    for check in checks[1:]:
        all_ok = all_ok & check
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in df.columns else F.lit(False)
    names = [*mapping.tag_columns, *mapping.field_columns, mapping.timestamp_column]
    if mapping.measurement_column:
        names.append(mapping.measurement_column)
    record_bytes = sum((F.octet_length(cell(n)) for n in names), F.lit(len(names)))
    if "_corrupt" in df.columns:
        record_bytes = F.greatest(record_bytes, F.coalesce(F.octet_length("_corrupt"), F.lit(0)))
    code = (
        F.when(record_bytes > MAX_CSV_RECORD_BYTES, POINT_TOO_LARGE)
        .when(corrupt, INVALID_INPUT)
        .when(~text.valid_name(measurement), INVALID_INPUT)
        .when(stamp == "", TIMESTAMP_REQUIRED)
        .when(stamp_text.isNull(), INVALID_INPUT)
        .when(~all_ok, INVALID_INPUT)
    )
    no_tags = F.array().cast("array<struct<key:string,value:string>>")
    df = df.select(
        *keep,
        code.alias("code"),
        measurement.alias("measurement"),
        (F.array(*tags) if tags else no_tags).alias("tags"),
        F.array(*fields).alias("fields"),
        stamp_text.try_cast("bigint").alias("time_ns"),
    )
    return points.assemble(points.evaluate_once(df), keep)


# A strict CSV field; quotes stand around a whole field or are doubled inside one.
FIELD = r'(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)'
RECORD = rf"^{FIELD}(?:,{FIELD})*+\z"


def split_fields(record: Column) -> Column:
    """Cells of one record, NULL when it is no strict CSV."""
    # With a comma in front no match is empty.
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf",({FIELD})"), F.lit(1))
    plain = F.transform(cells, lambda c: F.when(
        F.startswith(c, F.lit('"')),
        F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
    ).otherwise(c))
    return F.when(record.rlike(RECORD), plain)


def read_raw_lines(spark: SparkSession, path) -> DataFrame:
    """PLACE, raw (without a trailing CR) and size (bytes with the line break) of every line."""
    value = F.col("value")
    return lines.placed(spark.read.option("lineSep", "\n").text(path), lines.strip_cr(value).alias("raw"), (F.octet_length(value) + 1).cast("long").alias("size"))


def _with_quotes_before(raw: DataFrame) -> tuple[DataFrame, bool]:
    """(lines with _toggles: how many lines of the file before it hold an odd number of quotes; whether any line does).

    A narrow scan counts them per split. Where no split has one, that is all. Otherwise the lines of splits that have none get the
    count in front of their split, and only the others are counted along the split, in scan order. No line is shuffled
    unless the splits with open quotes are too many to broadcast.
    """
    odd = (F.length("raw") - F.length(F.replace("raw", F.lit('"'), F.lit("")))) % 2 == 1
    marked = raw.withColumn("_odd", odd)
    before = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = marked.groupBy("source_file", "split_start").agg(F.count_if("_odd").alias("_within")).select(
        "source_file", "split_start", "_within", F.coalesce(F.sum("_within").over(before), F.lit(0)).alias("_toggles"))
    splits = stored(splits.where("_toggles > 0 or _within > 0"), "quotes")
    found = splits.count()
    if not found:
        return marked.withColumn("_toggles", F.lit(0).cast("long")), False
    keys = ["source_file", "split_start"]
    few = found <= BROADCAST_ROWS
    joined = marked.join(F.broadcast(splits) if few else splits, keys, "left")
    zero = F.lit(0).cast("long")
    # Records and their parts are read several times, so what was counted is kept.
    calm = joined.where(F.coalesce("_within", zero) == 0).withColumn("_toggles", F.coalesce("_toggles", zero)).drop("_within")
    busy = joined.where("_within > 0").drop("_within")
    if not few:  # a join that shuffles loses the order of the scan
        busy = busy.repartition(*keys).sortWithinPartitions(*keys, "row_id")
    return stored(calm.unionByName(busy.mapInArrow(_count_along, busy.schema)), "counted-lines"), True


def _count_along(batches):
    """Adds to _toggles the odd lines before each line in its split; rows come in the order of (file, split, row)."""
    import numpy as np
    import pyarrow as pa

    place, seen = None, 0
    for batch in batches:
        names = batch.schema.names
        odds = batch.column(names.index("_odd")).to_numpy(zero_copy_only=False).astype(np.int64)
        files, starts = (batch.column(names.index(c)) for c in ("source_file", "split_start"))
        base = batch.column(names.index("_toggles")).to_numpy()
        inner = np.cumsum(odds) - odds
        new = np.ones(len(odds), bool)
        new[1:] = np.diff(starts.to_numpy()) != 0
        codes = files.dictionary_encode().indices.to_numpy()
        new[1:] |= np.diff(codes) != 0
        if len(odds):
            new[0] = (files[0].as_py(), starts[0].as_py()) != place
            at = np.maximum.accumulate(np.where(new, np.arange(len(odds)), -1))
            inner = np.where(at >= 0, inner - inner[np.maximum(at, 0)], inner + seen)
            place = (files[-1].as_py(), starts[-1].as_py())
            seen = int(inner[-1] + odds[-1])
        yield batch.set_column(names.index("_toggles"), "_toggles", pa.array(base + inner, pa.int64()))


def read_records(raw: DataFrame, limit: int = MAX_CSV_RECORD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(PLACE of the first line, `raw` and `size` of every CSV record within `limit` bytes; PLACE and `size` of every larger one).

    A record ends at the first line break outside quotes; blank lines give none. Lines that are whole records, as a rule all, pass as
    they are. The sizes of longer ones are summed first, merging in the tasks, so the lines of a record beyond the limit (the rest of a
    file behind a stray quote, say) never meet; parts of the others meet by file and running number.
    """
    lines_, quoted = _with_quotes_before(raw)
    inside = (F.col("_toggles") % 2 == 1) | F.col("_odd")
    whole = lines_.where(~inside & (F.col("raw") != "")).select(*lines.PLACE, "raw", "size")
    records, large = whole.where(F.col("size") <= limit), whole.where(F.col("size") > limit).drop("raw")
    if not quoted:
        return records, large
    part = lines_.where(inside).withColumn("_record", F.floor(F.col("_toggles") / 2))
    key = ["source_file", "_record"]
    start = F.struct("split_start", "row_id")
    totals = part.groupBy(*key).agg(F.sum("size").alias("size"), F.min(start).alias("_start"))
    over = stored(totals.where(F.col("size") > limit), "large-records")
    found = over.count()
    if 0 < found <= BROADCAST_ROWS:
        part = part.join(F.broadcast(over.select(*key)), key, "left_anti")
    elif found:  # blocks of lines keep the lines of one large record apart
        block = [*key, "split_start", "_block"]
        part = part.withColumn("_block", F.shiftright("row_id", 14))
        part = part.join(part.select(*block).distinct().join(over.select(*key), key), block, "left_anti").drop("_block")
    longer = part.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("split_start", "row_id", "raw"))).alias("_parts"), F.sum("size").alias("size")
    ).select(
        "source_file", F.col("_parts")[0]["split_start"].alias("split_start"), F.col("_parts")[0]["row_id"].alias("row_id"),
        F.array_join(F.transform("_parts", lambda x: x["raw"]), "\n").alias("raw"), "size",
    )
    over = over.select("source_file", F.col("_start.split_start").alias("split_start"), F.col("_start.row_id").alias("row_id"), "size")
    return records.unionByName(longer), large.unionByName(over)


def read_mapped_csv(
    spark: SparkSession, path, mapping: CsvMapping, fail_on_reject: bool = False, limit: int = MAX_CSV_RECORD_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of CSV files, each with its own header, whose columns may come in any order.

    Large files are split among tasks, with line breaks inside quotes or without. Quotes are read
    strictly: a record with a bare or stray quote is rejected, whole. `line_no` of a reject is the
    line its record begins on, `size` its bytes; of a record beyond `limit` bytes that is all there is.
    """
    raw = read_raw_lines(spark, path)
    records, large = read_records(raw, limit)
    first = records.where("split_start = 0").unionByName(large.where("split_start = 0"), allowMissingColumns=True)
    heads = first.groupBy("source_file").agg(F.min_by(F.struct("row_id", "raw"), F.col("row_id")).alias("_head"))
    heads = stored(heads.select(
        "source_file", F.col("_head.row_id").alias("_head_row"), split_fields(F.col("_head.raw")).alias("_header"),
        F.col("_head.raw").isNull().alias("_large")), "headers")
    found = False
    for row in heads.select("_header", "_large").distinct().toLocalIterator():
        if row["_large"]:
            raise RejectedInput(POINT_TOO_LARGE, "header")
        check_csv_mapping(list(row["_header"] or []), mapping)
        found = True
    if not found:
        raise RejectedInput(EMPTY)
    rows = records.join(bounded_broadcast(heads.drop("_large")), "source_file").where(
        (F.col("split_start") > 0) | (F.col("row_id") > F.col("_head_row")))
    rows = points.evaluate_once(rows.withColumn("_cells", split_fields(F.col("raw"))))
    fits = F.size("_cells") == F.size("_header")
    names = [c for c in (mapping.measurement_column, mapping.timestamp_column) if c]
    names += [*mapping.tag_columns, *mapping.field_columns]
    # Positional names, so that a header name can never clash with ours.
    slots = {f"_c{i}": F.try_element_at("_cells", F.array_position("_header", F.lit(n)).cast("int")) for i, n in enumerate(names)}
    rows = points.evaluate_once(rows.select(
        *[F.col(c).alias(f"_{c}") for c in (*lines.PLACE, "raw", "size")],
        F.when(F.coalesce(fits, F.lit(False)), F.lit(None)).otherwise(F.col("raw")).alias("__corrupt"),
        *[F.when(fits, c).alias(s) for s, c in slots.items()],
    ))
    place = [f"_{c}" for c in (*lines.PLACE, "raw", "size")]
    named = rows.select(*place, F.col("__corrupt").alias("_corrupt"), *[F.col(s).alias(n) for s, n in zip(slots, names)])
    parsed = points_from_csv(named, mapping, keep=place)
    parsed = parsed.withColumnsRenamed({f"_{c}": c for c in (*lines.PLACE, "raw", "size")})
    # Points and rejects come from one pass; only rejects need their text.
    parsed = stored(parsed.withColumn("raw", F.when(F.col("code").isNotNull(), F.col("raw"))), "csv-points")
    good = parsed.where(F.col("code").isNull()).drop("code", "raw", "size")
    bad = parsed.where(F.col("code").isNotNull()).select(*lines.PLACE, "raw", "size", "code").unionByName(
        large.withColumn("code", F.lit(POINT_TOO_LARGE)), allowMissingColumns=True)
    rejects = lines.with_line_numbers(bad, raw).select("source_file", "line_no", "raw", "size", "code")
    if fail_on_reject:
        fail_on_first(rejects)
    return good, rejects
