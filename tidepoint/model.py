"""Table shapes, limits and codes shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# A cell or field value: the kind says which of the other members is set.
SCALAR = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("decimal_text", T.StringType()),
        T.StructField("string_value", T.StringType()),
        T.StructField("bool_value", T.BooleanType()),
    ]
)

POINT_COLUMNS = ["measurement", "tags", "fields", "time_ns", "series_key", "canonical_lp"]

# --- Fixed values: scalar kinds -------------------------------------------------
NUMBER_KINDS = ("timestamp_ns", "int64", "uint64", "float64", "numeric_text")
EXACT_KINDS = ("timestamp_ns", "int64", "uint64")
FIELD_KINDS = ("string", "boolean", "int64", "uint64", "float64")
# Field type names in schema answers -> scalar kind.
FIELD_TYPE_KIND = {
    "float": "float64",
    "integer": "int64",
    "unsigned": "uint64",
    "string": "string",
    "boolean": "boolean",
}

# --- Fixed values: limits -------------------------------------------------------
MIB = 1024 * 1024
MAX_POINT_BYTES = 5 * MIB
MAX_LP_LINE_BYTES = 2 * MAX_POINT_BYTES
MAX_JSONL_LINE_BYTES = 4 * MAX_POINT_BYTES
MAX_CSV_RECORD_BYTES = 2 * MAX_POINT_BYTES
MAX_GZIP_BYTES = 20 * 1024 * MIB
MAX_CHUNK_BYTES = 64 * MIB
MAX_BATCH_POINTS = 5000
MAX_BATCH_BYTES = 5 * MIB
MAX_RESULT_ROWS = 100_000
MAX_RESULT_BYTES = 128 * MIB
DEFAULT_PAGE = 500
MAX_PAGE = 5000
MAX_SLICES = 1_000_000
DEFAULT_SLICE_NS = 3600 * 1_000_000_000
INT64_MIN = -(2**63)
INT64_MAX = 2**63 - 1
UINT64_MAX = 2**64 - 1
MAX_EXACT_DELTA = 2**53 - 1

# --- Fixed values: reject codes -------------------------------------------------
INVALID_INPUT = "INVALID_INPUT"
TIMESTAMP_REQUIRED = "TIMESTAMP_REQUIRED"
POINT_TOO_LARGE = "POINT_TOO_LARGE"
NUMERIC_TYPE_REQUIRED = "NUMERIC_TYPE_REQUIRED"
NUMERIC_TYPE_AMBIGUOUS = "NUMERIC_TYPE_AMBIGUOUS"
INVALID_GZIP = "INVALID_GZIP"
GZIP_LIMIT_EXCEEDED = "GZIP_LIMIT_EXCEEDED"
CSV_MAPPING_INVALID = "CSV_MAPPING_INVALID"
EMPTY = "EMPTY"
SCHEMA_DRIFT = "SCHEMA_DRIFT"
UNKNOWN_TAG = "UNKNOWN_TAG"
UNKNOWN_FIELD = "UNKNOWN_FIELD"
TAG_FIELD_CONFLICT = "TAG_FIELD_CONFLICT"

NS_PER_SECOND = 1_000_000_000
NS_PER_DAY = 86_400 * NS_PER_SECOND

# Names that user interfaces offer for windows and ranges.
UNIT_NS = {
    "ns": 1,
    "u": 1_000,
    "ms": 1_000_000,
    "s": NS_PER_SECOND,
    "m": 60 * NS_PER_SECOND,
    "h": 3600 * NS_PER_SECOND,
    "d": NS_PER_DAY,
    "w": 7 * NS_PER_DAY,
}


class RejectedInput(ValueError):
    """Raised when a caller asks for failure instead of quarantine."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def duration_ns(text: str | int) -> int:
    """'15m' -> nanoseconds; an int is already nanoseconds."""
    if isinstance(text, int):
        return text
    digits = text.rstrip("nsumhdw")
    unit = text[len(digits):]
    if not digits.isdigit() or unit not in UNIT_NS or int(digits) <= 0:
        raise ValueError(f"bad duration {text!r}")
    return int(digits) * UNIT_NS[unit]
