"""Exact number text: signed, unsigned and floating point.

A regular expression guards every cast, because Spark's own casts accept spaces,
type suffixes and non-finite words. NULL means 'not a number of this type'.
Patterns end in \\z: `$` would let a final line break through.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepoint.model import UINT64_MAX

_DIGITS = r"[0-9](?:_?[0-9])*+"
_HEX = r"[0-9a-fA-F](?:_?[0-9a-fA-F])*+"
DECIMAL_FLOAT = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
HEX_FLOAT = rf"^[+-]?0[xX](?:_?{_HEX}(?:\.(?:{_HEX})?)?|\.{_HEX})[pP][+-]?{_DIGITS}\z"
# Text that already is its own canonical form: at most 15 significant digits, so it is
# the shortest text of its double, and no exponent is due.
PLAIN_FLOAT = (
    r"^-?(?:0|[1-9][0-9]{0,5}(?:\.[0-9]{0,8}[1-9])?|0\.(?!0000)[0-9]{0,13}[1-9])\z"
)


def canonical_int64(c: Column) -> Column:
    """Base-10 signed 64-bit text -> canonical text."""
    return F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("bigint").cast("string"))


def canonical_uint64(c: Column) -> Column:
    """Base-10 unsigned 64-bit text (no sign) -> canonical text."""
    digits = F.regexp_replace(c, r"^0+(?=[0-9])", "")
    number = F.when(F.length(digits) <= 20, digits.try_cast("decimal(20,0)"))
    return F.when(
        c.rlike(r"^[0-9]+\z") & (number <= F.lit(str(UINT64_MAX)).cast("decimal(20,0)")), digits
    )


def finite_double(c: Column) -> Column:
    """Decimal or hexadecimal float text -> finite DOUBLE."""
    plain = F.replace(c, F.lit("_"), F.lit(""))
    number = F.when(c.rlike(DECIMAL_FLOAT) | c.rlike(HEX_FLOAT), plain.try_cast("double"))
    return F.when(F.abs(number) <= F.lit(1.7976931348623157e308), number)


def _shortest(value: float) -> str:
    """Shortest round-trip digits; exponent form below 1e-4 and from 1e6 on."""
    mantissa, _, exponent = repr(value).partition("e")
    sign = "-" if mantissa.startswith("-") else ""
    whole, _, fraction = mantissa.lstrip("-").partition(".")
    digits = (whole + fraction).lstrip("0")
    if not digits:
        return sign + "0"
    lead = len(whole + fraction) - len(digits)
    exp10 = int(exponent or 0) + len(whole) - 1 - lead
    digits = digits.rstrip("0")
    if exp10 < -4 or exp10 >= 6:
        tail = "." + digits[1:] if len(digits) > 1 else ""
        return f"{sign}{digits[0]}{tail}e{'-' if exp10 < 0 else '+'}{abs(exp10):02d}"
    if exp10 < 0:
        return sign + "0." + "0" * (-exp10 - 1) + digits
    if len(digits) <= exp10 + 1:
        return sign + digits + "0" * (exp10 + 1 - len(digits))
    return sign + digits[: exp10 + 1] + "." + digits[exp10 + 1:]


@F.pandas_udf(T.StringType())
def _shortest_udf(values: pd.Series) -> pd.Series:
    return values.map(_shortest, na_action="ignore").astype(object).where(values.notna(), None)


@F.pandas_udf(T.StringType())
def shortest_list_udf(values: pd.Series) -> pd.Series:
    """'x,,y' -> the same list with each double in its shortest text. Most rows arrive as NULL."""
    def one(row):
        return ",".join(_shortest(float(v)) if v else "" for v in row.split(","))

    return values.map(one, na_action="ignore").astype(object).where(values.notna(), None)


def shortest_each(slow: Column) -> Column:
    """ARRAY<DOUBLE> with NULLs -> ARRAY<STRING> ('' for NULL); NULL when nothing is set.

    The array crosses to Python as one text, which costs next to nothing when it is NULL.
    """
    listed = F.array_join(F.transform(slow, lambda v: F.coalesce(v.cast("string"), F.lit(""))), ",")
    some = F.exists(slow, lambda v: v.isNotNull())
    return F.split(shortest_list_udf(F.when(some, listed)), ",")


def plain_text(value: Column) -> Column:
    """DOUBLE -> canonical text where that needs no search for shortest digits, else NULL."""
    text = value.cast("string")
    text = F.when(F.endswith(text, F.lit(".0")), F.left(text, F.length(text) - 2)).otherwise(text)
    return F.when(text.rlike(PLAIN_FLOAT), text)


def float_text(value: Column) -> Column:
    """DOUBLE -> canonical text (NULL for NULL or non-finite)."""
    plain = plain_text(value)
    finite = F.abs(value) <= F.lit(1.7976931348623157e308)
    return F.coalesce(plain, _shortest_udf(F.when(finite & plain.isNull(), value)))


def decimal_order(seq: Column) -> tuple[Column, Column]:
    """Sort keys for canonical unsigned decimal text of any length."""
    return F.length(seq), seq


def is_canonical_decimal(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(?:0|[1-9][0-9]*)\z"), F.lit(False))


def increment_decimal(c: Column) -> Column:
    """Canonical unsigned decimal text + 1, for any length: only the tail of nines carries."""
    nines = F.regexp_extract(c, "9*$", 0)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(nines) - 1)
    pivot = F.substring(c, F.length(c) - F.length(nines), F.lit(1))
    carried = F.when(
        F.length(nines) == F.length(c), F.lit("1")
    ).otherwise(F.concat(head, (pivot.try_cast("int") + 1).cast("string")))
    return F.concat(carried, F.repeat(F.lit("0"), F.length(nines)))


def compare_decimal(left: Column, right: Column) -> Column:
    """-1, 0, 1 for canonical unsigned decimal text."""
    return (
        F.when(F.length(left) < F.length(right), -1)
        .when(F.length(left) > F.length(right), 1)
        .when(left < right, -1)
        .when(left > right, 1)
        .otherwise(0)
    )
