"""Text expressions: escaping, spreadsheet safety, timestamp display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepoint.model import NS_PER_SECOND


def _backslash(c: Column, special: str) -> Column:
    # Plain byte replacement; the backslash itself comes first in `special`.
    for ch in special:
        c = F.replace(c, F.lit(ch), F.lit("\\" + ch))
    return c


def escape_measurement(c: Column) -> Column:
    """Backslash before backslash, space and comma."""
    return _backslash(c, "\\ ,")


def escape_token(c: Column) -> Column:
    """Backslash before backslash, space, comma and equals (tag keys, tag values, field keys)."""
    return _backslash(c, "\\ ,=")


def quote_string(c: Column) -> Column:
    """String field value in double quotes."""
    return F.concat(F.lit('"'), _backslash(c, '\\"'), F.lit('"'))


def has_control(c: Column) -> Column:
    """True when the text holds CR, LF or NUL."""
    return c.contains("\r") | c.contains("\n") | c.contains("\0")


def valid_name(c: Column) -> Column:
    """Non-empty valid UTF-8 without CR, LF, NUL."""
    return c.isNotNull() & (c != "") & F.is_valid_utf8(c) & ~has_control(c)


def standard_json(c: Column) -> Column:
    """JSON text with its escapes spelled as standard encoders do: lower-case hex, and line separators escaped."""
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        # An even number of backslashes before it is text, not part of the escape.
        c = F.regexp_replace(c, rf"(?<!\\)((?:\\\\)*+)\\u{code:04X}", rf"$1\\u{code:04x}")
    for plain, escaped in (("\N{LINE SEPARATOR}", "\\u2028"), ("\N{PARAGRAPH SEPARATOR}", "\\u2029")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def neutralise_formula(c: Column) -> Column:
    """Apostrophe before text that a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def format_time_ns(time_ns: Column, offset_minutes: int = 0) -> Column:
    """BIGINT nanoseconds -> 'YYYY-MM-DD HH:MM:SS[.fraction]' at a fixed UTC offset.

    Exact for the whole signed 64-bit range: seconds are floored, the nine fraction
    digits come from the remainder, trailing zeros go. The session zone must be UTC.
    """
    nanos = F.pmod(time_ns, F.lit(NS_PER_SECOND))
    seconds = _floor_seconds(time_ns)
    shown = F.date_format(
        F.timestamp_seconds(seconds + F.lit(offset_minutes * 60)), "yyyy-MM-dd HH:mm:ss"
    )
    fraction = F.rtrim(F.lpad(nanos.cast("string"), 9, "0"), F.lit("0"))
    return F.when(nanos == 0, shown).otherwise(F.concat(shown, F.lit("."), fraction))


def _floor_seconds(time_ns: Column) -> Column:
    quotient = F.call_function("div", time_ns, F.lit(NS_PER_SECOND).cast("bigint"))
    remainder = time_ns % F.lit(NS_PER_SECOND)
    return quotient - F.when(remainder < 0, F.lit(1)).otherwise(F.lit(0))


def format_time_text(decimal_text: Column, offset_minutes: int = 0) -> Column:
    """As format_time_ns for decimal text; text that is no 64-bit number comes back unchanged."""
    number = F.when(decimal_text.rlike(r"^-?[0-9]+\z"), decimal_text.try_cast("bigint"))
    return F.coalesce(format_time_ns(number, offset_minutes), decimal_text)
