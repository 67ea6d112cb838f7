"""Line-first quality rules: drop failing lines, then reject documents that lose too much text.

Every line is judged alone, in this order of cost:
  navigation   link rows: separators between most words, or under `short_words` words without an end mark
  punctuation  more than `max_punctuation` of its word characters are ASCII punctuation, one end mark aside
  boilerplate  it holds a phrase of BOILERPLATE (licence, rights and site notices)
A document goes when its base figures fail (fewer than 50 words, or most words in repeated
three-word windows) or when the failing lines held more than `max_lost` of its word characters.

All columns are native expressions on one row; nothing is shuffled. Repeated windows are found
by sorting (window hash, position) packed into one long per document; equal neighbours are
compared word by word. (The packed hash keeps 63 bits less those of the position, 48 or more
up to 32 000 words; a repeat could be missed only where two different windows share it.)

Null text counts as empty: no words, so `base_failed`. Repeated rows are judged one by one.
A text without a line break is one line. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepoint.functions.points import evaluate_once
from tidepoint.llm.catalog import query
from tidepoint.llm.common import fresh, table

# Fixed phrases, compared in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "general public license", "apache license", "mit license",
    "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "enable javascript",
    "click here", "subscribe to our", "sign up for", "share on facebook", "follow us on",
)
BOILERPLATE_PATTERN = "|".join(BOILERPLATE)
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
SYMBOL = r"[#*$%&|<>]"
END_MARK = r"""[.!?:;]["')\]]*[\x20\x09-\x0D]*$"""
SEPARATOR = r"(^|[\x20\x09-\x0D])([|>/]|::|»|•|·)([\x20\x09-\x0D]|$)"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _without(text, pattern: str):
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def line_fails(line, short_words: int = 5, max_separators: float = 0.2, max_punctuation: float = 0.2):
    """Boolean column: the line has words and fails a rule."""
    words = F.regexp_count(line, F.lit(WORD))
    chars = F.length(F.regexp_replace(line, SPACE, ""))
    marks = F.regexp_count(line, F.lit(PUNCTUATION))
    navigation = (F.regexp_count(line, F.lit(SEPARATOR)) > words * max_separators) | (
        (words < short_words) & ~line.rlike(END_MARK)
    )
    return (words > 0) & (navigation | (marks - 1 > chars * max_punctuation) | F.lower(line).rlike(BOILERPLATE_PATTERN))


FIGURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "clean_chars", "base_failed",
)


def judge(docs: DataFrame, max_lost: float = 0.3, **rules) -> DataFrame:
    """doc_id, text, clean_text and the figures and verdicts of every document."""
    return _judged(fresh(docs, "doc_id", "text"), max_lost, rules).select("doc_id", "text", "clean_text", *FIGURES, "kept")


def _judged(docs: DataFrame, max_lost: float, rules: dict) -> DataFrame:
    docs = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    docs = evaluate_once(docs.withColumns({
        "_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)),
        "_lines": F.split("_text", "\n"),
    }))
    # Window i starts at word i; its long is the hash shifted left by the bits of n_words, and i below them.
    docs = evaluate_once(docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_bits": F.length(F.bin(F.size("_words").cast("long"))),
        "_packed": F.expr("""
            sort_array(transform(
                if(size(_words) > 2, sequence(0, size(_words) - 3), cast(array() as array<int>)),
                i -> shiftleft(xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)),
                               length(bin(cast(size(_words) as bigint)))) | i))"""),
        "_kept_lines": F.filter("_lines", lambda line: ~line_fails(line, **rules)),
        "_wordy": F.filter("_lines", lambda line: line.rlike(WORD)),
    }))
    same = """shiftright(x, _bits) = shiftright({y}, _bits)
        and get(_words, int(x & mask)) = get(_words, int({y} & mask))
        and get(_words, int(x & mask) + 1) = get(_words, int({y} & mask) + 1)
        and get(_words, int(x & mask) + 2) = get(_words, int({y} & mask) + 2)
    """.replace("mask", "(shiftleft(1L, _bits) - 1)")
    docs = evaluate_once(docs.withColumns({
        "clean_text": F.array_join("_kept_lines", "\n"),
        "_again": F.expr(
            f"filter(_packed, (x, i) -> ({same.format(y='get(_packed, i + 1)')})"
            f" or (i > 0 and {same.format(y='get(_packed, i - 1)')}))"
        ),
    }))
    docs = docs.withColumns({
        "word_chars": _without(F.col("_text"), SPACE),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": (F.size("_wordy") - F.size(F.array_distinct("_wordy"))).cast("long"),
        "n_repeat_words": F.expr("""
            size(array_distinct(flatten(transform(_again, x -> sequence(
                x & (shiftleft(1L, _bits) - 1), (x & (shiftleft(1L, _bits) - 1)) + 2)))))""").cast("long"),
        "n_bad_lines": (F.size("_lines") - F.size("_kept_lines")).cast("long"),
        "clean_chars": _without(F.col("clean_text"), SPACE),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.col("word_chars") - F.col("clean_chars")
    return docs.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (lost <= F.col("word_chars") * max_lost)
    )


def clean(docs: DataFrame, max_lost: float = 0.3, **rules) -> DataFrame:
    """The documents that pass, without their failing lines; the columns of `docs`, n_chars brought up to date."""
    columns = docs.columns
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("_row"))
    judged = _judged(rows, max_lost, rules).where("kept")
    values = {
        "text": F.when(F.col("text").isNotNull(), F.col("clean_text")), "n_chars": F.length("clean_text").cast("long"),
    }
    return judged.select(*[values[c].alias(c) if c in values else F.col("_row")[c].alias(c) for c in columns])


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l
    FROM documents
), l AS (
    SELECT r, i, l[i] AS line FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM d)
), m AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
           length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c,
           len(regexp_extract_all(line, '{PUNCTUATION}')) AS p,
           len(regexp_extract_all(line, '{SEPARATOR}')) AS s
    FROM l
), v AS (
    SELECT *, n > 0 AND (s > n * 0.2 OR (n < 5 AND NOT regexp_matches(line, '{END_MARK.replace("'", "''")}'))
                         OR p - 1 > c * 0.2 OR regexp_matches(lower(line), '{BOILERPLATE_PATTERN}')) AS bad
    FROM m
), g AS (
    SELECT r, count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(c) FILTER (NOT bad), 0) AS clean_chars,
           count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines
    FROM v GROUP BY r
), k AS (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), a AS (
    SELECT r, count(DISTINCT j) AS n_repeat_words FROM (
        SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS f FROM k) WHERE f > 1
    ) GROUP BY r
), b AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_bad_lines,
           CAST(clean_chars AS BIGINT) AS clean_chars
    FROM d JOIN g USING (r) LEFT JOIN a USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - clean_chars <= word_chars * 0.3 AS kept
FROM b
"""


@query("op10_line_quality", SQL)
def line_quality(spark, sf):
    return judge(table(spark, sf, "documents")).drop("text", "clean_text")
