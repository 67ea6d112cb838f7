"""Phrase collocations, counted by Rabin-Karp fingerprints and verified against the text.

Prefix polynomials over 64-bit word hashes give the fingerprint of every n-gram of a block of text as one difference and one
product (numpy, modulo 2^64). Three passes over the texts count, each merging on the way to one row a fingerprint:

1. words, exactly, as text;
2. fingerprints of pairs whose two words are frequent;
3. fingerprints of 3 to `longest` words, all of whose pairs are frequent.

A phrase is at most as frequent as its parts, so nothing frequent is lost. What is frequent travels to the next pass as a
Bloom filter of bounded size (MOST_BITS); false positives cost rows and nothing else. Fingerprints only choose: the fourth pass
materialises the text of every occurrence whose fingerprint is frequent, and Spark counts by the text itself, with a
pointer to the smallest document that holds it. Phrases that shared a fingerprint part there, so collisions change nothing.

Defined results: null text is empty, null lang is `und`; texts of any length are read whole, in blocks cut between pieces or,
inside a long piece, with an overlap that is not counted twice; a single word is held whole; repeated rows count again;
tied scores go by count, then by the bytes of the phrase; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import stored, table
from tidepoint.llm.words import LOWER_KEYS, STEP, mix, words_of

BLOCK_BYTES = 1 << 19
BUFFER = 1 << 20  # fingerprints a task holds before it merges them
TEXT_BUFFER = 1 << 19  # texts
MOST_BITS = 1 << 28  # the largest filter: 32 MB for each pass
BITS_EACH = 12
PROBES = 3
BASE = np.uint64(0xD1342543DE82EF95)
BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
SALT = [np.uint64(k * int(STEP) % 2**64) for k in range(64)]
# `[.,;:!?\x0A-\x0D]` between pieces, `[\x20\x09]` between words
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
INSIDE = ~BREAK
INSIDE[[32, 9]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block:
    """Words of whole rows, or of a part of one long row: hash, row, piece, and how many leading words were seen before."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first_row: int, seen: int = 0):
        self.data, self.seen = data, seen
        rows, self.starts, self.lengths, self.hashes = words_of(data, off, INSIDE, LOWER_KEYS)
        self.rows = rows + first_row
        # Pieces are numbered by the breaks before them; a new row is a new piece.
        self.pieces = np.cumsum(BREAK[data])[self.starts] + rows if len(self.starts) else rows

    def text(self) -> pa.Array:
        """The lower-cased words."""
        packed = LOWER[self.data[INSIDE[self.data]]]
        ends = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(ends), pa.py_buffer(packed))


def blocks(texts: pa.Array, overlap: int, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Texts as blocks of about `size` bytes; `overlap` words are repeated where a piece is cut."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        if off[j] - off[i] <= size:
            yield Block(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        else:
            yield from _parts(data[off[i] : off[j]], i, overlap, size)
        i = j


def _parts(data: np.ndarray, row: int, overlap: int, size: int) -> Iterator[Block]:
    start, seen, reach = 0, 0, size
    while start < len(data):
        end = min(start + reach, len(data))
        if end < len(data):
            breaks = np.flatnonzero(BREAK[data[start:end]])
            gaps = breaks if len(breaks) else np.flatnonzero(~INSIDE[data[start:end]])
            if not len(gaps):
                reach *= 2
                continue
            end = start + int(gaps[-1]) + 1
        block = Block(data[start:end], np.array([0, end - start]), row, seen)
        cut = end < len(data) and not BREAK[data[end - 1]]
        if cut and len(block.starts) <= overlap + seen:
            reach *= 2
            continue
        yield block
        seen, reach = (overlap, size) if cut else (0, size)
        start += int(block.starts[-overlap]) if cut and overlap else end - start


def fingerprints(hashes: np.ndarray, seeds: np.ndarray, longest: int, bits: int = 64) -> list[np.ndarray]:
    """For n = 1 .. longest the fingerprint of the n words from each position on; seeds keep languages apart."""
    count = len(hashes)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(count, BASE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(count, BASE_INVERSE)]))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[:count], dtype=np.uint64)])
    out = []
    for n in range(1, longest + 1):
        m = max(count - n + 1, 0)
        value = mix((prefix[n : n + m] - prefix[:m]) * back[:m] + seeds[:m] + SALT[n])
        out.append(value >> np.uint64(64 - bits) if bits < 64 else value)
    return out


def _probes(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield mix(values + SALT[k + 1]) & np.uint64(bits - 1)


class Filter:
    """A Bloom filter over fingerprints, sent once to each executor."""

    def __init__(self, spark: SparkSession, values: DataFrame, most_bits: int = MOST_BITS):
        count = values.count()
        bits = 1 << 12
        while bits < BITS_EACH * count and bits < most_bits:
            bits *= 2

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(list(_probes(batch[0].to_numpy().view(np.uint64), bits))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], names=["cell", "bit"])

        # At most bits / 64 cells reach the driver.
        cells = values.mapInArrow(places, "cell long, bit long").groupBy("cell").agg(
            F.expr("bit_or(shiftleft(1L, cast(bit AS int)))").alias("word")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[cells["cell"].to_numpy()] = cells["word"].to_numpy().view(np.uint64)
        self.bits, self.words = bits, spark.sparkContext.broadcast(words)

    def holds(self, values: np.ndarray) -> np.ndarray:
        words, out = self.words.value, np.ones(len(values), bool)
        for at in _probes(values, self.bits):
            out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _prepared(docs: DataFrame, id_column: str) -> DataFrame:
    lang = F.coalesce("lang", F.lit("und"))
    return docs.select(F.col(id_column).alias("id"), lang.alias("lang"), F.xxhash64(lang).alias("seed"), F.coalesce("text", F.lit("")).alias("text"))


def _emit(groups: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Grouped rows as batches, strings in the type Spark reads."""
    for part in groups.select(names).to_batches(max_chunksize=1 << 15):
        columns = [c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in part.columns]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _merging(parts: Iterator[pa.Table], merge: Callable[[pa.Table], pa.Table], names: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Tables merged whenever `most` rows are held; what does not shrink to half of that leaves the task."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part)
        if rows >= most:
            held = [merge(pa.concat_tables(held))]
            rows = len(held[0])
            pa.default_memory_pool().release_unused()
            if rows >= most // 2:
                yield from _emit(held[0], names)
                held, rows = [], 0
    if rows:
        yield from _emit(merge(pa.concat_tables(held)), names)


def _sum_by(keys: list[str], *more: tuple[str, str]) -> Callable[[pa.Table], pa.Table]:
    def merge(rows: pa.Table) -> pa.Table:
        out = rows.group_by(keys).aggregate([("f", "sum"), *more])
        return out.rename_columns([{"f_sum": "f", **{f"{c}_{how}": c for c, how in more}}.get(c, c) for c in out.column_names])

    return merge


def count_words(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, phrase, f of every single word."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            langs = batch["lang"].cast(pa.large_string()).dictionary_encode()
            for block in blocks(batch["text"], 0, block_bytes):
                words = block.text().dictionary_encode()
                lang = langs.indices.to_numpy()[block.rows].astype(np.int64)
                key, f = np.unique(words.indices.to_numpy() * np.int64(len(langs.dictionary)) + lang, return_counts=True)
                word, lang = np.divmod(key, max(len(langs.dictionary), 1))
                yield pa.table({"lang": langs.dictionary.take(pa.array(lang)), "phrase": words.dictionary.take(pa.array(word)), "f": f})

    merge = _sum_by(["lang", "phrase"])
    counted = docs.select("lang", "text").mapInArrow(
        lambda batches: _merging(parts(batches), merge, ["lang", "phrase", "f"], TEXT_BUFFER), "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_fingerprints(words: DataFrame, bits: int = 64) -> DataFrame:
    """fp of each single word in a table of lang, phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch["seed"].to_numpy().view(np.uint64)
            for block in blocks(batch["phrase"], 0):
                fp = fingerprints(block.hashes, seeds[block.rows], 1, bits)[0]
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], names=["fp"])

    return words.select(F.xxhash64("lang").alias("seed"), "phrase").mapInArrow(run, "fp long")


def _hits(block: Block, seeds: np.ndarray, sizes: range, unit: int | None, known: Filter, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, positions, fingerprints) of the n-grams whose every part of `unit` words (None: themselves) is in the filter."""
    prints = fingerprints(block.hashes, seeds[block.rows], sizes[-1], bits)
    allowed = known.holds(prints[unit - 1]) if unit else None
    for n in sizes:
        m = len(prints[n - 1])
        good = block.pieces[:m] == block.pieces[n - 1 :]
        good[: max(block.seen - n + 1, 0)] = False
        for k in range(n - unit + 1) if unit else ():
            good &= allowed[k : k + m]
        at = np.flatnonzero(good)
        if not unit:
            at = at[known.holds(prints[n - 1][at])]
        yield n, at, prints[n - 1][at]


def frequent_fingerprints(docs: DataFrame, sizes: range, unit: int, known: Filter, at_least: int, bits: int = 64, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """fp of every n-gram of these sizes that may be frequent: its parts of `unit` words are, and its count is reached."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            seeds = batch["seed"].to_numpy().view(np.uint64)
            for block in blocks(batch["text"], sizes[-1] - 1, block_bytes):
                found = np.concatenate([fp for _, _, fp in _hits(block, seeds, sizes, unit, known, bits)])
                yield pa.table({"fp": found.view(np.int64), "f": np.ones(len(found), np.int64)})

    def merge(rows: pa.Table) -> pa.Table:
        fp, f = rows["fp"].to_numpy(), rows["f"].to_numpy()
        order = np.argsort(fp)
        fp = fp[order]
        heads = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        return pa.table({"fp": fp[heads], "f": np.add.reduceat(f[order], heads)})

    counted = docs.select("seed", "text").mapInArrow(lambda batches: _merging(parts(batches), merge, ["fp", "f"], BUFFER), "fp long, f long")
    return counted.groupBy("fp").agg(F.sum("f").alias("f")).where(F.col("f") >= at_least).select("fp")


def materialised(docs: DataFrame, sizes: range, known: Filter, at_least: int, bits: int = 64, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, phrase, f, example of the frequent phrases, counted by their text; example is the smallest id of a document with it."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            langs, seeds = batch["lang"].cast(pa.large_string()).dictionary_encode(), batch["seed"].to_numpy().view(np.uint64)
            for block in blocks(batch["text"], sizes[-1] - 1, block_bytes):
                words, found = block.text(), []
                codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
                for n, at, _ in _hits(block, seeds, sizes, None, known, bits):
                    key = lang = langs.indices.to_numpy()[block.rows[at]]
                    for k in range(n):  # the words themselves tell phrases apart, not their hashes
                        _, key = np.unique(key, return_inverse=True)
                        key = key * np.int64(len(codes)) + codes[at + k]
                    _, first, key, f = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    least = pa.table({"key": key, "example": batch["id"].take(pa.array(block.rows[at]))}).group_by("key").aggregate(
                        [("example", "min")]).sort_by("key")["example_min"]
                    text = pc.binary_join_element_wise(*(words.take(pa.array(at[first] + k)) for k in range(n)), pa.scalar(" ", pa.large_string()))
                    found.append(pa.table({"lang": langs.dictionary.take(pa.array(lang[first])), "phrase": text, "f": f, "example": least}))
                yield pa.concat_tables(found)

    merge = _sum_by(["lang", "phrase"], ("example", "min"))
    kind = docs.schema["id"].dataType.simpleString()
    counted = docs.select("id", "lang", "seed", "text").mapInArrow(
        lambda batches: _merging(parts(batches), merge, ["lang", "phrase", "f", "example"], TEXT_BUFFER), f"lang string, phrase string, f long, example {kind}")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("example").alias("example")).where(F.col("f") >= at_least)


def frequent_phrases(
    docs: DataFrame, at_least: int = 100, longest: int = 5, id_column: str = "doc_id", bits: int = 64, most_bits: int = MOST_BITS,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f of all words; lang, phrase, f, example of the frequent phrases of 2 to `longest` words), both stored."""
    if not 2 <= longest < len(SALT) or at_least < 1:
        raise ValueError("phrases have 2 to 63 words and occur at least once")
    spark, docs = docs.sparkSession, _prepared(docs, id_column)
    words = stored(count_words(docs, block_bytes), "words")
    known = Filter(spark, word_fingerprints(words.where(F.col("f") >= at_least), bits), most_bits)
    prints = stored(frequent_fingerprints(docs, range(2, 3), 1, known, at_least, bits, block_bytes), "pairs")
    if longest > 2:
        pairs = Filter(spark, prints, most_bits)
        prints = prints.union(stored(frequent_fingerprints(docs, range(3, longest + 1), 2, pairs, at_least, bits, block_bytes), "longer"))
    chosen = Filter(spark, prints, most_bits)
    return words, stored(materialised(docs, range(2, longest + 1), chosen, at_least, bits, block_bytes), "phrases")


def _exact(column: str) -> F.Column:
    return F.col(column).cast("decimal(17,0)")


def collocations(
    docs: DataFrame, at_least: int = 100, longest: int = 5, top: int = 2000, id_column: str = "doc_id", **how,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, example: each language's first `top` phrases by their weakest cut."""
    words, phrases = frequent_phrases(docs, at_least, longest, id_column, **how)
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    parts = words.where(F.col("f") >= at_least).select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))
    split = phrases.withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))

    # A phrase inside a longer one that is as frequent goes.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    longer = split.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("around"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    alone = split.join(longer, ["lang", "phrase"], "left").where("around is null or 100 * around < 100 * a").drop("around")

    cuts = alone.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "example", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"))
    left, right = (parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f)) for name, f in (("first", "l"), ("rest", "r")))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("top", F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("n")).withColumn("under", _exact("l") * _exact("r"))
    best = scored.groupBy("lang", "phrase", "a", "n", "example").agg(
        F.min(F.struct(F.expr("cast(top div under as long)").alias("score"), "k", "l", "r")).alias("best")
    ).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "example")

    # A language may hold most phrases, so each share of it is cut to `top` rows before they are ranked together.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
    ranked = best.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "example")


@query("op13_phrases", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
      FROM w, range(1, 6) sizes(m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
inner_parts AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS around
      FROM c, range(2, 5) sizes(s), range(1, 5) starts(i) WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
alone AS (SELECT c.* FROM c LEFT JOIN inner_parts i USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a),
cuts AS (SELECT a.*, k, x.f AS l, y.f AS r, (1000::HUGEINT * a.a * n.n // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM alone a, range(1, 5) ks(k), f x, f y, n
      WHERE k < a.m AND x.lang = a.lang AND x.phrase = array_to_string(a.w[1:k], ' ') AND y.lang = a.lang
        AND y.phrase = array_to_string(a.w[k + 1:], ' ') AND n.lang = a.lang),
best AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT best.*, n.n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best JOIN n USING (lang))
WHERE rank <= 2000
""")
def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents")).drop("example")
