"""Benchmark decontamination: a broadcast set of test windows, searched in every window of the training texts.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII bytes. Every run of
`size` consecutive words of a benchmark item is a window; an item with fewer words (but some) is one
window. A training word is hit when it lies inside an occurrence of a window. Occurrences
are found by hash and verified on their words.

The window set is broadcast only up to `block_windows` windows; a larger benchmark is cut by
window hash into blocks of that bound, each broadcast in its turn, and the hits of all blocks are united.

Null text has no words: nothing is hit, not contaminated. A null item_id is reported as such
but does not enter the list of items; repeated items and rows count as they stand (items by
distinct id). Columns other than doc_id and text, or item_id and text, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import fresh, stored, table
from tidepoint.llm.words import LOWER_KEYS, PLAIN, text_slices, windows, words_of

BLOCK_WINDOWS = 200_000  # about 40 MB of hashes and words
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def benchmark_windows(items: DataFrame, size: int = 13) -> DataFrame:
    """hash, n, words, items: one row for each distinct window (its words joined by one space) and its items."""
    def cut(batches):
        for batch in batches:
            ids, texts = batch.column("item_id").to_pylist(), batch.column("text")
            out = {"hash": [], "n": [], "words": [], "item": []}
            for first, data, off in text_slices(texts):
                rows, starts, lengths, hashes = words_of(data, off, PLAIN, LOWER_KEYS)
                raw = data.tobytes().translate(LOWER)
                counts = np.bincount(rows, minlength=len(off) - 1)
                for n in sorted({min(size, int(c)) for c in counts if c}):
                    at, hs = windows(hashes, rows, n)
                    for p, h in zip(at.tolist(), hs.tolist()):
                        if min(size, int(counts[rows[p]])) == n:
                            out["hash"].append(h - (1 << 64) if h >> 63 else h)
                            out["n"].append(n)
                            out["words"].append(b" ".join(raw[starts[k] : starts[k] + lengths[k]] for k in range(p, p + n)))
                            out["item"].append(ids[first + rows[p]])
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("hash", pa.int64()), ("n", pa.int32()), ("words", pa.binary()), ("item", pa.int64())]))

    rows = fresh(items, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long"))
    return rows.mapInArrow(cut, "hash long, n int, words binary, item long").groupBy("hash", "n", "words").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )


def hits(docs: DataFrame, items: DataFrame, size: int = 13, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of `docs` (all its columns kept) with n_words, n_hit, items (sorted, distinct) and spans.

    spans are the hit runs as [first word, past the last word] pairs.
    """
    spark = docs.sparkSession
    found = stored(benchmark_windows(items, size), "benchmark-windows")
    blocks = max(1, -(-found.count() // block_windows))
    found = found.withColumn("_block", F.pmod(F.xxhash64("hash"), F.lit(blocks)))
    out = docs.withColumn("_hits", F.lit(None).cast("struct<n_words:long,spans:array<struct<a:int,b:int>>,items:array<long>>"))
    for block in range(blocks):  # block_windows in expectation; one collect of that bounded block
        rows = found.where(F.col("_block") == block).select("hash", "n", "words", "items").collect()
        out = _search(out, spark.sparkContext.broadcast([(r.hash, r.n, bytes(r.words), list(r.items)) for r in rows]))
    covered = F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.withColumns({
        "n_words": F.col("_hits.n_words"), "n_hit": covered, "items": F.col("_hits.items"), "spans": F.col("_hits.spans"),
    }).drop("_hits")


def _search(docs: DataFrame, shared) -> DataFrame:
    """Add one block's occurrences to the `_hits` of every row."""
    def search(batches):
        known: dict[int, list] = {}
        for h, n, words, ids in shared.value:
            known.setdefault(h & (2**64 - 1), []).append((n, words, ids))
        sizes = sorted({n for _, n, _, _ in shared.value})
        table_ = np.array(sorted(known), np.uint64)
        bits = np.zeros(1 << 20, bool)  # most windows are turned away by one look here
        bits[(table_ & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            names = batch.schema.names
            texts, before = batch.column(names.index("text")), batch.column(names.index("_hits")).to_pylist()
            for first, data, off in text_slices(texts):
                rows, starts, lengths, hashes = words_of(data, off, PLAIN, LOWER_KEYS)
                counts = np.bincount(rows, minlength=len(off) - 1)
                marks, ids_of = np.zeros(len(rows) + 1, np.int64), {}
                for n in sizes:
                    at, hs = windows(hashes, rows, n)
                    near = np.flatnonzero(bits[(hs & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    near = near[np.isin(hs[near], table_)]
                    for p, h in zip(at[near].tolist(), hs[near].tolist()):
                        text = b" ".join(data[starts[k] : starts[k] + lengths[k]].tobytes() for k in range(p, p + n)).translate(LOWER)
                        for m, words, ids in known[h]:
                            if m == n and words == text:
                                marks[p] += 1
                                marks[p + n] -= 1
                                ids_of.setdefault(int(rows[p]), set()).update(i for i in ids if i is not None)
                head = np.concatenate([[0], np.cumsum(counts)])
                hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                for r in np.unique(rows[hit]).tolist():
                    inner = hit[(hit >= head[r]) & (hit < head[r + 1])] - head[r]
                    old = before[first + r]
                    if old:
                        inner = np.union1d(inner, np.concatenate([np.arange(s["a"], s["b"]) for s in old["spans"]] or [inner[:0]]))
                    edge = np.flatnonzero(np.diff(inner) > 1)
                    a, b = inner[np.concatenate([[0], edge + 1])], inner[np.concatenate([edge, [len(inner) - 1]])] + 1
                    before[first + r] = {
                        "spans": [{"a": int(x), "b": int(y)} for x, y in zip(a, b)],
                        "items": sorted(ids_of.get(r, set()) | set(old["items"] if old else ())),
                    }
                for r, n in enumerate(counts.tolist()):
                    before[first + r] = {"n_words": n, **{k: v for k, v in (before[first + r] or {"spans": [], "items": []}).items() if k != "n_words"}}
            yield batch.set_column(names.index("_hits"), batch.schema.field("_hits"), pa.array(before, batch.schema.field("_hits").type))

    return docs.mapInArrow(search, docs.schema)


def contaminated(n_hit=None, n_words=None):
    """The contract's rule: a hit, and at least one word in twenty hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame, mode: str = "documents", **options) -> DataFrame:
    """`docs` without contaminated documents; mode "spans" cuts the hit words out of them instead.

    Cutting removes the hit words with the white space and marks up to the next word.
    """
    columns = docs.columns
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("_row"))
    judged = hits(rows, items, **options)
    if mode == "documents":
        judged = judged.where(~contaminated())
        text = F.col("text")
    elif mode == "spans":
        # Pieces: each word with what follows it, and what comes before the first word.
        word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
        pieces = F.regexp_extract_all("text", F.lit(f"{word}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))
        head = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
        left = F.filter(pieces, lambda _, i: ~F.exists("spans", lambda s: (i >= s["a"]) & (i < s["b"])))
        text = F.when(contaminated(), F.concat(head, F.array_join(left, ""))).otherwise(F.col("text"))
    else:
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    values = {"text": text, "n_chars": F.when(contaminated(), F.length(text).cast("long")).otherwise(F.col("_row")["n_chars"])
              if "n_chars" in columns else None}
    return judged.select(*[values[c].alias(c) if c in values else F.col("_row")[c].alias(c) for c in columns])


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), k AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k
    FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), g AS (
    SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k))
), h AS (
    SELECT r, i, n, item_id FROM g JOIN k USING (n, k)
), m AS (
    SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r
), t AS (
    SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN m USING (r) LEFT JOIN t USING (r)
"""


@query("op4_decontaminate", SQL)
def decontaminate(spark, sf):
    found = hits(fresh(table(spark, sf, "documents"), "doc_id", "text"), table(spark, sf, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
