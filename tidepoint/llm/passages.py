"""Repeated passages: MinHash banding of paragraphs, exact Jaccard, removals by components.

Passages need not respect line breaks, so a paragraph is cut by content: a new one begins at each word whose
word-pair hash is the least within REACH words on both sides. The cuts inside a passage are then the same
wherever it stands. A paragraph has some 13 words, so one of over 50 words holds several whole ones.

Each paragraph gets BANDS bands of one least shingle hash (5 words), so any two paragraphs with Jaccard
similarity of 0.75 or more collide but for one in sixteen, and equal ones always. Rows of one band lie side
by side after a range sort in which a band may span tasks; those alone in their band are dropped on the
spot. Colliding contents whose 32-bit shingle maps differ too much are passed over, the others verified on their full shingle sets, up to LEAF contents of a
band pairwise and more against the most frequent content of the band and of both bands together. The
contents of such hot bands also meet on their rarest shingles in an exact join (near_dedup.crowd_pairs), but for
pairs that share a component by then. Components of confirmed links are the clusters; within one, all but the first paragraph are removed.

Reported are runs of adjacent repeated paragraphs of at least LEAST words whose clusters span several documents;
a passage of over 50 words keeps that many after the loss at both ends. Null text has no words. Repeated rows of
one doc_id are one document. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import fresh, stored, table
from tidepoint.llm.graph import components
from tidepoint.llm.near_dedup import crowd_pairs
from tidepoint.llm.words import LOWER_KEYS, POSITION, SPACED, mix, text_slices, windows, words_of

REACH, BANDS, SHINGLE, PERCENT, LEAF, LEAST = 6, 2, 5, 75, 8, 24
BROADCAST_PARTS = 500_000
TOP = np.uint64(2**64 - 1)


def cuts(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Word positions at which a paragraph begins."""
    n = len(hashes)
    fresh_row = np.append(True, rows[1:] != rows[:-1])
    pair = mix(hashes * np.uint64(3) + np.append(hashes[1:], np.uint64(0)) * np.uint64(5))
    pair[np.append(fresh_row[1:], True)] = TOP  # the last word of a text has no follower
    at = np.arange(n) + REACH * np.cumsum(fresh_row)  # room between texts
    wide = np.full(int(at[-1]) + REACH + 1, TOP)
    wide[at] = pair
    low = np.full(n, TOP)
    for k in range(1, REACH + 1):
        low = np.minimum(low, np.minimum(wide[at - k], wide[at + k]))
    return np.flatnonzero(fresh_row | (pair < low))


def paragraphs(texts: pa.Array):
    """For each slice: row, start word, words, key, bands (BANDS arrays), and the shingle hashes of its words."""
    for first, data, off in text_slices(texts):
        rows, _, _, hashes = words_of(data, off, SPACED, LOWER_KEYS)
        if not len(hashes):
            continue
        head = cuts(hashes, rows)
        size = np.diff(np.append(head, len(hashes)))
        inner = np.arange(len(hashes)) - np.repeat(head, size)
        key = mix(np.add.reduceat(hashes * POSITION[inner % 64] + inner.astype(np.uint64), head) + size.astype(np.uint64))
        shingle = np.full(len(hashes), TOP)
        at, grams = windows(hashes, rows, SHINGLE)
        shingle[at] = grams
        shingle[inner > np.repeat(size, size) - SHINGLE] = TOP
        bands = []
        for b in range(BANDS):
            ranked = np.where(shingle == TOP, TOP, mix(shingle + np.uint64(b + 1) * POSITION[b]))
            least = np.minimum.reduceat(ranked, head)
            bands.append(mix(np.where(least == TOP, key, least) + np.uint64(b)))
        row_head = np.searchsorted(rows, np.arange(len(off) - 1))
        yield first + rows[head], head - row_head[rows[head]], size, key, bands, shingle, head


SCHEMA = pa.schema([("band", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("other", pa.int64()), ("bits", pa.int32())])


def banded(docs: DataFrame) -> DataFrame:
    """band, doc_id, start, n, key, other (the next band), bits (map of the shingles): a row for each paragraph and band."""
    def run(batches):
        for batch in batches:
            for row, start, size, key, bands, shingle, head in paragraphs(batch.column("text")):
                bit = np.where(shingle == TOP, np.uint32(0), np.uint32(1) << (shingle >> np.uint64(59)).astype(np.uint32))
                bits = np.bitwise_or.reduceat(bit, head).view(np.int32)
                doc = batch.column("doc_id").take(pa.array(row))
                for b in range(BANDS):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(bands[b].view(np.int64)), doc, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
                        pa.array(key.view(np.int64)), pa.array(bands[(b + 1) % BANDS].view(np.int64)), pa.array(bits)], schema=SCHEMA)

    return docs.mapInArrow(run, "band long, doc_id long, start int, n int, key long, other long, bits int")


def colliding(rows: DataFrame) -> DataFrame:
    """The rows that share their band with another. A task's first and last row always stay: their partner may be next door."""
    def run(batches):
        held = None
        first, before = True, False
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            band = batch.column("band").to_numpy()
            same = np.append(False, band[1:] == band[:-1])
            keep = same | np.append(same[1:], False)
            # The row held over stands in for what came before it.
            keep[0] = keep[0] or first or before
            first, before, held = False, bool(same[-1]), batch.slice(len(batch) - 1)
            yield batch.slice(0, len(batch) - 1).filter(pa.array(keep[:-1]))
        if held is not None:
            yield held

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "band", "doc_id", "start").sortWithinPartitions("band").mapInArrow(run, rows.schema)


def key_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a < b: contents that collide and may be similar; key: the contents of hot bands."""
    contents = stored(rows.groupBy("band", "key", "other", "n", "bits").agg(F.count(F.lit(1)).alias("f")), "passage-contents")
    sizes = contents.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    contents = contents.join(sizes, "band")
    few, many = contents.where(F.col("c") <= LEAF), contents.where(F.col("c") > LEAF)
    # In sets with a similarity of 0.75 or more a seventh of both sizes differs at most, and so many bits of the maps.
    near = F.expr("a <> b and 7 * bit_count(bits ^ map) <= greatest(n - 4, 1) + greatest(m - 4, 1)")
    pairs = few.select("band", F.col("key").alias("a"), "n", "bits").join(
        few.select("band", F.col("key").alias("b"), F.col("n").alias("m"), F.col("bits").alias("map")), "band").where(near & F.expr("a < b"))
    for group in (["band"], ["band", "other"]):
        top = many.groupBy(*group).agg(F.max(F.struct("f", "key", "n", "bits")).alias("t")).select(
            *group, F.col("t.key").alias("b"), F.col("t.n").alias("m"), F.col("t.bits").alias("map"))
        pairs = pairs.unionByName(many.select(*group, F.col("key").alias("a"), "n", "bits").join(top, group).where(near).select(*pairs.columns))
    # Contents of less than a shingle are alone in their band or equal.
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), many.where(f"n >= {SHINGLE}").select("key").distinct()


def shingle_sets(docs: DataFrame, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, shingles (8 bytes each, sorted) of the named contents; each is read where it first stands."""
    def sets(batches):
        for batch in batches:
            wanted = [dict.fromkeys(x) for x in batch.column("wanted").to_pylist()]
            out = {"key": [], "shingles": []}
            for row, start, size, key, _, shingle, head in paragraphs(batch.column("text")):
                for i in range(len(row)):
                    if int(start[i]) in wanted[row[i]]:
                        s = shingle[head[i] : head[i] + size[i]]
                        out["key"].append(int(key.view(np.int64)[i]))
                        out["shingles"].append(np.unique(s[s != TOP]).tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.int64()), ("shingles", pa.binary())]))

    where = rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("w"))
    wanted = stored(where.groupBy("w.doc_id").agg(F.collect_list("w.start").alias("wanted")), "passage-wanted")
    small = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    wanted = wanted.withColumnRenamed("doc_id", "_d")
    texts = docs.join(F.broadcast(wanted) if small <= BROADCAST_PARTS else wanted, F.col("doc_id").eqNullSafe(F.col("_d"))).select("text", "wanted")
    return texts.mapInArrow(sets, "key long, shingles binary").dropDuplicates(["key"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold."""
    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(check, "a long, b long")


def clusters_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """id, component of the contents that are linked with another."""
    pairs, hot = key_pairs(rows)
    pairs, hot = stored(pairs, "passage-pairs"), stored(hot, "passage-hot")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(hot).distinct()
    sets = stored(shingle_sets(docs, rows, keys), "passage-sets")
    links = stored(confirmed(pairs, sets), "passage-links")
    named = stored(components(links), "passage-components")
    if not hot.isEmpty():
        # Contents of less than a shingle have an empty set.
        crowded = sets.join(hot, "key", "left_semi").where(F.length("shingles") > 0).withColumnRenamed("key", "id")
        rest = crowd_pairs(crowded, named).join(pairs, ["a", "b"], "left_anti")
        more = stored(confirmed(rest, sets), "passage-links")
        if not more.isEmpty():
            named = components(links.union(more))
    return named


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start (word), n_words, first_doc, removed_words: runs of words that other documents hold too."""
    docs = fresh(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stored(colliding(banded(docs)), "passage-rows")
    named = clusters_of(docs, rows)
    parts = rows.groupBy("doc_id", "start", "n", "key").agg(F.count(F.lit(1)).alias("_k")).drop("_k")
    parts = parts.join(named.withColumnRenamed("id", "key"), "key", "left").select(
        "doc_id", "start", "n", F.coalesce("component", "key").alias("cluster"))
    parts = stored(parts, "passage-parts")
    clusters = parts.groupBy("cluster").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max("doc_id").alias("l")).where(
        ~F.col("f.doc_id").eqNullSafe(F.col("l")))
    marked = parts.join(clusters.select("cluster", F.col("f.doc_id").alias("first_doc"), F.col("f.start").alias("_s")), "cluster")
    # The paragraphs of one document: no more than its text holds.
    order = Window.partitionBy("doc_id").orderBy("start")
    begins = F.coalesce(F.lag(F.col("start") + F.col("n")).over(order) != F.col("start"), F.lit(True))
    runs = marked.withColumn("_new", begins.cast("int")).withColumn("_run", F.sum("_new").over(order))
    again = ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("start") == F.col("_s")))
    return runs.groupBy("doc_id", "_run").agg(
        F.min("start").alias("start"), F.sum("n").alias("n_words"), F.min("first_doc").alias("first_doc"),
        F.sum(F.when(again, F.col("n")).otherwise(0)).alias("removed_words"),
    ).where(F.col("n_words") >= least).drop("_run")


@query("op6_passages")
def passages(spark, sf):
    return repeated(table(spark, sf, "documents"))
