"""MinHash near-duplicate removal with an LSH forest.

A document's set is its distinct 5-word shingles (hashed; fewer words: the sequence as one).
Equal sets are one class, named by its smallest doc_id; classes get a signature of 128 least values.
The forest has 32 trees, each an order of signature values. In an order, two classes with a
common prefix of MIN_DEPTH values are neighbours. Depth adapts to the region: a prefix shared by at
most LEAF classes yields all its pairs; a denser region pairs each class with the region's
centre. The centre is the class that meets most others over all trees: in a crowd of copies with random
edits that is their common origin, so a crowd costs one pair for each member and region and not its
square. All pairs of the first depth are confirmed first; only classes that then do not share the centre's
component go on to longer prefixes, down to 16 values, so a crowd is walked through once.

What the centres of dense regions leave open is found exactly: the classes of dense regions meet on
their rarest shingles (two sets with a similarity of 0.75 or more share one among the first
n - ceil(6n/7) + 1 of the smaller and n - ceil(3n/4) + 1 of the larger) and pass length and positional
filters. Pairs inside a component found before need no look; a shingle that one component alone
holds is dropped, and the members of its largest component meet only those outside it.

Pairs are first compared by size and signature (six standard errors below the threshold stay in),
then on their full sets. Of a class's pairs the most alike is checked first; pairs
inside a component so found need no check, all others get one. Components of confirmed links
decide: the smallest doc_id reachable is kept.

At the threshold of 0.75 a pair shares a prefix of 4 values in some tree but for 5 in a million, and
so is either a pair of a small region or one of dense regions' classes.

Null or wordless text has an empty set and is linked with nothing. Rows with one doc_id are one
document: their links are united. A null doc_id takes part under no name: its row has the
component of its equals, and is kept only if it has no other. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import fresh, stored, table
from tidepoint.llm.graph import components
from tidepoint.llm.words import LOWER_KEYS, SPACED, mix, text_slices, windows, words_of

SHINGLE = 5
PERCENT = 75
VALUES, TREES = 128, 32
DEPTHS = (4, 6, 8, 11, 16)
LEAF = 10
SLACK = 0.23  # six standard errors of a similarity of 0.75 estimated from 128 values
BROADCAST_IDS = 1_000_000  # 16 MB
COUNTERS = 1 << 18  # 2 MB
POST_ROWS = 1 << 20
_rng = np.random.default_rng(20240301)
FACTORS = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)


def tree_orders() -> np.ndarray:
    """Row t: the signature places of tree t. The first four places of all trees are disjoint."""
    first = np.arange(VALUES).reshape(TREES, DEPTHS[0])
    rest = [_order(t, first[t]) for t in range(TREES)]
    return np.concatenate([first, np.array(rest)], 1)


def _order(t: int, used: np.ndarray) -> np.ndarray:
    free = np.setdiff1d(np.arange(VALUES), used)
    return np.random.default_rng(t).permutation(free)[: DEPTHS[-1] - DEPTHS[0]]


ORDERS = tree_orders()


def shingle_sets(texts: pa.Array):
    """(row, sorted distinct shingle hashes) of every row, in order."""
    for first, data, off in text_slices(texts):
        rows, _, _, hashes = words_of(data, off, SPACED, LOWER_KEYS)
        counts = np.bincount(rows, minlength=len(off) - 1)
        at, grams = windows(hashes, rows, SHINGLE)
        head, gram_head = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(np.maximum(counts - SHINGLE + 1, 0))])
        for r, n in enumerate(counts.tolist()):
            if n >= SHINGLE:
                yield first + r, np.unique(grams[gram_head[r] : gram_head[r + 1]])
            elif n:
                yield first + r, windows(hashes[head[r] : head[r + 1]], np.zeros(n), n)[1]
            else:
                yield first + r, hashes[:0]


def signature(values: np.ndarray) -> np.ndarray:
    """The low 16 bits of 128 least values: the high ones of a least value are 0 in long texts, the low ones are even at any length."""
    least = np.full(VALUES, 2**64 - 1, np.uint64)
    for i in range(0, len(values), 512):  # bounds the memory a long text takes
        least = np.minimum(least, mix(values[i : i + 512, None] * FACTORS + SHIFTS).min(0))
    return (least & np.uint64(0xFFFF)).astype(np.uint16)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row_a, row_b, n_shingles, set_key (null: no words), sig; row_a and row_b name the row by its content."""
    def run(batches):
        for batch in batches:
            n, keys, sigs = [], [], []
            for _, s in shingle_sets(batch.column("text")):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "row_a", "row_b")), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.binary())], ["doc_id", "row_a", "row_b", "n_shingles", "set_key", "sig"])

    return docs.mapInArrow(run, "doc_id long, row_a long, row_b int, n_shingles long, set_key binary, sig binary")


def _row_names() -> dict:
    return {"row_a": F.xxhash64("doc_id", "text"), "row_b": F.hash("doc_id", "text")}


def _buckets(rows: DataFrame, level: int) -> DataFrame:
    """tree, bucket, id, n (and meets) of a level: from classes (level 0) or from rows of the level above with their signatures."""
    low = DEPTHS[level - 1] if level else 0
    orders = ORDERS[:, low : DEPTHS[level]]

    def prefix(batches):
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(len(batch), VALUES).astype(np.uint64)
            if level:
                tree = batch.column("tree").to_numpy()
                picked = np.take_along_axis(sig, orders[tree], 1)
                above = batch.column("bucket").to_numpy().view(np.uint64)
                kept = [batch.column(c) for c in ("id", "n", "meets")]
            else:
                picked = sig[:, orders].reshape(-1, orders.shape[1])
                tree = np.tile(np.arange(TREES, dtype=np.int32), len(batch))
                above = tree.astype(np.uint64)
                kept = [pa.array(np.repeat(batch.column(c).to_numpy(), TREES)) for c in ("id", "n")]
            for k in range(picked.shape[1]):
                above = mix(above * np.uint64(0x9E3779B97F4A7C15) + picked[:, k] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(above.view(np.int64)), *kept], names)

    names = ["tree", "bucket", "id", "n"] + (["meets"] if level else [])
    return rows.mapInArrow(prefix, "tree int, bucket long, id long, n int" + (", meets long" if level else ""))


def _similar_size(a: str, b: str):
    return PERCENT * F.greatest(a, b) <= 100 * F.least(a, b)


def _regions(rows: DataFrame) -> DataFrame:
    """`rows` of a level in regions of two classes or more, with c, the number of classes there."""
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return rows.join(shared, "bucket")


def _centred(rows: DataFrame, name: str) -> DataFrame:
    """Stored rows with their region's centre and its size m: of the region's classes the one that meets most others on level 0."""
    centre = rows.groupBy("bucket").agg(F.max(F.struct("meets", -F.col("id"), "id", "n")).alias("top")).select(
        "bucket", F.col("top.id").alias("centre"), F.col("top.n").alias("m"))
    return stored(rows.join(centre, "bucket"), name)


def _region_pairs(rows: DataFrame) -> DataFrame:
    """a < b: all pairs of small regions; in dense ones every class with the centre."""
    leaf = rows.where(F.col("c") <= LEAF).select("bucket", "id", "n")
    other = leaf.select("bucket", F.col("id").alias("b"), F.col("n").alias("k"))
    small = leaf.join(other, "bucket").where((F.col("id") < F.col("b")) & _similar_size("n", "k")).select(F.col("id").alias("a"), "b")
    dense = rows.where((F.col("c") > LEAF) & (F.col("id") != F.col("centre")) & _similar_size("n", "m"))
    return small.union(dense.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))).distinct()


def forest_top(classes: DataFrame) -> DataFrame:
    """Rows of the first depth: tree, bucket, id, n, meets, c, centre, m; meets counts a class's neighbours over all trees."""
    rows = _regions(_buckets(classes.select("id", "n", "sig"), 0))
    # A class has at most one row a tree.
    each = rows.groupBy("id", "n").agg(F.sum("c").alias("meets"), F.collect_list(F.struct("tree", "bucket", "c")).alias("r"))
    each = each.select("id", "n", "meets", F.explode("r").alias("r")).select("r.tree", "r.bucket", "id", "n", "meets", "r.c")
    return _centred(stored(each, "forest-rows"), "forest-regions")


def forest_below(classes: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """a < b: pairs of the further depths.

    In a dense region only the classes that do not share the centre's component (`named`: id, component) go deeper.
    """
    a, b = named.select("id", F.col("component").alias("_a")), named.select(F.col("id").alias("centre"), F.col("component").alias("_b"))
    apart = rows.join(a, "id", "left").join(b, "centre", "left").where(F.coalesce("_a", "id") != F.coalesce("_b", "centre"))
    columns = ["tree", "bucket", "id", "n", "meets"]
    above = stored(apart.where(F.col("c") > LEAF).select(*columns), "forest-deeper")
    found = []
    for level in range(1, len(DEPTHS)):
        if above.isEmpty():
            break
        rows = _centred(_regions(_buckets(above.join(classes.select("id", "sig"), "id"), level)), "forest-regions")
        found.append(stored(_region_pairs(rows), "forest-pairs"))
        above = rows.where(F.col("c") > LEAF).select(*columns)
    pairs = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    for more in found:
        pairs = pairs.union(more)
    return pairs.distinct()


def unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """COUNTERS sums of shingles over the sets, the shingles sharing them by hash."""
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for packed in batch.column("shingles"):
                np.add.at(total, _counter(unpacked(packed.as_py())), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["counter", "n"])

    rows = sets.select("shingles").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return counts


def posts(sets: DataFrame, counts) -> DataFrame:
    """shingle, id, n, place, first: the leading rare shingles of every set; first: also within the prefix of a smaller set."""
    def out(parts):
        size, length, ids, lead = (np.concatenate([p[k] for p in parts]) for k in range(4))
        place = np.arange(len(lead)) - np.repeat(np.cumsum(length) - length, length)
        n = np.repeat(size, length)
        return pa.RecordBatch.from_arrays([
            pa.array(lead.view(np.int64)), pa.array(np.repeat(ids, length)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)),
            pa.array(place <= n - (6 * n + 6) // 7)], ["shingle", "id", "n", "place", "first"])

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            for i, packed in zip(batch.column("id").to_numpy(), batch.column("shingles")):
                s = unpacked(packed.as_py())
                n = len(s)
                length = n - (PERCENT * n + 99) // 100 + 1
                lead = s[np.lexsort((s, counts.value[_counter(s)]))[:length]]
                parts.append(([n], [length], [i], lead))
                rows += length
                if rows > POST_ROWS:
                    yield out(parts)
                    parts, rows = [], 0
        if parts:
            yield out(parts)

    return sets.mapInArrow(run, "shingle long, id long, n int, place int, first boolean")


def crowd_pairs(sets: DataFrame, named: DataFrame) -> DataFrame:
    """a < b: all pairs of `sets` (id, shingles) that can reach the threshold and do not share a component of `named`."""
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))
    rows = stored(posts(sets, counts).join(named, "id", "left").withColumn("component", F.coalesce("component", "id")), "near-posts")
    counts.destroy()
    shared = rows.groupBy("shingle").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.max("first").alias("f")).where("f and l < h")
    rows = stored(rows.join(shared.select("shingle"), "shingle", "left_semi"), "near-posts")
    main = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(
        F.max(F.struct("c", "component")).alias("m")).select("shingle", F.col("m.component").alias("main"))
    rest = rows.join(main, "shingle").where("component <> main")
    meet = F.expr("""a.shingle = b.shingle and a.component <> b.component and (b.component = a.main or a.id < b.id)
        and (a.first and a.n <= b.n or b.first and b.n <= a.n)
        and 7L * least(a.n - a.place, b.n - b.place) >= 3L * (a.n + b.n)""")
    return rest.alias("a").join(rows.alias("b"), meet & _similar_size("a.n", "b.n")).select(
        F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures do not rule out the threshold: a, b (the class with more shingles), alike."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), VALUES) for c in ("sig_a", "sig_b"))
            alike = (x == y).sum(1)
            swap = batch.column("n_a").to_numpy() > batch.column("n_b").to_numpy()
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ok = alike >= VALUES * (PERCENT / 100 - SLACK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(swap, b, a)[ok]), pa.array(np.where(swap, a, b)[ok]), pa.array(alike[ok].astype(np.int32))], ["a", "b", "alike"])

    left, right = (classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, alike int")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles (8 bytes each, sorted) of the named classes, made anew from their texts."""
    def run(batches):
        for batch in batches:
            packed = [s.tobytes() for _, s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").alias("id"), "text")
    named = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts.join(named, "id", "left_semi").mapInArrow(run, "id long, shingles binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = unpacked(x.as_py()), unpacked(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    # The smaller set travels with the pair.
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _more_links(pairs: DataFrame, done: DataFrame, links: DataFrame, named: DataFrame, sets: DataFrame):
    """Confirm the pairs (a, b) that are neither `done` nor inside a component of `named`: links, named and done anew."""
    a, b = (named.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    rest = stored(pairs.join(a, "a", "left").join(b, "b", "left").where(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "near-pairs")
    more = stored(confirmed(rest, sets), "near-links")
    if not more.isEmpty():
        links = links.union(more)
        named = stored(components(links), "near-components")
    return links, named, done.union(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_a, row_b, n_shingles, component_id, kept of every row of `docs`."""
    docs = fresh(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumns(_row_names())
    sketch = stored(sketches(docs), "near-sketches")
    classes = stored(sketch.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n_shingles", "sig"))).alias("s")
    ).where("s is not null").select("set_key", F.col("s.doc_id").alias("id"), F.col("s.n_shingles").cast("int").alias("n"), "s.sig"), "near-classes")
    regions = forest_top(classes)
    pairs = stored(likely(_region_pairs(regions), classes), "near-pairs")
    crowded = stored(regions.where(F.col("c") > LEAF).select("id").distinct(), "near-crowded")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowded).distinct(), "near-ids")
    sets = stored(full_sets(docs, ids), "near-sets")
    best = pairs.select("a", "b", "alike").union(pairs.select("b", "a", "alike")).groupBy("a").agg(
        F.max(F.struct("alike", -F.col("b"), "b")).alias("top")).select("a", "top.b")
    first = pairs.join(best.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(),
                       (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_semi")
    links = stored(confirmed(first, sets), "near-links")
    named = stored(components(links), "near-components")
    links, named, done = _more_links(pairs, first.select("a", "b"), links, named, sets)
    if not crowded.isEmpty():  # what goes deeper meets on longer prefixes; all of it is crowded, so its sets are at hand
        deeper = stored(likely(forest_below(classes, regions, named), classes), "near-pairs")
        links, named, done = _more_links(deeper, done, links, named, sets)
    if not crowded.isEmpty():
        left = likely(crowd_pairs(sets.join(crowded, "id", "left_semi"), named), classes).select("a", "b")
        links, named, done = _more_links(left, done, links, named, sets)
    known = classes.select("set_key", "id").join(named, "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("component"))
    return sketch.drop("sig").join(known, "set_key", "left").select(
        "doc_id", "row_a", "row_b", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, repeated rows once."""
    kept = near_duplicates(docs).where("kept").select(F.col("row_a").alias("_a"), F.col("row_b").alias("_b"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    once = ids.select(F.struct(*columns).alias("_row"), *[f.alias(n) for n, f in zip(("_a", "_b"), _row_names().values())])
    # Repeats meet before the shuffle, so a row repeated without end is no burden.
    once = once.groupBy("_a", "_b").agg(F.first("_row").alias("_row")).join(kept, ["_a", "_b"], "left_semi")
    return once.select(*[F.col("_row")[c].cast(t).alias(c) for c, t in docs.dtypes])


@query("op5_near_dedup")
def near_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).drop("row_a", "row_b")
