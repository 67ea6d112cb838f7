"""Exact set-similarity join of text lines: of similar lines the later ones are removed.

A line's set is its distinct lower-cased words. Lines with equal sets are one class, placed at its
first (doc_id, line_no). Words are ordered by rarity, rare first: counts come from a fixed number
of counters that words share by hash, ties go by hash, so the order is total and its table bounded.
Two sets with Jaccard similarity of at least 4/5 share a word among the first n - ceil(4n/5) + 1 of
each; classes meet on those words and pass a length filter, a positional filter and a bound from 64-bit maps of the parity of
their words (each bit in which two maps differ is a word that only one set has). What is left is verified on the full sets.

A line is removed when an earlier line is similar (or equal). One match decides, so of a crowd (a word with more than CROWD
pairs a class that pass the filters) and of a word that more than SMALL
classes share each first meets the earliest; only those still undecided meet the rest. The counts bound the
rows of a word before any row is dealt; words beyond a share of all are salted and meet in joins.

Null texts and lines without words take no part and give no row. Repeated rows (one doc_id, line_no and
text) are the same line: each row is kept or removed as that line is. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import fresh, stored, table
from tidepoint.llm.words import LOWER_KEYS, SPACED, mix, text_slices, words_of

COUNTER_BITS = 18
COUNTERS, BLOCK = 1 << COUNTER_BITS, 1 << 12  # 2 MB
SMALL = 4096
CROWD = 16  # similar pairs a member
LOOK = 1 << 20  # pairs looked at together
LONG = 64
HOT_LEAST, HOT_SHARE = 100_000, 2000
REMEMBERED = 500_000
BROADCAST_LINES = 500_000


def line_words(texts: pa.Array):
    """(row, line_no, word hashes) arrays of a batch: for each slice, and each word, in order."""
    for first, data, off in text_slices(texts):
        breaks = np.flatnonzero(data == 10) + 1
        heads = np.union1d(off[:-1][np.diff(off) > 0], breaks[breaks < len(data)])
        if not len(heads):
            continue
        edges = np.append(heads, len(data))
        lines, _, _, hashes = words_of(data, edges, SPACED, LOWER_KEYS)
        row = np.searchsorted(off, heads, "right") - 1
        before = np.searchsorted(breaks, heads, "right") - np.searchsorted(breaks, off[row], "right")
        yield first + row[lines], before[lines], hashes


def ranks(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(COUNTERS, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(COUNTERS)
    return rank


def ordered(unit: np.ndarray, hashes: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """The order by unit, counter (rare first; without ranks: none) and hash: one sort of packed keys, unless these leave two words of a line tied."""
    bits = int(unit[-1]).bit_length()
    counter, free = None, 64 - bits
    packed = unit.astype(np.uint64) << np.uint64(free % 64)
    if rank is not None:
        counter, free = rank[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)], free - COUNTER_BITS
        packed |= counter.astype(np.uint64) << np.uint64(free)
    packed |= hashes >> np.uint64(64 - free)
    order = np.argsort(packed)
    packed, word = packed[order], hashes[order]
    if np.any((packed[1:] == packed[:-1]) & (word[1:] != word[:-1])):
        return np.lexsort((hashes, unit) if rank is None else (hashes, counter, unit))
    return order


def line_sets(batch: pa.RecordBatch, rank: np.ndarray | None):
    """For each slice: row, line_no, set size, key, and the lines' words (hash, start of each line), rare first."""
    for row, line, hashes in line_words(batch.column("text")):
        if not len(hashes):
            continue
        unit = np.cumsum(np.append(False, (row[1:] != row[:-1]) | (line[1:] != line[:-1])))
        order = ordered(unit, hashes, rank)
        unit, word = unit[order], hashes[order]
        new = np.ones(len(word), bool)
        new[1:] = (unit[1:] != unit[:-1]) | (word[1:] != word[:-1])
        unit, word, row, line = unit[new], word[new], row[order][new], line[order][new]
        head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        size = np.diff(np.append(head, len(unit)))
        key = mix(np.add.reduceat(mix(word), head) + size.astype(np.uint64))
        yield row[head], line[head], size, key, word, head


LINES = pa.schema([
    ("doc_id", pa.int64()), ("line_no", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("block", pa.int32()), ("sums", pa.binary())])


def lines(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, line_no, n, key of every line with words, and COUNTERS sums of the words of all sets, the words sharing them by hash.

    Both come from one pass: after its lines a task gives its sums, BLOCK of them in a row.
    """
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for row, line, size, key, word, _ in line_sets(batch, None):
                total += np.bincount((word & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(row)), pa.array(line, pa.int64()), pa.array(size.astype(np.int32)),
                    pa.array(key.view(np.int64)), pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.binary())], schema=LINES)
        parts = total.reshape(-1, BLOCK)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([
            *(pa.nulls(len(used), LINES.field(i).type) for i in range(4)), pa.array(used.astype(np.int32)),
            pa.array([parts[i].tobytes() for i in used], pa.binary())], schema=LINES)

    def add(batches):
        total = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums")):
                total[block] = total.get(block, 0) + np.frombuffer(sums.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "sums"])

    made = stored(docs.mapInArrow(run, "doc_id long, line_no long, n int, key long, block int, sums binary"), "lines")
    # One row for each block, 2 MB together.
    rows = made.where("block is not null").select("block", "sums").repartition("block").mapInArrow(add, "block int, sums binary").toArrow()
    counts = np.zeros((COUNTERS // BLOCK, BLOCK), np.int64)
    for block, sums in zip(rows.column("block").to_pylist(), rows.column("sums")):
        counts[block] = np.frombuffer(sums.as_py(), np.int64)
    return made.where("block is null").select("doc_id", "line_no", "n", "key"), counts.reshape(-1)


def prefixes(docs: DataFrame, counts) -> DataFrame:
    """word (32 bits of its hash), salt, key, n, place, bits, more: the leading rare words of every line.

    bits maps the parity of all words of the line; more, for sets of over LONG, of about half of them, so that both make a map of 128 bits.

    Equal lines of a task give rows once, as far as its memory of them goes. The rows of a word that makes up more than
    one in HOT_SHARE of all words (and HOT_LEAST) are dealt out by salt; the others are bounded by their count.
    """
    def run(batches):
        seen: set[int] = set()
        hot = counts.value[0] > max(HOT_LEAST, int(counts.value[0].sum()) // HOT_SHARE)
        for batch in batches:
            for _, _, size, key, word, head in line_sets(batch, counts.value[1]):
                new = np.array([k not in seen for k in key.tolist()])
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(key.tolist())
                if not new.any():
                    continue
                bits = np.bitwise_xor.reduceat(np.uint64(1) << (word >> np.uint64(58)), head)
                half = np.where(word >> np.uint64(51) & np.uint64(64), np.uint64(1) << (word >> np.uint64(58)), np.uint64(0))
                more = np.bitwise_xor.reduceat(half, head)
                size, key, bits, more, head = size[new], key[new], bits[new], more[new], head[new]
                length = size - (4 * size + 4) // 5 + 1
                place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                lead = word[np.repeat(head, length) + place]
                salt = np.where(hot[(lead & np.uint64(COUNTERS - 1)).astype(np.int64)], np.repeat(key.astype(np.int32) | 1, length), 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(lead.astype(np.uint32).view(np.int32)), pa.array(salt.astype(np.int32)),
                    *(pa.array(np.repeat(x, length)) for x in (key.view(np.int64), size.astype(np.int32))),
                    pa.array(place.astype(np.int32)), pa.array(np.repeat(bits.view(np.int64), length)),
                    pa.array(np.repeat(more.view(np.int64), length), mask=np.repeat(size <= LONG, length)),
                ], schema=POSTS)

    return docs.mapInArrow(run, "word int, salt int, key long, n int, place int, bits long, more long")


POSTS = pa.schema([
    ("word", pa.int32()), ("salt", pa.int32()), ("key", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("bits", pa.int64()),
    ("more", pa.int64())])
FOUND = pa.schema([*POSTS, ("other", pa.int64())])


def similar(w: np.ndarray, m: np.ndarray, at: np.ndarray, map_: np.ndarray, half: np.ndarray, words: int):
    """x, y (rows of one word w that pass the filters) and, for each word, whether it is a crowd.

    Rows come sorted by word and set size m, so a row looks at those after it up to 5/4 of its size. A word with more
    than CROWD such pairs a member is a crowd: its pairs are not given and its look ends.
    """
    place = np.arange(len(w))
    many = np.searchsorted(w << 32 | m, w << 32 | (5 * m // 4), "right") - place - 1
    past = np.cumsum(many)
    most, got = CROWD * np.bincount(w, minlength=words), np.zeros(words, np.int64)
    xs, ys, i = [place[:0]], [place[:0]], 0
    while i < len(w):
        j = max(i + 1, int(np.searchsorted(past, past[i] - many[i] + LOOK, "right")))
        c = np.where(got[w[i:j]] > most[w[i:j]], 0, many[i:j])
        x = np.repeat(place[i:j], c)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
        ok = 9 * np.bitwise_count(map_[x] ^ map_[y]).astype(np.int64) <= m[x] + m[y]
        x, y = x[ok], y[ok]
        long = m[x] > LONG  # then m[y] as well
        a, b = x[long], y[long]
        ok = np.ones(len(x), bool)
        ok[long] = 9 * (np.bitwise_count(map_[a] ^ half[a] ^ map_[b] ^ half[b]).astype(np.int64) + np.bitwise_count(half[a] ^ half[b])) <= m[a] + m[b]
        x, y = x[ok], y[ok]
        ok = 9 * np.minimum(m[x] - at[x], m[y] - at[y]) >= 4 * (m[x] + m[y])
        x, y = x[ok], y[ok]
        got += np.bincount(w[x], minlength=words)
        xs.append(x)
        ys.append(y)
        i = j
    x, y, crowd = np.concatenate(xs), np.concatenate(ys), got > most
    ok = ~crowd[w[x]]
    return x[ok], y[ok], crowd


def meeting(posts: DataFrame, small: int) -> DataFrame:
    """What meets on a word: rows with `other`, a pair of keys that passes the filters, and rows without it,
    the members of crowds, of words that more than `small` sets share and of salted ones, for the joins.

    Rows come grouped by word and sorted by set size, so a task looks at one word at a time.
    """
    def run(batches):
        held, big = None, None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            yield from look(rows, big)
            word, salt = rows.column("word"), rows.column("salt")
            # The last word may go on: up to small + 1 of its rows wait; a longer one is known to be big.
            same = (word.to_numpy() == word[-1].as_py()) & (salt.to_numpy() == salt[-1].as_py())
            start = int(np.argmax(same))
            big = word[-1].as_py() if len(rows) - start > small or word[-1].as_py() == big else None
            held = rows.slice(len(rows) - 1) if big is not None else rows.slice(start)
        if held is not None:
            yield from look(pa.Table.from_batches([held, held.slice(0, 0)]).combine_chunks().to_batches()[0], big, True)

    def look(rows, big, end=False):
        """Pairs and members among rows; the last word is left for later unless this is the end."""
        word, salt, key, n, place, bits = (rows.column(c).to_numpy() for c in POSTS.names[:-1])
        step = np.append(True, (word[1:] != word[:-1]) | (salt[1:] != salt[:-1]))
        twin = np.append(False, ~step[1:] & (key[1:] == key[:-1]))
        run_of = np.cumsum(step) - 1
        size = np.bincount(run_of)
        # What a big word held over is given out already.
        fresh_row = ~twin
        if big is not None and word[0] == big:
            fresh_row[0] = False
            size[0] = small + 1
        later = (run_of == run_of[-1]) & (not end)
        known_big = (size[run_of] > small) | (salt != 0)
        use = np.flatnonzero(~known_big & ~later & ~twin)
        w, k, m, at, map_ = run_of[use], key[use], n[use].astype(np.int64), place[use], bits[use].view(np.uint64)
        half = rows.column("more").fill_null(0).to_numpy()[use].view(np.uint64)
        x, y, crowd = similar(w, m, at, map_, half, len(size))
        member = known_big & fresh_row
        member[use[crowd[w]]] = True
        yield pa.RecordBatch.from_arrays(
            [rows.column(c) for c in POSTS.names] + [pa.nulls(len(rows), pa.int64())], schema=FOUND).filter(pa.array(member))
        if len(x):
            none = pa.array(np.zeros(len(x), np.int32))
            yield pa.RecordBatch.from_arrays([none, none, pa.array(k[x]), none, none, pa.array(np.zeros(len(x), np.int64)),
                pa.nulls(len(x), pa.int64()), pa.array(k[y])], schema=FOUND)

    partitions = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return posts.repartition(partitions, "word", "salt").sortWithinPartitions("word", "salt", "n", "key").mapInArrow(
        run, "word int, salt int, key long, n int, place int, bits long, more long, other long")


def _passes():
    """The filters of a pair x, y: lengths, positions of the shared word, and the word maps."""
    need = F.expr("4 * (x.n + y.n)")
    return (
        F.expr("5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)")
        & (9 * F.expr("least(x.n - x.place, y.n - y.place)") >= need)
        & (F.expr("9 * (x.n + y.n - bit_count(x.bits ^ y.bits))") >= 2 * need)
    )


def line_word_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, counts) -> DataFrame:
    """key, words (8 bytes each, sorted) of the named classes, made anew from the lines they begin with."""
    def run(batches):
        for batch in batches:
            wanted = [set(x) for x in batch.column("wanted").to_pylist()]
            out = {"key": [], "words": []}
            for row, line, size, key, word, head in line_sets(batch, counts.value[1]):
                for i in range(len(row)):
                    if int(line[i]) in wanted[row[i]]:
                        out["key"].append(int(key.view(np.int64)[i]))
                        out["words"].append(np.sort(word[head[i] : head[i] + size[i]]).tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.int64()), ("words", pa.binary())]))

    # As many line numbers as one text has lines, at most.
    wanted = stored(classes.join(keys, "key", "left_semi").groupBy("doc_id").agg(F.collect_list("line_no").alias("wanted")), "line-wanted")
    small = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    wanted = wanted.withColumnRenamed("doc_id", "_d")
    rows = docs.join(F.broadcast(wanted) if small <= BROADCAST_LINES else wanted, F.col("doc_id").eqNullSafe(F.col("_d"))).select("text", "wanted")
    return rows.mapInArrow(run, "key long, words binary").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets reach the threshold."""
    def run(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("words_x"), batch.column("words_y")):
                a, b = (np.frombuffer(w.as_py(), np.uint64) for w in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(5 * both >= 4 * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    x, y = (sets.select(F.col("key").alias(c), F.col("words").alias(f"words_{c}")) for c in "xy")
    return pairs.join(x, "x").join(y, "y").mapInArrow(run, "x long, y long")


def similar_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, n_tokens, class_doc, class_line, removed of every line with words."""
    docs = fresh(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    every, sums = lines(docs)
    counts = docs.sparkSession.sparkContext.broadcast((sums, ranks(sums)))
    first = F.min(F.struct("doc_id", "line_no"))
    classes = stored(every.groupBy("key").agg(first.alias("f")).select("key", "f.doc_id", "f.line_no"), "line-classes", True)
    place = classes.select("key", F.struct("doc_id", "line_no").alias("at"))
    found = stored(meeting(prefixes(docs, counts), SMALL), "line-meetings", True)
    many = stored(found.where("other is null").drop("other", "salt", "more").join(place, "key"), "line-members", True)
    earliest = many.groupBy("word").agg(F.min(F.struct("at", "key", "n", "place", "bits")).alias("m")).select("word", "m.*")
    meet = (F.expr("x.word = y.word and x.at > y.at")) & _passes()
    met = found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")).distinct()
    met = met.join(place.select(F.col("key").alias("a"), F.col("at").alias("at_a")), "a").join(
        place.select(F.col("key").alias("b"), F.col("at").alias("at_b")), "b")
    later = F.col("at_a") > F.col("at_b")
    pairs = met.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("y")).union(
        many.alias("x").join(earliest.alias("y"), meet).select("x.key", "y.key"))
    pairs = stored(pairs.distinct(), "line-pairs", True)

    def matched(found: DataFrame) -> DataFrame:
        keys = found.select(F.explode(F.array("x", "y")).alias("key")).distinct()
        return stored(verified(found, stored(line_word_sets(docs, classes, keys, counts), "line-sets", True)), "line-matches", True)

    matches = matched(pairs)
    open_ = many.join(matches.select(F.col("x").alias("key")).distinct(), "key", "left_anti")
    rest = open_.alias("x").join(many.alias("y"), meet).select(F.col("x.key").alias("x"), F.col("y.key").alias("y")).distinct()
    rest = stored(rest.join(pairs, ["x", "y"], "left_anti"), "line-pairs", True)
    if not rest.isEmpty():
        matches = matches.union(matched(rest))
    later = matches.select(F.col("x").alias("key")).distinct().withColumn("_match", F.lit(True))
    known = classes.select("key", F.col("doc_id").alias("class_doc"), F.col("line_no").alias("class_line")).join(later, "key", "left")
    return every.join(known, "key").select(
        "doc_id", "line_no", F.col("n").alias("n_tokens"), "class_doc", "class_line",
        (F.coalesce("_match", F.lit(False)) | ~(F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("class_line")))).alias("removed"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """`docs` without the removed lines, n_chars brought up to date."""
    gone = similar_lines(docs).where("removed").groupBy(F.col("doc_id").cast("long").alias("_d")).agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_d"]), "left")
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.coalesce(F.array_contains(gone["_gone"], i.cast("long")), F.lit(False)))
    text = F.when(gone["_gone"].isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    new = {"text": text, "n_chars": F.when(gone["_gone"].isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


@query("op3_line_dedup")
def line_dedup(spark, sf):
    return similar_lines(table(spark, sf, "documents"))
