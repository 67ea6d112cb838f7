"""Near-duplicate documents (5), similar lines (3) and repeated passages (6) against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, DOCS, docs, groups, lower, shingles, words

from tidepoint.llm import graph, line_dedup, near_dedup, passages

VOCABULARY = [f"w{i}" for i in range(400)]


def texts(seed=5, crowd=60):
    """Unrelated texts, small groups with edits, and a crowd of copies of one text with random edits."""
    rng = random.Random(seed)

    def text(n):
        return [rng.choice(VOCABULARY) for _ in range(n)]

    def edited(base, edits):
        out = list(base)
        for _ in range(edits):
            out[rng.randrange(len(out))] = rng.choice(VOCABULARY)
        return out

    rows = [text(rng.randrange(3, 80)) for _ in range(60)]
    for _ in range(25):
        base = text(rng.randrange(30, 150))
        rows += [edited(base, rng.randrange(0, 5)) for _ in range(rng.randrange(2, 6))]
    base = text(120)
    rows += [edited(base, rng.randrange(0, 6)) for _ in range(crowd)]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, groups(ids, links)


@pytest.mark.parametrize("leaf", [10, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)  # 3: most regions are dense
    rows = texts()
    sets, expected = brute(rows)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.kept == (i == expected[i]) for i, r in got.items())


def test_near_duplicates_of_awkward_rows(spark):
    rows = sorted(near_dedup.near_duplicates(docs(spark, AWKWARD)).collect(), key=str)
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 5, 7, 8)] == [0, 0, 0, 1, 1, 1, 1]
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert by[1].component_id == 1 and by[1].kept
    assert by[None].component_id == 5 and not by[None].kept


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def template_rows():
    """Pages of one template that are some 0.7 alike, among them pairs at 0.76; no page is near two others."""
    rng = random.Random(21)
    base = [f"t{k}" for k in range(400)]

    def page(own):
        return own + base

    rows = [page([f"p{i}x{k}" for k in range(rng.randrange(86, 89))]) for i in range(300)]
    for i in range(0, 160, 4):  # three tenths of the own words in common
        rows[i + 1] = rows[i][:26] + rows[i + 1][26:]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, " ".join(rows[k])) for i, k in enumerate(order)]


def test_pairs_inside_a_template_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 3)
    rows = template_rows()
    _, expected = brute(rows)
    assert sum(c != i for i, c in expected.items()) == 40
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == expected


def test_signatures_of_long_texts_tell_them_apart(spark):
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 1 << 20, 500_000) for _ in range(12)]
    rows[8] = rows[4].copy()
    rows[8][rng.integers(0, 500_000, 2000)] = 0
    a, b = (near_dedup.signature(next(near_dedup.shingle_sets(pa.array([" ".join(map(str, rows[i]))])))[1]) for i in (4, 5))
    assert (a == b).sum() <= 1
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, [(i, " ".join(map(str, r))) for i, r in enumerate(rows)])).collect()}
    assert got == {i: 4 if i == 8 else i for i in range(12)}


def test_components_of_chain_star_and_ring(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == groups({x for e in links for x in e}, links)


def plain_lines(rows):
    seen, out = [], {}
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(lower(line)))
            if s:
                out[i, k] = any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
                seen.append(s)
    return out


@pytest.mark.parametrize("small", [32, 2])
def test_similar_lines_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)  # 2: most words are shared by many
    rng, rows = random.Random(3), texts(9, 20)
    lines = [t for _, t in rows]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.8 else "" for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    got = {(r.doc_id, r.line_no): r.removed for r in line_dedup.similar_lines(docs(spark, rows)).collect()}
    assert got == plain_lines(rows)


def test_similar_lines_of_awkward_rows(spark):
    got = line_dedup.similar_lines(docs(spark, AWKWARD)).collect()
    # The row without doc_id comes first in the order, so its equals are the later ones.
    assert {(r.doc_id, r.line_no, r.removed) for r in got} == {
        (None, 0, False), (5, 0, True), (6, 0, True), (4, 0, False), (7, 0, False), (8, 0, False), (9, 0, False)}
    assert line_dedup.similar_lines(spark.createDataFrame([], DOCS)).collect() == []
    cleaned = {r.doc_id: r.text for r in line_dedup.clean(docs(spark, [(1, "a b c d e\nx y"), (2, "q\na b c d e")])).collect()}
    assert cleaned == {1: "a b c d e\nx y", 2: "q"}


def test_repeated_passages_are_found_anywhere(spark):
    rng = random.Random(8)

    def text(n):
        return [f"v{rng.randrange(5000)}" for _ in range(n)]

    rows, holders = [], set()
    for _ in range(30):
        passage = text(rng.randrange(51, 90))
        for _ in range(rng.choice([2, 3, 12])):
            body = text(rng.randrange(20, 300))
            at = rng.randrange(len(body))
            holders.add(len(rows))
            rows.append(body[:at] + passage + body[at:])
    rows += [text(rng.randrange(5, 400)) for _ in range(60)]
    got = passages.repeated(docs(spark, [(i, " ".join(r)) for i, r in enumerate(rows)])).collect()
    found = {r.doc_id for r in got}
    assert found <= holders and len(found) >= 0.97 * len(holders)
    assert all(0 <= r.removed_words <= r.n_words for r in got)
    assert sum(r.removed_words == 0 for r in got) >= 25 and sum(r.removed_words == r.n_words for r in got) >= len(found) / 2


def test_near_copies_of_passages_are_found(spark):
    rows = texts(4, 10)
    got = {r.doc_id for r in passages.repeated(docs(spark, rows)).collect()}
    _, expected = brute(rows)
    many = [i for i, t in rows if len(t.split()) > 80 and sum(c == expected[i] for c in expected.values()) > 1]
    assert sum(i in got for i in many) >= 0.9 * len(many)


def test_similar_paragraphs_of_hot_bands_are_found(spark, monkeypatch):
    """Pairs of texts with an edit beside one frequent phrase: hot bands lose none of what comparing all their pairs finds."""
    rng, rows = random.Random(12), []
    for i in range(400):
        body = [f"q{i}x{k}" for k in range(7)] + "one very common phrase here".split() + [f"r{i}x{k}" for k in range(7)]
        edited = list(body)
        edited[rng.choice([3, 4, 5, 13, 14, 15])] = f"z{i}"
        rows += [" ".join(body), " ".join(edited)]
    rng.shuffle(rows)
    rows = docs(spark, list(enumerate(rows))).cache()
    got = sum(r.removed_words for r in passages.repeated(rows, 5).collect())
    monkeypatch.setattr(passages, "LEAF", 10**6)
    assert got >= sum(r.removed_words for r in passages.repeated(rows, 5).collect()) > 0


def test_passages_of_awkward_rows(spark):
    assert passages.repeated(docs(spark, AWKWARD)).collect() == []
    assert passages.repeated(spark.createDataFrame([], DOCS)).collect() == []


class Task:
    """Stands in for a sorted table: hands out the function that runs on one task's batches."""

    schema = None

    def __init__(self):
        self.sparkSession = self.conf = self

    def get(self, _):
        return "8"

    def repartitionByRange(self, *_):  # noqa: N802
        return self

    sortWithinPartitions = repartition = repartitionByRange

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def batches(names, rows, step):
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        yield pa.RecordBatch.from_pydict({n: [r[k] for r in part] for k, n in enumerate(names)})


def test_rows_alone_are_dropped_whatever_the_batches():
    rng, colliding = random.Random(1), passages.colliding(Task())
    for _ in range(1000):
        step = rng.randrange(1, 6)
        bands = [(b, i) for i, b in enumerate(sorted(rng.randrange(6) for _ in range(rng.randrange(1, 14))))]
        got = [tuple(r.values()) for b in colliding(batches(("band", "start"), bands, step)) for r in b.to_pylist()]
        must = {r for r in bands if sum(r[0] == b for b, _ in bands) > 1}
        assert len(got) == len(set(got)) and must <= set(got) <= must | {bands[0], bands[-1]}


def test_lines_meet_whatever_the_batches():
    rng = random.Random(2)
    for _ in range(1000):
        step, small = rng.randrange(1, 6), rng.randrange(2, 4)
        rows = sorted((rng.randrange(4), rng.choice([0, 0, 0, 5]), rng.randrange(6)) for _ in range(rng.randrange(1, 16)))
        parts = [pa.RecordBatch.from_pylist([{"word": w, "salt": s, "key": k, "n": 1, "place": 0, "bits": 0} for w, s, k in rows[i : i + step]],
                                            schema=line_dedup.POSTS) for i in range(0, len(rows), step)]
        got = [r for b in line_dedup.meeting(Task(), small)(iter(parts)) for r in b.to_pylist()]
        sets = {}
        for w, s, k in rows:
            sets.setdefault((w, s), set()).add(k)
        pairs, members = {(r["key"], r["other"]) for r in got if r["other"] is not None}, {(r["word"], r["salt"], r["key"]) for r in got if r["other"] is None}
        for (w, s), keys in sets.items():
            inside = {k for k in keys if (w, s, k) in members}
            # Either all of a word are members, or all its pairs are given.
            assert inside == keys or (not s and len(keys) <= small and {(a, b) for a in keys for b in keys if a < b} <= pairs)
