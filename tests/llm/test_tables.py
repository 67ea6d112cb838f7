"""Operators over whole tables: mixing (2), sharding (7), WARC (8), token counts (9), the pipeline, and the entry points."""

import hashlib
import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from helpers import AWKWARD, DOCS, docs, groups, lower, shingles, words
from pyspark.sql import functions as F

from tidepoint.llm import mixing, near_dedup, ring, token_rollup, warc
from tidepoint.llm.common import new_folder, stored

ROOT = Path(__file__).resolve().parents[2]


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {**{s: cap * sizes[s] for s in full}, **share}
        full |= over


SOURCES = ["b", "a", None, "Z", "é", "c", ""]


def mix_rows():
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), SOURCES[i % 5]) for i in range(600)]
    rows += [(1000 + i, "a b c", "tiny") for i in range(3)] + [(2000, None, "c"), (2001, "", ""), (2002, " ", "")]
    rows += [(3000, "same row here", "a")] * 5 + [(None, "no id", "b"), (4000, "w " * 2000, "b")]
    return rows


def test_mix_meets_targets(spark):
    rows = mix_rows()
    got = mixing.mix(docs(spark, rows).withColumn("size", F.lit("mine")).drop("size")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    goal = plain_targets(dict(sizes))
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and r["size"] == len(words(r.text))
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(100, 0.02 * goal[s])
    again = mixing.mix(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.text, r.copies) for r in got) == Counter((r.doc_id, r.text, r.copies) for r in again)


def test_multipliers_solve_the_dual(spark):
    """Rates are min(cap, exp(lambda x)) and meet the target, found here by bisection."""
    from math import exp

    sizes = spark.createDataFrame([("a", n, 3) for n in range(1, 60)] + [("b", n, 1) for n in range(1, 9)] + [("c", n, 2) for n in range(1, 60)], "source string, size long, n long")
    goals = stored(mixing.targets(sizes), "goals")
    got = {r.source: r for r in goals.join(mixing.solve(sizes, goals), "_s").collect()}
    for s, n in (("a", range(1, 60)), ("b", range(1, 9)), ("c", range(1, 60))):
        mean, target = got[s].source_size / got[s].docs, got[s].target
        if got[s].multiplier is None:
            assert target == pytest.approx(3 * got[s].source_size)
            continue
        low, high = -100.0, 100.0
        for _ in range(200):
            mid = (low + high) / 2
            total = sum(x * min(3, exp(min(50, mid * x / mean))) for x in n) * {"a": 3, "b": 1, "c": 2}[s]
            low, high = (mid, high) if total < target else (low, mid)
        assert got[s].multiplier == pytest.approx(low, abs=1e-4)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [r.copies for r in mixing.mix(docs(spark, [(1, None, None), (2, "", "x")])).collect()] == [0, 0]


def test_shards_are_even_and_gapless(spark):
    rows = AWKWARD + [(i, f"t{i % 7}", "s") for i in range(100, 500)] + [(77, "hot", "s")] * 300
    got = ring.assign(ring.sized(docs(spark, rows))).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 8
    assert len(by) == 24 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert ring.assign(docs(spark, [])).collect() == []


def test_ring_moves_little_with_slack(spark):
    rows = docs(spark, [(i, "t", "s") for i in range(3000)])
    a = {r.doc_id: r.shard for r in ring.assign(rows, 10, slack=0.25).collect()}
    b = {r.doc_id: r.shard for r in ring.assign(rows, 11, slack=0.25).collect()}
    assert max(Counter(a.values()).values()) <= 375 and max(Counter(b.values()).values()) <= 341
    assert sum(a[i] != b[i] for i in a) < 0.25 * len(a)


def test_walk_goes_clockwise_to_the_next_room():
    points = [(0, 0), (10, 1), (20, 2)]
    assert ring.walk(points, [5, 0, 0], [2, 2, 2]) == [(2, 0, 0), (2, 1, 0), (1, 2, 0)]


PAGES = [
    (1, "http://a/ x\r\ny", "<p>one</p>"), (2, None, None), (3, "u", "p" * 1000), (4, "u", "p" * 1000), (9, "v", "p" * 1000),
    (5, "u", "p" * 999), (6, "u", "p" * 999), (None, "w", "p" * 1000), (7, "é", "é\x00" * 90_000), (8, "", ""), (9, "v", "p" * 1000),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    folder = new_folder(spark, "warc-test")
    index = warc.write(pages, folder, file_bytes=2000)
    got = warc.read(spark, index, folder, gap=0, span=500).collect()
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        owner = 9 if len(b) == 1000 else None
        kind = "revisit" if owner and i not in (None, 9) else "response"
        want[i, len(b), hashlib.sha1(b).hexdigest(), kind, owner if kind == "revisit" else None, b if kind == "response" else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert {r.uri for r in got} >= {"http://a/%20x%0D%0Ay", "urn:page:2", "é"}
    some = warc.read(spark, index.where("page_id = 7"), folder).collect()
    assert [r.page_id for r in some] == [7]
    assert warc.read(spark, index.where("false"), folder).collect() == []
    empty = warc.write(pages.where("false"), new_folder(spark, "warc-test"))
    assert empty.collect() == []


def test_token_batches_add_up(spark):
    store, one, two = new_folder(spark, "tokens"), "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"

    def batch(rows):
        return spark.createDataFrame(rows, "doc_id long, op string, source string, lang string, text string").withColumn("tokens", F.lit("mine"))

    def totals(batches):
        return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in token_rollup.rollup(spark, store, batches).collect()}

    inserts = [(1, "insert", "a", "en", "hello world"), (2, "insert", "a", "en", None), (3, "insert", None, None, "x"), (3, "insert", None, None, "x")]
    token_rollup.commit(spark, store, 1, batch(inserts), one, [])
    token_rollup.commit(spark, store, 1, batch([(8, "insert", "z", "z", "never")]), one, [])  # the number is taken
    assert totals([1]) == {("a", "en", one): (2, 2), (None, None, one): (1, 1)}
    token_rollup.commit(spark, store, 2, batch([
        (1, "revise", "b", "en", "hello there world"), (2, "delete", None, None, None), (77, "delete", None, None, None), (4, "insert", "a", "en", "")]), one, [1])
    assert totals([1, 2]) == {("a", "en", one): (1, 0), (None, None, one): (1, 1), ("b", "en", one): (1, 3)}
    token_rollup.commit(spark, store, 3, batch([(1, "insert", "b", "en", "x")]), two, [1, 2])
    token_rollup.commit(spark, store, 4, batch([(1, "delete", None, None, None), (1, "insert", "q", "q", "x")]), one, [1, 2, 3])
    assert totals([1, 2, 3, 4]) == {
        ("a", "en", one): (1, 0), (None, None, one): (1, 1), ("b", "en", one): (0, 0), ("b", "en", two): (1, 1)}


def plain_near(rows):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids = sorted(sets)
    return groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
                        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])


def test_pipeline_stages_equal_plain_versions(spark):
    """Each stage on the rows its predecessor kept: documents, one of each group, no contaminated one, mixed, sharded."""
    import test_single_rows as plain

    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = before.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, sf), name)
        seen[name] = (before.collect(), after.collect())
        assert after.columns[: len(columns)] == columns and (name == "sharding" or len(after.columns) == len(columns))
        before = after
    first, last = seen["quality_rules"]
    for r in first:
        n, _, _, _, again = plain.plain_figures(r.text)
        if n < 50 or 100 * again > 50 * n:
            assert r.doc_id not in {x.doc_id for x in last}
    assert all(r.n_chars == len(r.text) for r in last)
    first, last = seen["near_dedup"]
    near = plain_near(first)
    assert sorted(r.doc_id for r in last) == sorted(i for i in near if near[i] == i)
    first, last = seen["decontamination"]
    hit = {r.doc_id: plain.plain_hits(r.text, items) for r in first}
    assert sorted(r.doc_id for r in last) == sorted(i for i, (n, h, _) in hit.items() if not (h and 20 * h >= n))
    first, last = seen["source_mix"]
    assert {r for r in last} <= {r for r in first} and max(Counter(r.doc_id for r in last).values()) <= 3
    first, last = seen["sharding"]
    counts = Counter(r.shard for r in last)
    assert Counter(r.doc_id for r in first) == Counter(r.doc_id for r in last) and max(counts.values()) - min(counts.values()) <= 1


def test_deduplicated_rows_with_null_ids_and_repeats(spark):
    rows = docs(spark, AWKWARD).withColumn("kept", F.lit(1))
    got = near_dedup.deduplicated(rows)
    assert got.columns == rows.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, 2, 3, 4, 5, 7, 8, 9])
    assert near_dedup.deduplicated(spark.createDataFrame([], DOCS)).collect() == []


def test_entry_works_without_this_folder(tmp_path):
    """Queries of the rest are there when the folder and the pipeline are not."""
    for name in ("tidepoint", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else subprocess.run(
            ["cp", "-r", str(ROOT / name), str(tmp_path / name)], check=True)
    (tmp_path / "tidepoint" / "llm").rename(tmp_path / "gone")
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=120)
    names, _ = json.loads(said.stdout.strip().splitlines()[-1])
    assert "group_by_time" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names


assert lower("AbÉ") == "abÉ"
