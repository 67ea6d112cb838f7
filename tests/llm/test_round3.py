"""Exact duplicates (11), centroid clustering (12) and phrases (13) against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from helpers import AWKWARD, docs, lower
from pyspark.sql import functions as F

import corpus_pipeline
from tidepoint.llm import centroids, decontaminate, exact_dedup, line_dedup, line_quality, mixing, near_dedup, phrases, ring
from tidepoint.llm.common import stored

COPIES = AWKWARD + [(100 + i, "the same text") for i in range(300)] + [(50, "the same text "), (51, "The same text"), (None, None), (None, None)]


def plain_classes(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_classes_equal_plain_python(spark, keep):
    table = docs(spark, COPIES).repartition(7).withColumn("digest", F.lit("mine")).withColumn("kept", F.lit(1)).withColumn("node", F.lit("x"))
    got = exact_dedup.classes(table, keep=keep).collect()
    assert sorted(str((r.id, r.keep_id, r.group_size, bytes(r.digest).hex())) for r in got) == plain_classes(COPIES, keep)
    stay = [(r.id, bytes(r.digest)) for r in got if r.kept]
    assert len({d for _, d in stay}) == len(stay) == len({t or "" for _, t in COPIES})
    assert all(r.id == r.keep_id for r in got if r.kept)
    left = exact_dedup.deduplicated(table, keep=keep)
    assert left.columns == table.columns
    assert sorted(hashlib.sha256((r.text or "").encode()).digest() for r in left.collect()) == sorted(d for _, d in stay)


def test_rounds_of_any_shape_merge_the_same(spark):
    entries = exact_dedup.digests(docs(spark, COPIES).repartition(9)).cache()
    want = sorted((bytes(r.digest), r.keep, r.n) for r in exact_dedup.tree_merge(entries, nodes=1).collect())
    for nodes in (2, 9, 30, 70):
        got = sorted((bytes(r.digest), r.keep, r.n) for r in exact_dedup.tree_merge(entries, nodes=nodes).collect())
        assert [(d, n) for d, _, n in got] == [(d, n) for d, _, n in want] and [k for _, k, _ in got] == [k for _, k, _ in want]
    assert [exact_dedup.fan_in(n) for n in (1, 8, 64, 200, 4096)] == [(2, 2), (3, 2), (8, 2), (6, 3), (8, 4)]


def test_entries_are_one_only_if_all_evidence_agrees(spark):
    digest = bytes(32)
    entries = spark.createDataFrame([(i, digest, s, c, 0, i) for i, (s, c) in enumerate([(1, 1), (1, 1), (2, 1), (1, 2)])],
                                    "id long, digest binary, size int, check long, run int, row long")
    got = sorted((r["size"], r["check"], r["keep"], r["n"]) for r in exact_dedup.tree_merge(entries).collect())
    assert got == [(1, 1, 0, 2), (1, 2, 3, 1), (2, 1, 2, 1)]


def test_groups_below_the_heavy_bound_join_by_digest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 2)
    got = exact_dedup.classes(docs(spark, COPIES), keep="largest").collect()
    assert sorted(str((r.id, r.keep_id, r.group_size, bytes(r.digest).hex())) for r in got) == plain_classes(COPIES, "largest")
    assert exact_dedup.classes(docs(spark, [])).collect() == [] and exact_dedup.deduplicated(docs(spark, [])).collect() == []


def plain_clusters(rows, k, rounds, dims, scale=1024, seed="3:"):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256((seed + ("" if i is None else str(i))).encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        parts = defaultdict(list)
        for _, v in kept:
            parts[near(v)].append(v)
        c = [[sum(x) // len(parts[j]) for x in zip(*parts[j])] if parts[j] else c[j] for j in range(len(c))]
    return sorted(str((i, near(v), d if (d := far(v, c[near(v)])) < 2**63 else None)) for i, v in kept), c


def some_vectors(n, dims, spread=1.0):
    step = lambda i, d: ((i * 2654435761 + d * 40503) % 1009) / 1009 - 0.5
    return [(i, [spread * (step(i, d) + (i % 5)) for d in range(dims)]) for i in range(n)]


ODD = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, float("nan"), 2.0, 3.0]),
       (905, [1.0, float("inf"), 2.0, 3.0]), (906, [0.0] * 4), (906, [0.0] * 4), (None, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 5.0])]


@pytest.mark.parametrize("spread", [1.0, 1e7, 1e15, 3e30])
def test_clusters_equal_plain_python(spark, spread):
    rows = some_vectors(120, 4, spread) + ODD
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("id", F.lit("x")).withColumn("cluster", F.lit(9))
    placed, found = centroids.clustered(table, k=6, rounds=4, dims=4)
    want, c = plain_clusters(rows, 6, 4, 4)
    assert found == c and sorted(str((r.id, r.cluster, r.distance)) for r in placed.collect()) == want
    sums = {r.cluster: (r.cluster_inertia, r.inertia) for r in centroids.with_inertia(placed).collect()}
    assert set(sums) == {r.cluster for r in placed.collect()}
    if spread == 1.0:
        each = Counter()
        for r in placed.collect():
            each[r.cluster] += r.distance
        assert sums == {j: (t, sum(each.values())) for j, t in each.items()}


def test_ties_few_rows_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    placed, found = centroids.clustered(same, k=3, rounds=2, dims=2)
    assert found == [[1024, 2048]] * 3 and {r.cluster for r in placed.collect()} == {0}
    one, found = centroids.clustered(same.limit(1), k=3, rounds=2, dims=2)
    assert len(found) == 1 and one.count() == 1
    none, found = centroids.clustered(same.limit(0), k=3, rounds=2, dims=2)
    assert found == [] and centroids.with_inertia(none).collect() == []
    with pytest.raises(ValueError):
        centroids.clustered(same, scale=1000)


def test_limbs_add_up():
    values = [-(2**200), 2**200 + 3, -1, 0, 2**36, -(2**36) - 5]
    total = [sum(x) for x in zip(*map(centroids.limbs, values))]
    assert sum(x << (36 * i) for i, x in enumerate(total)) == sum(values)


def plain_phrases(rows, at_least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= at_least}
    around = Counter()
    for (g, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                around[g, w[i : i + m]] = max(around[g, w[i : i + m]], a)
    out = defaultdict(list)
    for (g, w), a in cand.items():
        if 100 * around[g, w] < 100 * a:
            score, k = min((1000 * a * n[g] // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
            out[g].append((-score, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
    return sorted((g, i + 1, p.decode(), -a, lt, r, n[g], -s) for g, x in out.items() for i, (s, a, p, lt, r) in enumerate(sorted(x)[:top]))


def prose(i):
    w = [f"w{(i * 7 + j * j * 3 + j) % 23}" for j in range(60)]
    return " ".join(w[:20]) + ". New York City, New  York\tCity! " + " ".join(w[20:]) + "\nÜber alles Über alles;ein\x00x y"


TEXTS = [(prose(i), ["en", "de", None, "und"][i % 4]) for i in range(40)] + [
    (None, "en"), ("", "fr"), (" \t. ,", "fr"), ("a " * 5000, "en"), ("x" * 50_000 + " b b b", "en"), ("a b " * 3000, None), (prose(1), "en"), (prose(1), "en")]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 97}, {"block_bytes": 1500, "most_bits": 1 << 12}, {"bits": 9}])
def test_phrases_equal_plain_python(spark, how):
    """Also with blocks that cut texts, filters that are too small, and fingerprints that collide all the time."""
    table = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(TEXTS)], "doc_id long, text string, lang string")
    table = table.repartition(3).withColumn("phrase", F.lit("mine")).withColumn("f", F.lit(1)).withColumn("id", F.lit(0))
    got = phrases.collocations(table, at_least=7, **how).collect()
    assert sorted(tuple(r)[:8] for r in got) == plain_phrases(TEXTS, 7)
    seen = {(r.lang, r.phrase): r.example for r in got}
    assert seen["en", "new york city"] == 0 and seen["und", "new york city"] == 2


def test_only_the_first_phrases_and_none(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUFFER", 64)
    monkeypatch.setattr(phrases, "TEXT_BUFFER", 64)
    table = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(TEXTS)], "doc_id long, text string, lang string")
    assert sorted(tuple(r)[:8] for r in phrases.collocations(table, at_least=7, longest=3, top=4).collect()) == plain_phrases(TEXTS, 7, 3, 4)
    assert phrases.collocations(table.limit(0)).collect() == [] and phrases.collocations(table, at_least=10**6).collect() == []


CLASHING = ["size", "source_size", "target", "copies", "taken", "shard", "slot", "_gone", "kept", "id", "n", "a", "b", "bucket", "component", "rows"]


def test_clashing_columns_pass_or_give_way(spark):
    table = docs(spark, AWKWARD + [(60 + i, "some words that stand here for the third time or so\nnext line", "s") for i in range(3)])
    table = table.withColumns({c: F.lit(c) for c in CLASHING})
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string").withColumns({c: F.lit(c) for c in CLASHING})
    for made in (line_quality.clean(table), near_dedup.deduplicated(table), line_dedup.clean(table), decontaminate.clean(table, bench),
                 mixing.mixed(table), exact_dedup.deduplicated(table)):
        back = stored(made, "clash")
        assert back.columns == table.columns and all(r[c] == c for r in back.collect() for c in CLASHING)
    mix = stored(mixing.mix(table), "clash")
    assert sorted(mix.columns) == sorted(table.columns) and all(r["copies"] in range(4) for r in mix.collect())
    placed = stored(ring.assign(table), "clash")
    assert sorted(placed.columns) == sorted(table.columns) and placed.count() == table.count()
    assert {r["slot"] for r in placed.collect()} == {0} and placed.select("shard").distinct().count() == table.count()


def test_pipeline_runs_over_awkward_and_empty_tables(spark, tmp_path):
    prose = " ".join(f"word{i} runs{i} over the hill{i} and sees a river{i}." for i in range(12))
    rows = AWKWARD + [(70, prose), (71, prose), (70, prose), (None, prose + " Once."), (72, prose.replace("word5", "other5")), (73, prose.upper() + " END.")]
    for name, table in (("some", docs(spark, rows).withColumns({c: F.lit(c) for c in CLASHING})), ("none", docs(spark, []))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, None), (2, "one two")], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    made = corpus_pipeline.run(spark, str(tmp_path / "some"))
    got = made.collect()
    assert {r.doc_id for r in got} <= {70, None} and 70 in {r.doc_id for r in got} and {"shard", "slot"} <= set(made.columns)
    assert sorted(r.slot for r in got if r.shard == got[0].shard)[0] == 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
