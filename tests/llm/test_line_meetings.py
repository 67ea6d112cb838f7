"""Lines that share a word (3): a frequent word is looked through where it lies, only a crowd goes on to the joins."""

import random

import numpy as np
import pyarrow as pa

from tidepoint.llm import line_dedup


class Task:
    """Stands for a table: gives the function that its tasks would run."""

    sparkSession = conf = property(lambda self: self)

    def get(self, _):
        return "1"

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, _):
        return run


def met(sets):
    """Rows out of one word that all of `sets` (key -> hashes) share."""
    rows = []
    for key, words in sets.items():
        w = np.array(sorted(words), np.uint64)
        bit = np.uint64(1) << (w >> np.uint64(58))
        half = np.where(w >> np.uint64(51) & np.uint64(64), bit, np.uint64(0))
        rows.append({"word": 1, "salt": 0, "key": key, "n": len(w), "place": 0, "bits": int(np.bitwise_xor.reduce(bit).view(np.int64)),
                     "more": int(np.bitwise_xor.reduce(half).view(np.int64)) if len(w) > line_dedup.LONG else None})
    rows.sort(key=lambda r: (r["n"], r["key"]))
    parts = [pa.RecordBatch.from_pylist(rows[i : i + 70], schema=line_dedup.POSTS) for i in range(0, len(rows), 70)]
    out = [r for b in line_dedup.meeting(Task(), line_dedup.SMALL)(iter(parts)) for r in b.to_pylist()]
    return {frozenset((r["key"], r["other"])) for r in out if r["other"] is not None}, {r["key"] for r in out if r["other"] is None}


def drawn(rng, n):
    return {rng.getrandbits(64) for _ in range(n)}


def test_a_frequent_word_gives_its_similar_pairs_only():
    rng = random.Random(4)
    sets = {k: drawn(rng, rng.randrange(30, 150)) for k in range(300)}
    for k in range(0, 300, 10):  # every tenth has a partner: a tenth of its words is lost, or some are new
        keep = sorted(sets[k])
        sets[1000 + k] = set(keep[len(keep) // 10 :]) if k % 20 else set(keep) | drawn(rng, len(keep) // 8)
    pairs, members = met(sets)
    assert not members
    alike = {frozenset((a, b)) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert alike and alike <= pairs and len(pairs) < 2 * len(alike)


def test_a_crowd_goes_on_as_members():
    rng = random.Random(5)
    base = sorted(drawn(rng, 80))
    sets = {k: set(base[:-3]) | drawn(rng, 3) for k in range(200)}
    assert met(sets) == (set(), set(sets))
