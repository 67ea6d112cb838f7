"""Contents of hot bands (6) reach the exact join with their whole shingle hashes."""

from helpers import docs

from tidepoint.llm import near_dedup, passages


def test_hot_contents_come_with_whole_hashes(spark, monkeypatch):
    seen = []

    def joined(sets, named):
        seen.extend(sets.collect())
        return near_dedup.crowd_pairs(sets, named)

    monkeypatch.setattr(passages, "crowd_pairs", joined)
    rows = [(i, " ".join([f"q{i // 2}x{k}" for k in range(9)] + "one very common phrase here".split() + [f"r{i}x{k}" for k in range(3)])) for i in range(60)]
    passages.repeated(docs(spark, rows), 5).collect()
    made = {i: set(near_dedup.unpacked(s).tolist()) for i, s in ((r.id, r.shingles) for r in seen)}
    assert made and all(len(bytes(r.shingles)) == 8 * len(made[r.id]) > 0 for r in seen)
    assert max(max(s) for s in made.values()) >= 1 << 40
