"""Words and word windows of Arrow text columns as 64-bit hashes, computed with numpy over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # working memory is about a hundred times this
_rng = np.random.default_rng(20240229)
_lower = np.arange(256)
_lower[65:91] += 32
_byte_keys = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EXACT_KEYS = _byte_keys
LOWER_KEYS = _byte_keys[_lower]
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
POSITION = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
# `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = PLAIN[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of whole rows, about SLICE_BYTES at a time; a longer text comes alone."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words_of(data: np.ndarray, off: np.ndarray, is_word: np.ndarray, keys: np.ndarray):
    """(row, start byte, length, hash) of each word of a slice, in order."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    lengths = np.add.reduceat(inside.astype(np.int64), starts)
    packed = data[inside]
    begin = np.cumsum(lengths) - lengths
    powers = np.multiply.accumulate(np.full(int(lengths.max()), STEP, np.uint64))
    place = np.arange(len(packed)) - np.repeat(begin, lengths)
    hashes = mix(np.add.reduceat(keys[packed] * powers[place], begin) + lengths.astype(np.uint64))
    rows = np.searchsorted(off, starts, "right") - 1
    return rows, starts, lengths, hashes


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every run of n consecutive words that lies in one row."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(n))
    for k in range(n):
        total += hashes[k : k + count] * POSITION[k]
    at = np.flatnonzero(rows[:count] == rows[n - 1 :])
    return at, mix(total[at])


def spread(source: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield source[a:b]
