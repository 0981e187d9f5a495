"""Hashed words and word shingles of Arrow texts, a whole batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once, so that a very long text needs no more memory than many short ones.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
POWERS = powers(0xD1342543DE82EF95, 1 << 12)


def slice_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each run of bytes above 32."""
    inside = data > 32
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    values = np.where(inside, BYTES[data] * POWERS[at & 4095], np.uint64(0)) + np.where(inside & (at > 4095), (at >> 12).astype(np.uint64), np.uint64(0))
    return mix(np.add.reduceat(values, starts)), starts


def words(data: np.ndarray) -> np.ndarray:
    """Hashes of the whitespace-separated words of one text's bytes."""
    out, begin = [], 0
    while begin < len(data):
        end = min(len(data), begin + SLICE)
        while end < len(data) and data[end] > 32:
            gap = np.flatnonzero(data[end : end + SLICE] <= 32)
            end = end + int(gap[0]) if len(gap) else min(len(data), end + SLICE)
        out.append(slice_words(data[begin:end])[0])
        begin = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def batch_words(texts: pa.Array) -> list[np.ndarray]:
    """For each text (null: empty), the hashes of its lower-cased words."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    data, lengths = np.frombuffer(texts.buffers()[2] or b"", np.uint8), pc.binary_length(texts).to_numpy().astype(np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    first = int(np.frombuffer(texts.buffers()[1], kind)[texts.offset]) if len(texts) else 0
    ends = first + np.cumsum(lengths)
    return [words(data[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a text of fewer words has one shingle, an empty one none."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    total = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x2545F4914F6CDD1D) + hashes[j : len(hashes) - k + 1 + j]
    return np.unique(mix(total + np.uint64(k)))
