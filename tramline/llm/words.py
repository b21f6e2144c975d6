"""Words of texts as flat arrays.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r: what bytes.split() gives, and what the pattern
``[^\\x20\\x09-\\x0D]+`` matches. bytes.lower() lower-cases A-Z only. Texts travel as binary, so no decoding is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = b" \t\n\x0b\x0c\r"
#: A task's table of word hashes is emptied at this many words, so it stays bounded.
MOST_WORDS = 150_000
#: Bytes of text that a task turns into words at once (one text at least).
SLICE = 1 << 20


class WordHashes(dict):
    """Word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def texts(column) -> list[bytes]:
    """A binary Arrow column as bytes; null counts as empty."""
    return [x or b"" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int | None = None):
    """A batch in parts whose texts have `most` bytes (SLICE) together, however many rows the session puts in a batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + (most or SLICE), "right")))
        yield batch.slice(at, end - at)
        at = end


def hashes(words: list[bytes], table: WordHashes) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive words, by a polynomial over the words' hashes modulo 2^64."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: spans of 1, 2, 4, ... words, joined by the bits of k
    span, size, out, done = h, 1, None, 0
    powers = {1: np.array([0x9E3779B97F4A7C15], np.uint64)}  # arrays wrap without a warning
    while True:
        if k & size:
            out = span[:n].copy() if out is None else out * powers[size] + span[done : done + n]
            done += size
        if size * 2 > k:
            return mixed(out)
        span = span[: len(span) - size] * powers[size] + span[size:]
        powers[size * 2] = powers[size] * powers[size]
        size *= 2
