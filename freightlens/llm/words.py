"""Words of Arrow text batches as numpy arrays: borders, hashes, rolling window hashes.

Everything works on the UTF-8 bytes of a bounded slice of a batch, so no Python object is made per word.
Hashes are 64 bits with a finaliser; callers that must not err compare the words themselves afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 3 << 20  # text handled at once; a single longer text is a slice of its own
_HASH_WORDS = 100_000  # words hashed at once, which bounds the temporaries of a very long text

U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """Byte table: True where a byte belongs to a word, False within the given spans (ends included)."""
    inside = np.ones(256, dtype=bool)
    for a, b in spans:
        inside[a : b + 1] = False
    return inside


SPACED = separators((0x20, 0x20), (0x09, 0x0D))  # words are what lies between ASCII white space
ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))  # letters, digits, non-ASCII
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """Word borders of one slice. ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, texts: pa.Array, inside: np.ndarray, lower: bool):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        raw = raw[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        self.bytes = LOWER[raw] if lower else raw
        n = len(raw)
        word = inside[raw]
        edge = self.offsets[self.offsets < n]
        before = np.empty(n, bool)
        before[1:] = word[:-1]
        before[edge] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        after[:-1] = word[1:]
        after[self.offsets[self.offsets > 0] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.first[-1] = len(self.start)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 1) -> np.ndarray:
        table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
        out = np.empty(len(self.start), dtype=U64)
        for a in range(0, len(self.start), _HASH_WORDS):
            start, end = self.start[a : a + _HASH_WORDS], self.end[a : a + _HASH_WORDS]
            length = end - start
            at = np.cumsum(length) - length
            place = np.arange(at[-1] + length[-1]) - np.repeat(at, length)
            power = _powers(0x9E3779B97F4A7C15, int(length.max()))
            values = table[self.bytes[place + np.repeat(start, length)]]
            values *= power[place]
            out[a : a + _HASH_WORDS] = np.add.reduceat(values, at) + length.astype(U64) * U64(0xD6E8FEB86659FD93)
        return _mix(out)

    def text(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` (without ``j``), joined by one space."""
        raw, start, end = self.bytes, self.start, self.end
        return b" ".join(raw[start[k] : end[k]].tobytes() for k in range(i, j))


def windows(hashes: np.ndarray, size: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """Hash of every run of ``size`` words; the run at ``i`` is words ``i`` to ``i + size - 1``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    power = _powers(base, len(hashes))
    total = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * power, out=total[1:])
    back = _powers(pow(base, -1, 1 << 64), n)
    return _mix((total[size:] - total[:-size]) * back)


def starts(first: np.ndarray, size: int) -> np.ndarray:
    """The windows of ``size`` words that lie within one text."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    at = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(at, count) + np.repeat(first[:-1], count)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds a bounded amount of text, or one text."""
    size = batch.column(column).cast(pa.large_binary())
    ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
