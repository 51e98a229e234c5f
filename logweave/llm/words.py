"""Words of many texts at once: numpy arrays over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Text bytes that are worked on at once; a longer text is one slice of its own.
SLICE_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins (one more offset for the end). Nulls are empty texts."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes each, or one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a slice of texts: ``start`` and ``end`` in ``data``, and ``first``, the number of each text's first word
    (one more for the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        word = ~SPACE[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        filled = offsets[1:] > offsets[:-1]
        head, tail = offsets[:-1][filled], offsets[1:][filled] - 1
        begins[head], ends[tail] = word[head], word[tail]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one blank after each, and the new starts and ends."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        start = end - size
        out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
        source = np.repeat(self.start - start, size)
        to = np.arange(len(source)) + np.repeat(np.arange(len(size)), size)
        out[to] = self.data[to + source]
        return out.tobytes(), start, end


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for each slice of the texts of ``column``; ``lower`` turns A-Z into a-z."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, limit):
        part = data[offsets[i] : offsets[j]]
        yield i, j, Words(LOWER[part] if lower else part, offsets[i : j + 1] - offsets[i])


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """64-bit hashes of runs of items from prefix sums: item values times powers of an odd number, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, dtype=np.uint64)) * 8 + 5 & (1 << 64) - 1
        self.values = rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = 1 << int(n).bit_length()
            inverse = pow(self.base, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(n + 1, self.base, np.uint64))
                self.down = np.cumprod(np.full(n + 1, inverse, np.uint64))

    def runs(self, items: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of items[start:end] for each pair; ``items`` are 64-bit values."""
        self._powers(len(items))
        total = np.zeros(len(items) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(items * self.up[: len(items)], out=total[1:])
            return mix64((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def words(self, words: Words) -> np.ndarray:
        """A hash for each word."""
        return self.runs(self.values[words.data], words.start, words.end)


def distinct_words(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts, A-Z lower-cased: bytes and bounds of the distinct words, each with a blank at its end; the word
    number of each token; the number of each text's first token (one more for the end)."""
    words = Words(LOWER[part], at)
    buffer, start, _ = words.joined()
    offsets = np.append(start, len(buffer)).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
    coded = tokens.dictionary_encode()
    data, bounds = text_bytes(coded.dictionary)
    return data, bounds, np.asarray(coded.indices).astype(np.int64), words.first
