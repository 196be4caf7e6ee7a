"""Array helpers over Arrow batches of texts.

Every function works on the UTF-8 bytes of a whole batch at once, so that the
per-word work is NumPy work.  Words are maximal runs of bytes other than the
ASCII blanks 0x20 and 0x09-0x0D, which in UTF-8 is the same as runs of
characters other than those.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20

_Q = 0x9E3779B97F4A7C15
_U = np.uint64
SECOND = 0x5BD1E995  # salt of second hashes
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _Q), ("down", pow(_Q, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of stretches of bytes, eight at once, each scrambled with its place; salts give hashes that know nothing of one another."""
    n = (end - start + 7) >> 3
    to = np.cumsum(n)
    place = np.arange(to[-1] if len(to) else 0) - np.repeat(to - n, n)
    at = np.repeat(start, n) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    left = np.repeat(end, n) - at
    short = left < 8
    lanes[short] &= (_U(1) << (left[short].astype(np.uint64) * _U(8))) - _U(1)
    keys = mix((np.arange(place.max() + 1 if len(place) else 0, dtype=np.uint64) + _U(1)) * _U(_Q) ^ _U(salt))
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(mix(lanes ^ keys[place]) * (keys[place] | _U(1)), out=sums[1:])
    return mix(sums[to] - sums[to - n] + (end - start).astype(np.uint64) * _U(_Q))


def sequence_hashes(values: np.ndarray, first: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of consecutive runs of values, which begin at ``first``, each value scrambled with its place in the run."""
    n = np.diff(first)
    place = (np.arange(len(values)) - np.repeat(first[:-1], n)).astype(np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ mix((place + _U(1)) * _U(_Q) ^ _U(salt))), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64) * _U(_Q))


class Rolling:
    """Hashes of any stretch of a sequence from one running sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _U(_Q))


class Words:
    """The words of some texts: bytes, spans and the text that each is in."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        self.n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + self.n + 1].astype(np.int64) if self.n else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at, self.raw = at - at[0], raw
        self.data = LOWER[raw] if lower else raw
        self.solid = ~BLANK[raw]
        first, last = self.solid.copy(), self.solid.copy()
        first[1:] &= ~self.solid[:-1]
        last[:-1] &= ~self.solid[1:]
        inner = self.at[(self.at > 0) & (self.at < len(raw))]
        first[inner] |= self.solid[inner]
        last[inner - 1] |= self.solid[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.at)  # first word of each text
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(self.n), self.counts)

    def hashes(self, salt: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, salt)

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows of so many words inside one text."""
        if len(self.start) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[: len(self.text) - size + 1] == self.text[size - 1 :])


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand twice or more in the array."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def give_back() -> None:
    """Return to the system what a task has freed, as its worker lives on beside other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def list_array(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the running ends of its rows."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
