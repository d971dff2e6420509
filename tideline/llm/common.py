"""What several operators share: table access, word rules and 64-bit hashing in NumPy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: 1 for the bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased UTF-8 text. Bytes from
#: 0x80 up belong to characters above 0x7F, which are word characters, so bytes and characters agree.
IS_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])

#: glibc's malloc_trim, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Returns memory that is free to the system. Python workers live on after a task, and what they keep
    lacks to the executor's other processes."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces whose texts in ``columns`` have about ``size`` bytes, or of one longer
    row. Free memory goes back to the system after each batch."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            ends += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(ends)
        first = 0
        while first < len(ends):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(first, last - first)
            first = last
        give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes, size: int = 1 << 20) -> np.ndarray:
    """Hashes of the words of lower-cased bytes, a piece at a time, so that a very long text takes little
    more memory than its hashes. A piece ends where no word does."""
    if len(raw) <= size:
        data = np.frombuffer(raw, np.uint8)
        return span_hashes(data, *word_spans(data))
    out, a = [], 0
    while a < len(raw):
        b = min(a + size, len(raw))
        while b < len(raw) and IS_WORD[raw[b]]:
            b += 1
        data = np.frombuffer(raw[a:b], np.uint8)
        out.append(span_hashes(data, *word_spans(data)))
        a = b
    return np.concatenate(out)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = IS_WORD[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans: eight bytes at a time, so equal spans have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), np.uint64, padded, strides=(1,))
    length = ends - starts
    out = length.astype(np.uint64) * _BASE + (eight[starts] & _MASK[np.minimum(length, 8)])
    rows = np.flatnonzero(length > 8)
    at, left = starts[rows] + 8, length[rows] - 8
    while len(rows):
        x = out[rows]
        out[rows] = (x ^ (x >> np.uint64(32))) * _M1 + (eight[at] & _MASK[np.minimum(left, 8)])
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return mix64(out)


class HashTable:
    """Small integers by 64-bit hash, open addressing in NumPy arrays; looked up by whole arrays. It doubles
    before it is more than half full, so that a free place ends every search."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that aren't there."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        rows = np.flatnonzero((there != keys) & (there != 0))
        slot = slot[rows]
        while len(rows):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == keys[rows]
            out[rows[hit]] = self.values[slot[hit]]
            more = ~hit & (there != 0)
            rows, slot = rows[more], slot[more]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.keys)
            old, was = self.keys[held], self.values[held]
            self.__init__(int(2 * (self.count + len(keys)) - 1).bit_length())  # type: ignore[misc]
            self.put(old, was)
        slot, values = self._slots(keys), values.astype(np.int32)
        self.count += len(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & (len(self.keys) - 1)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix64(out * _BASE + words[k : len(words) - n + 1 + k])
    return out
