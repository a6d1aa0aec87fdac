"""Word splitting and hashing shared by the Arrow-based operators.

A word is a run of bytes other than ASCII space and \\t \\n \\v \\f \\r; A-Z are lower-cased, other letters are left alone. All words of a
slice of texts are found and hashed together, by array operations over its bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Of each byte: 0 for white space, else one more than the lower-cased byte.
_VALUE = np.array([0 if b == 32 or 9 <= b <= 13 else (b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where it is shorter; none of no words."""
    if not len(h):
        return h
    m = min(k, len(h))
    n = len(h) - m + 1
    acc = np.full(n, m, np.uint64)
    for j in range(m):
        acc = mix(acc * _MULT[j % 5] + h[j : j + n])
    return np.unique(acc)


class Hasher:
    """64-bit hashes of words: the word's bytes as a polynomial in a fixed odd number, its length, and a finaliser.

    value: of each byte, 0 where it separates words, else what it counts for.
    """

    def __init__(self, value: np.ndarray = _VALUE) -> None:
        self.value = value
        self.powers = np.cumprod(np.full(256, 0xB5297A4D3F84D5B5, np.uint64))

    def __call__(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of the texts, one text after the other, and each text's number of words."""
        return self.located(raws)[:2]

    def located(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """The same; and the texts in one piece, with each word's start and stop in it."""
        joined = b" " + b" ".join(r or b"" for r in raws) + b" "
        buf = np.frombuffer(joined, np.uint8)
        value = self.value[buf]
        word = value != 0
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        starts, stops = edges[0::2], edges[1::2]
        ends = np.cumsum([1 + len(r or b"") for r in raws])
        n = np.diff(np.searchsorted(starts, ends), prepend=0)
        if not len(starts):
            return np.zeros(0, np.uint64), n, joined, starts, stops
        sizes = stops - starts
        longest = int(sizes.max())
        while len(self.powers) <= longest:
            self.powers = np.concatenate([self.powers, self.powers * self.powers[-1]])
        first = starts[0]
        place = np.arange(first, len(buf), dtype=np.int32)
        place -= np.repeat(starts.astype(np.int32), np.diff(starts, append=len(buf)))
        value = value[first:]
        value *= self.powers[np.minimum(place, longest, out=place)]
        return mix(np.add.reduceat(value, starts - first) + sizes.astype(np.uint64) * _MULT[1]), n, joined, starts, stops


class Lookup:
    """Places of hashes in a sorted array of distinct hashes, -1 where absent; the top bits give where to look."""

    def __init__(self, keys: np.ndarray):
        bits = min(21, max(8, len(keys).bit_length()))
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.start = np.zeros((1 << bits) + 1, np.int32)
        for i in range(0, 1 << bits, 1 << 16):  # in parts, as the places come as 64-bit numbers
            part = np.arange(i, min(1 << bits, i + (1 << 16)), dtype=np.uint64) << self.shift
            self.start[i : i + len(part)] = np.searchsorted(keys, part)
        self.start[-1] = len(keys)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        top = (h >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            k = at[left]
            hit = self.keys[k] == h[left]
            out[left[hit]] = k[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def shingle_sets(h: np.ndarray, n: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Of every text, the sorted distinct hashes of its k-word shingles (as shingle_set)."""
    acc = np.full(max(len(h) - k + 1, 0), k, np.uint64)
    for j in range(k):
        acc = mix(acc * _MULT[j % 5] + h[j : j + len(acc)])
    out, at = [], 0
    for m in n.tolist():
        if m < k:
            out.append(shingle_set(h[at : at + m], k))
        else:
            x = np.sort(acc[at : at + m - k + 1])
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x[new])
        at += m
    return out


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A string column's UTF-8, without decoding."""
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and about so many bytes of text (a row at least), so that what is derived from one
    slice stays small. In the end, memory that the worker holds but doesn't use goes back, as the next task may be another operator's."""
    pa.set_memory_pool(pa.system_memory_pool())
    for b in batches:
        if "text" in b.schema.names:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        else:
            upto = np.zeros(b.num_rows, np.int64)
        start = 0
        while start < b.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(upto, before + most, "right"))))
            yield b.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Returns what this process holds but doesn't use, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean_arrow(spark: SparkSession, rows: int = 500) -> None:
    """Sends at most so many rows at once to Python workers: rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
