"""Array kernels over the bytes of Arrow string columns.

A column's texts lie one after another in one buffer, so words, lines and their
hashes are found for many texts at once, without a Python string per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: A word is a run of bytes that are not ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Ranges of more bytes are hashed one by one.
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """The column as one string array without nulls: a null text is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one offset more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.StringArray, most_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes``; a longer text is a range of its own."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        end = min(len(texts), max(at + 1, end))
        yield at, end
        at = end


def tidy(run):
    """A worker's function over batches that gives memory back when a task ends, since workers live on for other stages."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc alone keeps what is freed
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


class Hasher:
    """Hashes of byte ranges of a buffer: eight bytes a step for all short ranges at once, XXH3 for each longer one.

    Each step mixes all bits, so that no family of texts (as words of one polynomial) meets by its structure.
    """

    def __init__(self, raw: np.ndarray):
        self.raw = np.ascontiguousarray(raw)
        self.padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        self.words = np.ndarray(len(raw) + 1, "<u8", self.padded, 0, (1,))  # the eight bytes that begin at each place

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        with np.errstate(over="ignore"):
            out = mix(sizes.astype(U64) * U64(0x9E3779B97F4A7C15))
            left = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
            for step in range(0, SHORT, 8):
                if not len(left):
                    break
                rest = sizes[left] - step
                own = self.words[starts[left] + step] & (~U64(0) >> (U64(64) - U64(8) * np.minimum(rest, 8).astype(U64)))
                out[left] = mix((out[left] ^ own) * U64(0xD6E8FEB86659FD93))
                left = left[rest > 8]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = xxhash.xxh3_64_intdigest(memoryview(self.raw[starts[i] : ends[i]]), 1)
        return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that cross no text: starts, ends, and how many begin before each text."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SPACE[raw], offsets)


def totals(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How much of ``marks`` lies in each range between neighbouring offsets."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def owners(counts: np.ndarray) -> np.ndarray:
    """For each element, the row that it belongs to, from the number of elements before each row."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and their rows; a shorter text is one run of all its words."""
    rows = owners(counts)
    if not len(hashes):
        return hashes, rows
    sizes = np.diff(counts)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes), U64)
        left = np.minimum(n, counts[1:][rows] - np.arange(len(hashes)))
        for k in range(n):
            reach = left > k
            at = np.flatnonzero(reach)
            out[at] = out[at] * U64(0xD6E8FEB86659FD93) + hashes[at + k]
        out = mix(out)
    full = (left == n) | ((sizes[rows] < n) & (np.arange(len(hashes)) == counts[:-1][rows]))
    return out[full], rows[full]
