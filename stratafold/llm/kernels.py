"""Vectorised text kernels over Arrow batches: whole texts, bounded scratch memory.

All work on UTF-8 bytes. A word is a maximal run of bytes for which a 256-entry table is true; the separators are ASCII,
so byte runs and code-point runs agree. Words are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BLOCK = 1 << 18

#: Separators of `[^\x20\x09-\x0D]+`.
SPACES = np.ones(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Powers of the base and of its inverse modulo 2**64, grown when a word is longer than a block."""

    byte = (np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    power: np.ndarray | None = None
    inverse: np.ndarray | None = None

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.power is None or len(cls.power) < n:
            size = max(n, _BLOCK + (1 << 16))
            cls.power, cls.inverse = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return cls.power, cls.inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them, from 0; a null is an empty text."""
    column = pc.fill_null(batch.column(name), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :]
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], name: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches that hold about `limit` bytes of text each (one row at least), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = text_column(batch, name)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start), raw[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (with the number of words last). No word crosses rows."""
    inside = table[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    last = inside
    last[:-1] &= first[1:] | ~table[raw[1:]]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of raw[start:end], then of the first p bytes of each for p in `prefixes` (0 where it is shorter).

    Works through blocks of about 256 kB that end between words, so scratch memory doesn't grow with the text.
    """
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(prefixes))]
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        stop = int(ends[hi - 1])
        power, inverse = _Tables.upto(stop - base + 1)
        block = raw[base:stop] if fold is None else fold[raw[base:stop]]
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_Tables.byte[block] * power[: stop - base], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[0][lo:hi] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k, p in enumerate(prefixes, 1):
            ok = e - s >= p
            at = np.where(ok, s + p, s)
            value = mix((total[at] - total[s]) * inverse[s] + np.uint64((p * 0xA0761D6478BD642F) & _MASK))
            out[k][lo:hi] = np.where(ok, value, np.uint64(0))
        lo = hi
    return out


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `size` words, and each row's first run (with the number of runs last).

    A row of fewer words, but not none, has one run: all its words.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(begin[-1]), np.uint64)
    if not len(out):
        return out, begin
    row = np.repeat(np.arange(len(counts)), runs)
    at = first[:-1][row] + (np.arange(len(out)) - begin[:-1][row])
    length = np.minimum(counts, size)[row]
    factor = np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(size):
        ok = k < length
        out *= factor
        out += np.where(ok, words[np.minimum(at + k, len(words) - 1)], np.uint64(0))
    return mix(out + length.astype(np.uint64)), begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted, and each row's first (with their number last)."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], np.searchsorted(row[keep], np.arange(len(begin)))


def code_points(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of code points in raw[start:end]."""
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return lead[ends] - lead[starts]


def row_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of values[begin[i]:begin[i+1]]; 0 where that is empty."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]
