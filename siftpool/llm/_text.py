"""Vectorised words and shingles over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; numpy needs about forty times as much.
PIECE = 1 << 20
#: Words of a shingle.
WIDTH = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LANES = np.random.default_rng(5).integers(1, 2**63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words end at \x20 and \x09 to \x0D.
SPACES = np.ones(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = False
#: Words are runs of ASCII letters, digits and of all bytes beyond ASCII.
ALNUM = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the rows' offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def spans_of(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges with about `size` bytes each, one row at least."""
    _, at = flat(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end
        row = end


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64) - 1, _BASE))])
    return _POWERS


_POWERS = np.ones(1, np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word (A-Z lower-cased), and how many words each row has."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    low = 0
    while low < len(data):
        high = min(low + PIECE, len(data))
        while high < len(data):  # a piece ends where no word goes on
            cut = np.flatnonzero(~letters[data[low:high]] | begins[low:high])
            if len(cut) and cut[-1] > 0:
                high = low + int(cut[-1])
                break
            high = min(high + PIECE, len(data))
        part = data[low:high]
        inside = letters[part]
        before = np.empty(len(part), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        start = inside & (~before | begins[low:high])
        at = np.flatnonzero(inside)
        first = np.flatnonzero(start[at])  # of each word, in at
        if len(first):
            length = np.diff(np.append(first, len(at)))
            place = np.arange(len(at)) - np.repeat(first, length)
            value = _LOWER[part[at]].astype(np.uint64) + _U(1)
            value *= _powers(int(length.max()))[place]
            hashes.append(mix(np.add.reduceat(value, first) + length.astype(np.uint64)))
            row = np.searchsorted(offsets, low + at[first], "right") - 1
            counts += np.bincount(row, minlength=len(counts))
        low = high
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `width` words, and their number; fewer words make one run, none makes none."""
    kept = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if not len(words):
        return np.zeros(0, np.uint64), kept
    padded = np.concatenate([words, np.zeros(width - 1, np.uint64)])
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.zeros(len(words), np.uint64)
    for j in range(width):
        total += padded[j : j + len(words)] * _LANES[j]
    for row in np.flatnonzero((counts > 0) & (counts < width)):  # short rows: their own words only
        own = words[starts[row] : ends[row]]
        total[starts[row]] = (own * _LANES[: len(own)]).sum(dtype=np.uint64) + _U(len(own))
    chosen = np.zeros(len(words) + 1, np.int64)
    np.add.at(chosen, starts[kept > 0], 1)
    np.add.at(chosen, (starts + kept)[kept > 0], -1)
    return mix(total[np.cumsum(chosen[:-1]) > 0]), kept


def shingle_sets(column: pa.Array, width: int = WIDTH, letters: np.ndarray = SPACES) -> Iterator[np.ndarray]:
    """For each row, its sorted distinct shingle hashes."""
    for low, high in spans_of(column):
        data, at = flat(column.slice(low, high - low))
        values, kept = shingle_hashes(*word_hashes(data, at, letters), width)
        end = np.cumsum(kept)
        for a, b in zip(end - kept, end, strict=True):
            yield np.unique(values[a:b])


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy rows."""
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(x) for x in values], out=at[1:])
    joined = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(joined.view(np.int64) if joined.dtype == np.uint64 else joined, kind))
