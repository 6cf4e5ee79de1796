"""Substring dedup over sliding runs of sentences.

A text is cut into units: sentences (ending at . ! ? before white space, or at
a line end), and wherever UNIT words in a row close no sentence, again after the
word of the least hash among them. So a passage is cut alike wherever it stands:
4 * UNIT + 1 words hold RUN whole units, whatever is around them. Each run of RUN
consecutive units, lengthened forwards or backwards until it has LEAST words,
is hashed; equal runs are found across all documents, and a unit goes when any
run covering it occurs earlier: in a document of a smaller id, or before it in
the same document. White space between what stays is kept as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.sources.state import materialize

from ._skew import probable, spread_join
from ._text import mix

UNIT, RUN, LEAST = 12, 3, 12
_SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?!\s|$)[^\n.!?]*)*(?:[.!?]+|\n|$)\s*")
#: White space by code point, as str.split has it; there is none beyond the last place.
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])
#: Stands for a null doc_id, so that rows without one come last.
LAST = 2**63 - 1
#: Run hashes sent to Spark at once.
AT_ONCE = 50_000
_BASE = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_LOWER = np.uint64(2**32 - 1)
_UPPER = ~_LOWER


def _inner(words: list[str], closing: np.ndarray, size: int) -> np.ndarray:
    """Places of the words that end a unit inside a sentence: in each window of `size` words of which none closes a sentence, the one of the least hash, and of several the last.

    What a window chooses depends on its own words alone, and so do all places
    from the first to the last that windows inside a passage choose. With the
    words that close sentences they are `size` words apart at most, the first
    within `size` words of the passage's start. Words that lie in no such window are not hashed.
    """
    lengths = closing - np.concatenate([[-1], closing[:-1]])
    wide = lengths > size
    if not wide.any():
        return np.zeros(0, np.int64)
    n = len(words)
    open_ = np.repeat(wide, lengths)
    least = np.full(n, _UPPER)
    least[open_] = np.fromiter(map(xxhash.xxh3_64_intdigest, compress(words, open_.tolist())), np.uint64) & _UPPER
    least[closing] = 0
    least |= _LOWER - np.arange(n, dtype=np.uint64)
    span = 1
    while span < size:
        step = min(span, size - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    chosen = np.zeros(n, bool)
    chosen[(_LOWER - (least & _LOWER)).astype(np.int64)] = True
    chosen[closing] = False
    return np.flatnonzero(chosen)


def units(text: str, size: int = UNIT) -> list[tuple[int, int, int, int]]:
    """(start, end, words, hash) of each unit; the units cover the text without gaps."""
    if not text:
        return []
    words = text.split()
    space = _SPACE.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), mode="clip")
    edge = ~space
    edge[1:] &= space[:-1]
    starts = np.flatnonzero(edge)
    stops = np.array([m.end() for m in _SENTENCE.finditer(text) if m.end() > m.start()])
    last = np.searchsorted(starts, stops)
    inner = _inner(words, last[last > np.concatenate([[0], last[:-1]])] - 1, size)
    if len(inner):  # such a unit ends where the next word starts
        stops = np.sort(np.concatenate([stops, starts[inner + 1]]), kind="stable")
        last = np.searchsorted(starts, stops)
    stop, after = stops.tolist(), last.tolist()
    digest = xxhash.xxh3_64_intdigest
    return [(i, j, n - m, digest(" ".join(words[m:n]))) for i, j, m, n in zip([0, *stop], stop, [0, *after], after, strict=False)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        _POWERS = tuple(np.cumprod(np.append(np.uint64(1), np.full(2 * n, b, np.uint64)), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _POWERS


def runs(found: list[tuple[int, int, int, int]], run: int = RUN, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First unit, unit after the last and hash (uint64) of every run, by first unit; units without words join no run's count.

    A run's hash is a polynomial in its units' hashes, taken from sums over prefixes.
    """
    words = np.fromiter((u[2] for u in found), np.int64, len(found))
    at = np.flatnonzero(words)
    n = len(at)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = np.fromiter((u[3] for u in found), np.uint64, len(found))[at]
    total = np.concatenate([[0], np.cumsum(words[at])])
    start = np.arange(n)
    ahead = np.maximum(start + run, np.searchsorted(total, total[:-1] + least))
    back = np.minimum(start + 1 - run, np.searchsorted(total, total[1:] - least, "right") - 1)
    fits, has = ahead <= n, back >= 0
    has &= ahead[np.maximum(back, 0)] != start + 1  # not met going ahead
    pairs = np.sort(np.concatenate([start[fits] * (n + 1) + ahead[fits], back[has] * (n + 1) + start[has] + 1]), kind="stable")
    i, j = pairs // (n + 1), pairs % (n + 1)
    power, inverse = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(own * power[:n], out=prefix[1:])
    return at[i], at[j - 1] + 1, mix((prefix[j] - prefix[i]) * inverse[i] + (j - i).astype(np.uint64))


def cut(text: str, repeated: np.ndarray, **how: int) -> tuple[str, int, int]:
    """The text without units under a run in `repeated` (uint64) or under a later copy of its own run; units and units removed."""
    found = units(text, how.get("unit", UNIT))
    if not len(repeated):  # a run that the text itself repeats has units that it repeats
        own = [u[3] for u in found if u[2]]
        if len(set(own)) == len(own):
            return text, len(found), 0
    first, end, hashes = runs(found, how.get("run", RUN), how.get("least", LEAST))
    out = np.ones(len(hashes), bool)
    out[np.unique(hashes, return_index=True)[1]] = False
    if len(repeated):
        out |= np.isin(hashes, repeated)
    if not out.any():
        return text, len(found), 0
    gone = np.zeros(len(found) + 1, np.int64)
    np.add.at(gone, first[out], 1)
    np.add.at(gone, end[out], -1)
    covered = np.cumsum(gone)[:-1] > 0
    kept = "".join([text[u[0] : u[1]] for u, c in zip(found, covered.tolist(), strict=True) if not c])
    return kept, len(found), int(covered.sum())


def dedup_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, run: int = RUN, least: int = LEAST
) -> DataFrame:
    """docs with the text cut, plus n_units, n_removed (int) and first_ids, the documents that hold the removed runs' first copies.

    Null text stays null and has no units; null ids count as the largest id.
    Rows that share an id are parts of one document and lose only what another
    document has earlier, or what repeats inside the row. Wholly equal documents
    other than the first lose all their runs. Texts with fewer than `run` units
    or `least` words are never touched. Other columns, a count of characters for
    one, stay as they were. Empty tables give empty results; columns
    of docs named like the three new ones are replaced.
    """
    how = {"unit": unit, "run": run, "least": least}
    docs = docs.drop("n_units", "n_removed", "first_ids")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(ids: list[tuple[int, int]], values: list[np.ndarray]) -> pa.RecordBatch:
            every = np.concatenate([*values, np.zeros(0, np.uint64)])
            rows = np.repeat(np.array(ids, np.int64).reshape(-1, 2), [len(x) for x in values], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1])), pa.array(every.view(np.int64))], ["_id", "_t", "_h"])

        for b in batches:
            ids, values, held = [], [], 0
            for doc, own, text in zip(b[0].to_pylist(), b[1].to_pylist(), b[2], strict=True):
                ids.append((doc, own))
                values.append(np.unique(runs(units(text.as_py() or "", unit), run, least)[2]))
                held += len(values[-1])
                if held > AT_ONCE:
                    yield batch(ids, values)
                    ids, values, held = [], [], 0
            yield batch(ids, values)

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id")
    own = F.xxhash64(text_col).alias("_t")  # tells rows of one id apart, null ids above all
    spans = materialize(docs.select(key, own, F.col(text_col)).mapInArrow(hashes, "_id long, _t long, _h long"), "runs")
    seen = spans.groupBy("_h").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first")).filter("n > 1")
    seen = materialize(seen, "repeated")
    later = spread_join(spans, seen.drop("n"), ["_h"], F.xxhash64("_id", "_t"), counts=seen.select("_h", "n")).filter("_id > _first")
    mine = later.groupBy("_id", "_t").agg(F.collect_set("_h").alias("_hs"), F.collect_set("_first").alias("first_ids"))
    mine = materialize(mine, "later")

    # Rows without a run that another document has before them are not moved.
    held = docs.select(F.struct(*docs.columns).alias("_row"), key, own)
    marked = probable(held, F.xxhash64("_id", "_t"), mine.select(F.xxhash64("_id", "_t")))
    shared = marked.filter("_maybe").drop("_maybe")
    met = spread_join(shared, mine, ["_id", "_t"], F.monotonically_increasing_id(), "left").select("_row", "_hs", "first_ids")
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("_hs", "first_ids")]
    kept = met.unionByName(marked.filter("NOT _maybe").select("_row", *none)).select("_row.*", F.col("_hs"), F.col("first_ids"))
    names = docs.columns
    at = names.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, removed = [], [], []
            for text, hs in zip(b.column(at), b.column(len(names)), strict=True):
                own = hs.values.to_numpy(zero_copy_only=False).view(np.uint64) if hs.is_valid else np.zeros(0, np.uint64)
                text = text.as_py()
                new, n, k = cut(text, own, **how) if text is not None else (None, 0, 0)
                texts.append(new)
                counts.append(n)
                removed.append(k)
            columns = [*b.columns[: len(names)], pa.array(counts, pa.int32()), pa.array(removed, pa.int32()), b.column(len(names) + 1)]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_units", "n_removed", "first_ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return kept.mapInArrow(rewrite, f"{kinds}, n_units int, n_removed int, first_ids array<long>")
