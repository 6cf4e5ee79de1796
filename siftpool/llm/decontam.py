"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are sorted into classes by the size of their shingle set, each class
twice as wide as the one before. For each class a document is cut into windows
of two blocks, a block being the class's upper size, so that any passage of
that size lies whole in some window and a small item is no longer lost in a
long document: an item of which 0.8 is in the window has a Jaccard similarity
of 0.8 * q / (4 * q + 0.2 * q), 0.19, with it at least. A window and an item
that share one of HASHES minima are candidates; the pair is then verified on
the item's and the whole document's exact shingles. A pair is missed with a
probability of (1 - 0.19) ** HASHES, 1e-6.

Benchmarks are sent to the executors in parts of about `part_bytes` of text and
`part_items` items at most, one pass over the documents for each part, so what is
broadcast has a bound: some 800 bytes for an item, and 4 for each byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, WIDTH, flat, shingle_hashes, shingle_sets, spans_of, word_hashes

HASHES = 64
#: Text and number of benchmark items that one pass takes.
PART_BYTES, PART_ITEMS = 8 << 20, 20_000
_RANDOM = np.random.default_rng(6)
_A = _RANDOM.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)


def size_class(n: int) -> int:
    """Items of 2**(c-1)+1 to 2**c shingles are in class c."""
    return max(int(n) - 1, 0).bit_length()


class Index:
    """Minima of all items by class and hash, and the items' sets."""

    def __init__(self, ids: list[int], copies: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.copies, self.sets = ids, copies, sets
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                self.classes.setdefault(size_class(len(s)), []).append(i)
        for c, items in self.classes.items():
            x = [(sets[i] >> np.uint64(32)).astype(np.uint32) for i in items]
            least = np.array([(v[:, None] * _A + _B).min(axis=0) for v in x])
            self.tables[c] = [(least[(o := np.argsort(least[:, k], kind="stable")), k], np.array(items)[o]) for k in range(HASHES)]

    def candidates(self, shingles: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs in which an item shares a minimum with a window of the row's shingle sequence.

        shingles: those of all rows, one after the other; counts: how many each row has.
        """
        found: set[tuple[int, int]] = set()
        if not len(shingles) or not self.tables:
            return found
        base, top = min(self.tables), max(self.tables)
        wide = 1 << base
        blocks = -(-counts // wide)
        row = np.repeat(np.arange(len(counts)), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(np.cumsum(counts) - counts, blocks) + nth * wide
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.array([np.minimum.reduceat(x * _A[k] + _B[k], begin) for k in range(HASHES)])
        for c in range(base, top + 1):
            if c in self.tables:
                windows = least.copy()
                inside = np.flatnonzero(row[1:] == row[:-1])
                windows[:, inside] = np.minimum(least[:, inside], least[:, inside + 1])
                for k, (keys, items) in enumerate(self.tables[c]):
                    at = np.searchsorted(keys, windows[k])
                    at[at == len(keys)] = 0
                    hit = np.flatnonzero(keys[at] == windows[k])
                    for r, a in set(zip(row[hit].tolist(), at[hit].tolist(), strict=True)):
                        found.update((r, int(i)) for i in items[a : np.searchsorted(keys, keys[a], "right")])
            pairs = np.flatnonzero(nth % 2 == 0)  # two blocks of a row become one
            least = np.minimum.reduceat(least, pairs, axis=1)
            row, nth = row[pairs], nth[pairs] // 2
        return found


    def hits(self, texts: pa.Array, least: float) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles found) of each row and item it contains, by rows."""
        for low, high in spans_of(texts, 1 << 18):
            values, n = shingle_hashes(*word_hashes(*flat(texts.slice(low, high - low)), ALNUM))
            end = np.cumsum(n)
            wholes: dict[int, np.ndarray] = {}
            for row, i in sorted(self.candidates(values, n)):
                if row not in wholes:
                    wholes = {row: np.unique(values[end[row] - n[row] : end[row]])}
                whole, s = wholes[row], self.sets[i]
                at = np.searchsorted(whole, s)
                at[at == len(whole)] = 0
                found = int((whole[at] == s).sum())
                if found >= least * len(s) - 1e-9:
                    yield low + row, i, found


def _indexes(items: DataFrame, item_col: str, text_col: str, part_bytes: int, part_items: int) -> Iterator[Index]:
    """Indexes of the parts of a benchmark, one at a time; equal items are one, with the number of their rows."""
    kept = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("item", "text").agg(F.count(F.lit(1)).alias("n"))
    size = kept.agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(-(-(size["bytes"] or 0) // part_bytes), -(-size["items"] // part_items), 1)
    for part in range(parts):
        rows = kept.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()  # bounded by the two limits
        yield Index([r["item"] for r in rows], [r["n"] for r in rows], list(shingle_sets(pa.array([r["text"] for r in rows], pa.string()), WIDTH, ALNUM)))


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = 0.8,
    part_bytes: int = PART_BYTES,
    part_items: int = PART_ITEMS,
) -> DataFrame:
    """(id, item, n_found, n_shingles, containment): items of whose distinct shingles a document has the share `least` or more.

    Words are runs of ASCII letters and digits and all characters beyond ASCII,
    A-Z lower-cased; a shingle has five words. An item of fewer words is one
    shingle, which only a document of just these words has; an item or document
    without words, or of null text, is in no pair. Repeated items and documents
    give a row each. Empty tables give empty results.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema_item = to_arrow_type(items.schema[item_col].dataType)
    out = None
    for index in _indexes(items, item_col, item_text_col, part_bytes, part_items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                ids, columns = [], [[], [], [], []]
                for row, i, found in index.hits(b[1], least):
                    s = len(index.sets[i])
                    for _ in range(index.copies[i]):
                        ids.append(row)
                        for c, v in zip(columns, (index.ids[i], found, s, found / s), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [b[0].take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (schema_item, pa.int64(), pa.int64(), pa.float64()), strict=True))],
                    ["id", "item", "n_found", "n_shingles", "containment"],
                )

        found = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(search, f"id {kind}, item {item_kind}, n_found long, n_shingles long, containment double")
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = 0.8,
    part_bytes: int = PART_BYTES,
    part_items: int = PART_ITEMS,
) -> DataFrame:
    """docs without the rows that hold an item: see find_contained. Rows of null id stay.

    Rows are judged where they are read, so nothing is moved; of rows that share
    an id, those that hold an item go.
    """
    out, kinds = docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    for index in _indexes(items, item_col, item_text_col, part_bytes, part_items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                stays[[row for row, _, _ in held.value.hits(b.column(at), least)]] = False
                yield b.filter(pa.array(stays | b.column(id_at).is_null().to_numpy(zero_copy_only=False)))

        out = out.mapInArrow(clean, kinds)
    return out
