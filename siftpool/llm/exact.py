"""Exact dedup by composable polynomial fingerprints.

A chunk's fingerprint is sum(byte[i] * r**i) modulo two primes; a text's is the
sum of its chunks' fingerprints, each times r to the power of the bytes before
it, so chunks can be hashed apart, in any order, and combined. Texts of equal
length and fingerprint are then compared chunk by chunk with one of them; those
that differ form a group of their own and are compared again.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftpool.sources.state import discard, materialize

from ._skew import probable, spread_join
from ._text import flat, spans_of

PRIMES = (2147483647, 2147483629)
ROOTS = (1103515245, 1566083941)
#: Bytes of a chunk: for hashing inside a batch, and for the comparison.
HASHED, COMPARED = 1 << 12, 1 << 16
#: Chunks hashed at once; texts above HUGE bytes are hashed by many tasks; rows that one row is turned into at once.
SLAB, HUGE, COPIES = 256, 8 << 20, 1 << 16
LAST = 2**63 - 1


def _table(root: int, prime: int, n: int) -> np.ndarray:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * root % prime)
    return np.array(out, np.int64)


_WEIGHTS = [_table(r, p, HASHED) for r, p in zip(ROOTS, PRIMES, strict=True)]


def chunk_hash(data: bytes) -> tuple[int, int, int]:
    """(length, fingerprint by each prime) of one chunk of any length."""
    values, at = fingerprints(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return len(data), int(values[0][0]), int(values[1][0])


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of the chunk a followed by the chunk b."""
    one, two = ((x + y * pow(r, a[0], p)) % p for x, y, r, p in zip(a[1:], b[1:], ROOTS, PRIMES, strict=True))
    return a[0] + b[0], one, two


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Fingerprints of all rows by each prime, and the rows' lengths in bytes; SLAB chunks are hashed at once."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // HASHED)
    row = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][row] + nth * HASHED
    size = np.minimum(HASHED, offsets[1:][row] - start)
    out = [np.zeros(len(lengths), np.int64) for _ in PRIMES]
    shifts = [np.array(_table(pow(root, HASHED, prime), prime, int(nth.max(initial=0)) + 1)) for root, prime in zip(ROOTS, PRIMES, strict=True)]
    for low in range(0, len(row), SLAB):
        part = slice(low, low + SLAB)
        bounds = np.cumsum(size[part]) - size[part]
        wide = data[start[low] : start[part][-1] + size[part][-1]].astype(np.int64)
        place = np.arange(len(wide)) - np.repeat(bounds, size[part])
        for k, (weights, prime) in enumerate(zip(_WEIGHTS, PRIMES, strict=True)):
            hashes = np.add.reduceat(wide * weights[place], bounds) % prime
            np.add.at(out[k], row[part], hashes * shifts[k][nth[part]] % prime)
            out[k] %= prime
    return out, lengths


def fingerprint_chunks(chunks: DataFrame, id_col: str, order_col: str, data_col: str) -> DataFrame:
    """Fingerprints (id, size, fp_a, fp_b) of documents that come as rows of chunks (binary), hashed apart.

    Null chunks are empty. Chunks of one document need not fit one task; of rows
    that share id and order one counts. No row of an id gives no result for it.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [chunk_hash(x.as_py() or b"") for x in b[2]]
            yield pa.RecordBatch.from_arrays([b[0], b[1], *(pa.array([g[i] for g in got], pa.int64()) for i in range(3))], ["id", "nth", "n", "a", "b"])

    kind = chunks.schema[id_col].dataType.simpleString(), chunks.schema[order_col].dataType.simpleString()
    hashed = chunks.select(F.col(id_col).alias("id"), F.col(order_col).alias("nth"), F.col(data_col).cast("binary")).mapInArrow(parts, f"id {kind[0]}, nth {kind[1]}, n long, a long, b long")
    hashed = hashed.dropDuplicates(["id", "nth"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    @F.pandas_udf("a long, b long")
    def shifted(n, a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame({c: [int(v) * pow(r, int(s), p) % p for v, s in zip(x, n, strict=True)] for c, x, r, p in (("a", a, ROOTS[0], PRIMES[0]), ("b", b, ROOTS[1], PRIMES[1]))}, columns=["a", "b"])

    moved = hashed.withColumn("before", before).select("id", "n", shifted("before", "a", "b").alias("h"))
    return moved.groupBy("id").agg(F.sum("n").alias("size"), (F.sum("h.a") % PRIMES[0]).alias("fp_a"), (F.sum("h.b") % PRIMES[1]).alias("fp_b")).withColumnRenamed("id", id_col)


def _pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at and bytes of every chunk of COMPARED bytes of rows' text; the empty text has one empty chunk."""
    held = rows.select(*keys, F.col("text").cast("binary").alias("_data"))
    last = F.floor(F.greatest(F.octet_length("_data") - 1, F.lit(0)) / COMPARED).cast("int")
    placed = held.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    return placed.select(*keys, "at", F.substring("_data", F.col("at") * COMPARED + 1, F.lit(COMPARED)).alias("bytes"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low, high in spans_of(b[1], 1 << 21):
            ids, texts = b[0].slice(low, high - low), b[1].slice(low, high - low)
            data, at = flat(texts)
            (one, two), lengths = fingerprints(data, at)
            view = memoryview(np.ascontiguousarray(data))
            shas = [hashlib.sha256(view[at[i] : at[i + 1]]).digest() for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(lengths.astype(np.int64)), pa.array((one << 31) | two), pa.array(shas, pa.binary())],
                ["id", "size", "fp", "sha"],
            )


def _fingerprinted(rows: DataFrame, huge: int) -> DataFrame:
    """(id, size, fp, sha, n) of rows (id, text); rows equal in id and digest are one, n counts them.

    The chunks of texts above `huge` bytes are dealt over all tasks and their
    hashes combined; smaller texts are hashed where they are read.
    """
    long = F.octet_length("text") > huge
    summary = rows.filter(~long).mapInArrow(_summaries, "id long, size long, fp long, sha binary").groupBy("id", "size", "fp", "sha").agg(F.count(F.lit(1)).alias("n"))
    big = rows.filter(long).withColumn("sha", F.unhex(F.sha2("text", 256)))
    known = materialize(big.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")), "huge")
    if not known.isEmpty():
        key = F.struct("id", "sha").alias("key")
        chunks = _pieces(big.select(key, "text"), ["key"]).repartition("key", "at")
        found = fingerprint_chunks(chunks, "key", "at", "bytes").select("key.id", "key.sha", "size", F.shiftleft("fp_a", 31).bitwiseOR(F.col("fp_b")).alias("fp"))
        both = found["id"].eqNullSafe(known["id"]) & (found["sha"] == known["sha"])
        summary = summary.unionByName(found.join(known, both).select(found["id"], "size", "fp", found["sha"], "n"))
    return summary


def _groups(docs: DataFrame, id_col: str, text_col: str, huge: int) -> DataFrame:
    """(id, sha, n, keep_id, group_size), written: a row for all rows of docs that are equal in id and text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    summary = materialize(_fingerprinted(rows, huge), "rows")
    kind = ["size", "fp", "round"]
    own = F.xxhash64("id", "sha")
    keyed = F.coalesce(F.col("id"), F.lit(-LAST))
    open_, settled, written = summary.withColumn("round", F.lit(0)), [], [summary]
    columns = ["id", "sha", "n", "keep_id", "group_size"]
    for step in itertools.count(1):
        groups = open_.groupBy(*kind).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("group_size"), F.max("id").alias("keep_id"), F.max(F.struct(keyed.alias("i"), F.col("sha").alias("s"))).alias("top"))
        groups = materialize(groups, "groups")
        shared = groups.filter("m > 1")
        settled.append(groups.filter("m = 1").select(F.col("keep_id").alias("id"), F.col("top.s").alias("sha"), F.col("group_size").alias("n"), "keep_id", "group_size"))
        written.append(groups)
        if shared.isEmpty():
            break
        sizes = shared.select(*kind, F.col("m").alias("n"))
        members = spread_join(open_, shared.select(*kind, F.col("top.i").alias("rep"), F.col("top.s").alias("rep_sha")), kind, own, counts=sizes)
        members = materialize(members, "members")
        # Only texts that may be a member's are moved, as chunks; of rows alike in id and text one is enough.
        owners = members.select(keyed.alias("k"), "sha", *kind, "rep", "rep_sha")
        texts = probable(rows.withColumn("sha", F.unhex(F.sha2("text", 256))), F.xxhash64("sha"), members.select(F.xxhash64("sha")))
        pieces = _pieces(texts.filter("_maybe").select(keyed.alias("k"), "sha", "text"), ["k", "sha"])
        if not members.filter("n > 1").isEmpty():
            pieces = pieces.dropDuplicates(["k", "sha", "at"])
        weights = members.select(keyed.alias("k"), "sha", F.ceil((F.col("size") + 1) / COMPARED).alias("n"))
        # The chunks of every member and of one member of each group meet by (group, salt, place).
        chunks = materialize(spread_join(pieces, owners, ["k", "sha"], F.col("at"), counts=weights), "chunks")
        model = chunks.filter((F.col("k") == F.col("rep")) & (F.col("sha") == F.col("rep_sha"))).select(*kind, "at", F.col("bytes").alias("expected")).dropDuplicates([*kind, "at"])
        met = spread_join(chunks.select("k", "sha", *kind, "at", "bytes"), model, [*kind, "at"], F.xxhash64("k", "sha"))
        same = met.groupBy("k", "sha", *kind).agg(F.min((F.col("bytes") == F.col("expected")).cast("int")).alias("same"))
        judged = materialize(members.withColumn("k", keyed).join(same, ["k", "sha", *kind]), "judged")
        discard(chunks, members)
        differ = judged.filter("same = 0")
        equal = judged.filter("same = 1").drop("same", "k", "rep", "rep_sha")
        sums = equal.groupBy(*kind).agg(F.sum("n").alias("group_size"), F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("m"))
        sums = materialize(sums, "sums")
        settled.append(spread_join(equal, sums.drop("m"), kind, own, counts=sums.select(*kind, F.col("m").alias("n"))))
        written += [judged, sums]
        open_ = differ.select("id", "size", "fp", "sha", "n").withColumn("round", F.lit(step))
        if differ.isEmpty():
            break
    out = settled[0].select(*columns)
    for part in settled[1:]:
        out = out.unionByName(part.select(*columns))
    out = materialize(out, "settled")
    discard(*written)
    return out


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """(id, sha, keep_id, group_size, kept) for each row of docs, dropped ones too.

    Texts are equal when their UTF-8 bytes are; null text is the empty text. The
    row with the largest id stays, null ids being the smallest; of several rows
    with that id and text, one stays. The result has a row for each row of docs,
    in no order. Texts above `huge` bytes are hashed in chunks by many tasks. An
    empty table gives an empty result.
    """
    out = _groups(docs, id_col, text_col, huge)
    # Rows that stand for many are dealt over the tasks as blocks before they become rows again.
    blocks = out.filter("n > 1").withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    begin = F.col("_block") * COPIES
    copies = blocks.repartition("id", "sha", "_block").withColumn("_copy", F.explode(F.sequence(begin + 1, F.least(begin + COPIES, F.col("n")))))
    every = out.filter("n = 1").withColumn("_copy", F.lit(1).cast("long")).unionByName(copies.drop("_block"))
    return every.select("id", "sha", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """docs with one row of each group of equal texts: see duplicate_groups for which.

    Of several rows with the staying id and text, the least by all columns stays.
    Rows whose text no other row has are not moved.
    """
    found = _groups(docs, id_col, text_col, huge).filter("group_size > 1")
    row = F.struct(*docs.columns).alias("row")
    id_ = F.col(id_col).cast("long")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    keyed = docs.select(row, F.coalesce(id_, F.lit(0)).alias("k"), id_.isNull().alias("z"), digest.alias("sha"))
    told = found.select(F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("z"), "sha", "n", F.col("id").eqNullSafe(F.col("keep_id")).alias("stays"))
    on = ["k", "z", "sha"]
    marked = probable(keyed, F.xxhash64("sha"), found.select(F.xxhash64("sha")))
    shared = marked.filter("_maybe").drop("_maybe")
    met = spread_join(shared, told, on, F.xxhash64("row"), "left", counts=told.select(*on, "n"))
    out = marked.filter("NOT _maybe").select("row").unionByName(met.filter("stays IS NULL OR (stays AND n = 1)").select("row"))
    if not told.filter("stays AND n > 1").isEmpty():
        out = out.unionByName(met.filter("stays AND n > 1").groupBy(*on).agg(F.min("row").alias("row")).select("row"))
    return out.select("row.*")
