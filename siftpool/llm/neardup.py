"""MinHash near-dedup: universal hash minima, bands, verification, star components.

1. Each text gets its set of word shingles, a 128-bit digest of the set, and
   BANDS * ROWS minima of affine hashes; every ROWS minima make a band key.
   Texts with the same set are one class from here on, so copies cost nothing.
2. Classes that share a band key are candidates. Buckets with the same members
   are tested once. In each bucket all members meet the one that most buckets
   hold; links are confirmed on full sets, and components formed.
3. Members of a bucket that are still in different components meet, block by
   block, in tasks of bounded size. Only blocks of like set sizes meet; inside a
   task, signatures are compared first and full sets decide. So every pair that
   shares a band is settled: tested, or already connected.
4. Components come from alternating large-star and small-star rounds.

At a similarity of 0.85, a pair shares no band with a probability of
(1 - 0.85**ROWS) ** BANDS, which is 3e-7; at 0.8, 6e-5. A pair that shares one
is passed over in step 3 if so few of its BANDS * ROWS minima agree that a linked
pair would have as few with a probability below 1e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.sources.state import discard, materialize

from ._skew import probable, spread_join
from ._text import WIDTH, flat, lists, mix, shingle_hashes, shingle_sets, spans_of, word_hashes

BANDS, ROWS = 32, 6
#: Members of a block in step 3, and the shingles they have together at most, but for one member with more.
BLOCK, VOLUME = 1024, 1 << 19
LAST = 2**63 - 1
#: What rows of one class have in common: size and digest of the set.
SAME = ["size", "s1", "s2"]

_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MIXER = _RANDOM.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of shingle hashes that begins at `starts`, the least value under every hash: (runs, hashes) uint32.

    The hashes are x -> a * x + b modulo 2**32 with odd a, over the upper half of the shingle's hash.
    """
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), len(_A)), np.uint32)
    for k in range(len(_A)):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(runs, BANDS) keys of 64 bits; a key holds the band's number."""
    parts = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    return mix((parts * _MIXER).sum(axis=2, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64)))


def _digest(own: np.ndarray) -> tuple[int, np.int64, np.int64]:
    """Size and 128-bit digest of a set of shingles; zeros for the empty set."""
    if not len(own):
        return 0, np.int64(0), np.int64(0)
    one, two = np.bitwise_xor.reduce(mix(own)), mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return len(own), one.view(np.int64), two.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low, high in spans_of(b[1], 1 << 18):
            data, at = flat(b[1].slice(low, high - low))
            values, kept = shingle_hashes(*word_hashes(data, at))
            full = np.flatnonzero(kept)
            starts = (np.cumsum(kept) - kept)[full]
            keys = band_keys(minima(values, starts)) if len(full) else np.zeros((0, BANDS), np.uint64)
            n, one, two = (np.zeros(high - low, np.int64) for _ in range(3))
            for row, a in zip(full, starts, strict=True):
                n[row], one[row], two[row] = _digest(np.unique(values[a : a + kept[row]]))
            rows = [np.zeros(0, np.uint64)] * (high - low)
            for row, own in zip(full, keys, strict=True):
                rows[row] = own
            given = [b[0].slice(low, high - low), b[2].slice(low, high - low)]
            yield pa.RecordBatch.from_arrays([*given, pa.array(n), pa.array(one), pa.array(two), lists(rows, pa.int64())], ["id", "t", "size", "s1", "s2", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for low, high in spans_of(b[1], 1 << 20):
            found = lists(list(shingle_sets(b[1].slice(low, high - low))), pa.int64())
            yield pa.RecordBatch.from_arrays([b[0].slice(low, high - low), found], ["id", "shingles"])


def stars(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of edges (u, v): root is the component's least id. Alternating large-star and small-star.

    A root that most edges lead to is no hot key: joins on u are salted.
    """

    def least(of: DataFrame) -> DataFrame:
        return of.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    def turned(of: DataFrame) -> DataFrame:
        return of.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()

    def state(of: DataFrame) -> tuple:
        return tuple(of.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    now = materialize(turned(edges), "edges")
    before = None
    while (after := state(now)) != before:
        before = after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = materialize(least(both).withColumn("m", F.least("u", "m")), "least")
        met = spread_join(both, roots.drop("n"), ["u"], F.col("v"), counts=roots.select("u", "n"))
        large = materialize(turned(met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        tops = materialize(least(large), "tops")
        small = spread_join(large, tops.drop("n"), ["u"], F.col("v"), counts=tops.select("u", "n")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, materialize(turned(small.unionByName(tops.select("u", F.col("m").alias("v")))), "small")
        discard(last, roots, large, tops)
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("id"), "root").distinct())


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union; many pairs may share an a."""
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    met = spread_join(right, sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), ["a"], F.col("b"), counts=pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    both = F.size(F.array_intersect("sa", "sb"))
    return met.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def agreeing(percent: int, error: float = 1e-7) -> int:
    """The least number of agreeing minima that a pair of this similarity falls below with a probability under `error`."""
    n, p, total = BANDS * ROWS, percent / 100, 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total > error:
            return k
    return n


def _common(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, by products of 0/1 matrices over the shingles that several sets have."""
    flat_ = np.concatenate([*rows, *others])
    vocabulary, code, seen = np.unique(flat_, return_inverse=True, return_counts=True)
    keep = seen > 1
    place = np.cumsum(keep) - 1
    at = np.repeat(np.arange(len(rows) + len(others)), [len(x) for x in (*rows, *others)])
    at, code = at[keep[code]], place[code[keep[code]]]
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]
    out = np.zeros((len(rows), len(others)), np.float32)
    for low in range(0, int(keep.sum()), 2048):
        a, b = np.searchsorted(code, (low, low + 2048))
        part = np.zeros((len(rows) + len(others), 2048), np.float32)
        part[at[a:b], code[a:b] - low] = 1
        out += part[: len(rows)] @ part[len(rows) :].T
    return out


def _across(percent: int):  # noqa: ANN202
    """For a group (left rows: side 0, right rows: side 1), links that join the components which linked rows are in.

    Rows joined by earlier links of the group need none, so there are fewer links than rows.
    """
    enough = agreeing(percent)

    def links(table: pa.Table) -> pa.Table:
        ids, roots = table["id"].to_numpy(), table["root"].to_numpy()
        side = table["side"].to_numpy()
        values = table["shingles"].combine_chunks()
        at, flat_ = values.offsets.to_numpy(), values.values.to_numpy()
        marks = minima(flat_.view(np.uint64), at[:-1])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        found = []
        if len(left) and len(right):
            ours, theirs = np.ascontiguousarray(marks[left].T), np.ascontiguousarray(marks[right].T)
            agree = np.zeros((len(left), len(right)), np.uint8)
            for one, two in zip(ours, theirs, strict=True):
                agree += one[:, None] == two[None, :]
            near = (agree >= enough) & (roots[left][:, None] != roots[right][None, :])
            i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if len(i):
                sets = [flat_[at[k] : at[k + 1]] for k in range(len(ids))]
                common = _common([sets[k] for k in left[i]], [sets[k] for k in right[j]])
                sizes = np.diff(at)
                union = sizes[left[i]][:, None] + sizes[right[j]][None, :] - common
                for a, b in zip(*np.nonzero((100 * common >= percent * union) & near[np.ix_(i, j)]), strict=True):
                    u, v = left[i[a]], right[j[b]]
                    x, y = find(roots[u]), find(roots[v])
                    if x != y:
                        parent[x] = y
                        found.append((ids[u], ids[v]))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return links


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures (id, t, size, s1, s2, keys, row) of all rows, and for every class (size, s1, s2) its number of rows `n`,
    the least id `component` of its component, null without any, and the row `lead` that stands for it then.

    Nodes are classes, numbered as they are written, so rows of null or of shared ids do not join what else they hold.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("t"))
    kinds = "id long, t long, size long, s1 long, s2 long, keys array<long>"
    signed = materialize(rows.mapInArrow(_signatures, kinds).withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "t"))
    classes = signed.filter("size > 0").groupBy(*SAME).agg(F.min("id").alias("least"), first.alias("first"), F.min("row").alias("row"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    banded = classes.select("id", F.explode("keys").alias("key"))
    mark = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y")]
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("low"), *mark).filter("m > 1")
    buckets = materialize(buckets.groupBy("m", "low", "x", "y").agg(F.min("key").alias("key")).select("key", "m"), "buckets")
    members = spread_join(banded, buckets.select("key"), ["key"], F.col("id"), counts=buckets.select("key", F.col("m").alias("n")))
    members = materialize(members, "members")

    held = members.groupBy("id").agg(F.count(F.lit(1)).alias("held"))
    candidates = materialize(classes.select("id", "rows", F.col("first.id").alias("_id"), F.col("first.t").alias("t")).join(held.select("id"), "id"), "candidates")
    where = F.xxhash64("_id", "t")  # a class's first text is that of an id and a hash
    texts = probable(rows.select(F.coalesce("id", F.lit(LAST)).alias("_id"), "t", "text").filter("t IS NOT NULL"), where, candidates.select(where)).filter("_maybe")
    texts = spread_join(texts, candidates.drop("rows"), ["_id", "t"], F.monotonically_increasing_id(), counts=candidates.select("_id", "t", F.col("rows").alias("n")))
    sets = materialize(texts.select("id", "text").mapInArrow(_sets, "id long, shingles array<long>").dropDuplicates(["id"]), "sets")

    hubs = members.join(held, "id").groupBy("key").agg(F.max(F.struct("held", (-F.col("id")).alias("i"))).alias("top")).select("key", (-F.col("top.i")).alias("hub"))
    first = spread_join(members, hubs, ["key"], F.col("id")).filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(_confirm(materialize(first, "pairs"), sets, percent), "links")
    roots = materialize(stars(links), "roots")

    placed = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = materialize(placed, "placed")
    apart = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("m > 2 AND r0 != r1").select("key", "m")
    apart = materialize(apart.join(hubs, "key").join(roots.select(F.col("id").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").select("key", "m", F.coalesce("hub_root", "hub").alias("hub_root")), "apart")
    if not apart.isEmpty():
        met = _meetings(placed, apart, classes, percent)
        met = spread_join(met, sets, ["id"], F.col("key"))
        late = materialize(met.groupBy("key", "c1", "i", "c2", "j").applyInArrow(_across(percent), "u long, v long").distinct(), "late_links")
        roots = _joined(roots, late)
    discard(members, candidates, sets, links, placed, apart)

    rooted = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).select(*SAME, F.col("rows").alias("n"), "row", "least", "root")
    rooted = materialize(rooted, "rooted")
    stands = F.min(F.struct(*SAME, "row"))["row"]
    lead = materialize(rooted.groupBy("root").agg(F.min("least").alias("component"), stands.alias("lead"), F.count(F.lit(1)).alias("n")), "leads")
    found = spread_join(rooted.select(*SAME, "n", "root"), lead.drop("n"), ["root"], F.col("s1"), counts=lead.select("root", "n")).drop("root")
    found = materialize(found, "components")
    discard(rooted, lead, classes, buckets, roots)
    return signed, found


def _meetings(placed: DataFrame, apart: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(key, c1, i, c2, j, side, id, root): which rows of a bucket meet in which task.

    All pairs with the hub are settled, so one side is what lies outside the
    hub's component. Members of a bucket are parted by their sets' sizes so that
    linked ones lie in one class or in two that follow each other, and each class
    into blocks of BLOCK members or VOLUME shingles; pairs of blocks meet once.
    """
    step = math.log(100 / percent) + 1e-9
    rest = spread_join(placed, apart, ["key"], F.col("id"), counts=apart.select("key", F.col("m").alias("n")))
    rest = rest.join(classes.select("id", "size"), "id").withColumn("c", F.floor(F.log(F.col("size")) / F.lit(step)))
    rest = materialize(rest.select("key", "id", "root", "size", "c", (F.col("root") != F.col("hub_root")).alias("outside")), "rest")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / VOLUME)).cast("int")
    parts = materialize(rest.groupBy("key", "c").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")), "parts")
    own = spread_join(rest, parts.drop("n"), ["key", "c"], F.col("id"), counts=parts.select("key", "c", "n"))
    own = own.withColumn("at", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
    around = own.withColumn("other", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    sizes = parts.select("key", "n", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("other")).groupBy("key", "other").agg(F.sum("n").alias("n"))
    around = spread_join(around, parts.select("key", F.col("c").alias("other"), "blocks"), ["key", "other"], F.col("id"), counts=sizes)
    around = around.withColumn("there", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = around.filter("outside").select("key", F.col("c").alias("c1"), F.col("at").alias("i"), F.col("other").alias("c2"), F.col("there").alias("j"), F.lit(0).alias("side"), "id", "root")
    once = ~F.col("outside") | (F.struct("other", "there") <= F.struct("c", "at"))
    right = around.filter(once).select("key", F.col("other").alias("c1"), F.col("there").alias("i"), F.col("c").alias("c2"), F.col("at").alias("j"), F.lit(1).alias("side"), "id", "root")
    out = materialize(left.unionByName(right), "met")
    discard(rest, parts)
    return out


def _joined(roots: DataFrame, late: DataFrame) -> DataFrame:
    """roots (id, root) after further links: their components are found among the roots alone."""
    ends = late.join(roots.select(F.col("id").alias("u"), F.col("root").alias("a")), "u", "left").join(roots.select(F.col("id").alias("v"), F.col("root").alias("b")), "v", "left")
    above = materialize(stars(ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).filter("u != v")), "above")
    known = spread_join(roots, above.select(F.col("id").alias("root"), F.col("root").alias("top")), ["root"], F.col("id"), "left")
    alone = above.join(roots.select("id"), "id", "left_anti")
    return materialize(known.select("id", F.coalesce("top", "root").alias("root")).unionByName(alone), "roots_all")


def _placed(signed: DataFrame, found: DataFrame) -> DataFrame:
    sized = spread_join(signed.filter("size > 0").select("id", *SAME, "row"), found.drop("n"), SAME, F.col("row"), counts=found.select(*SAME, "n"))
    kept = F.when(F.col("component").isNull(), F.col("row") == F.col("lead")).otherwise(F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
    out = sized.select("id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))
    return out.unionByName(signed.filter("size = 0").select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs, in no order.

    Words are runs of characters other than \\x20 and \\x09-\\x0D, A-Z lower-cased;
    a set holds WIDTH-word shingles, or with fewer words the whole sequence. Rows
    without words, or of null text, have an empty set, link with nothing and are
    their own component. Two rows link if 100 * |intersection| >= percent *
    |union|, and not because their ids are null or equal; component_id is the
    least id reachable, kept tells whether it is the row's own. A component of
    null ids alone has a null component_id, and one of its rows is kept. An empty
    table gives an empty result.
    """
    return _placed(*_components(docs, id_col, text_col, percent))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with one row for each component of near_groups: the one with the least id; without ids, the least by all columns.

    An id stays once: of several rows that share it and are kept, the least by all
    columns. Rows of null id that resemble nothing all stay.
    """
    signed, found = _components(docs, id_col, text_col, percent)
    gone = materialize(_placed(signed, found).filter("NOT kept AND id IS NOT NULL").select("id").distinct(), "gone")
    shared = signed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL")
    shared = materialize(shared, "shared")
    row = F.struct(*docs.columns).alias("row")
    keyed = docs.select(row, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Rows whose id is surely none of these stay where they are.
    odd_ids = shared.filter("id IS NOT NULL").select("id")
    marked = probable(keyed, F.xxhash64(F.coalesce("id", F.lit(LAST))), gone.unionByName(odd_ids).select(F.xxhash64("id")))
    sure = marked.filter("NOT _maybe AND id IS NOT NULL").select("row")
    maybe = marked.filter("_maybe AND id IS NOT NULL").select("row", "id", "text")
    if shared.isEmpty():
        return sure.unionByName(maybe.join(gone, "id", "left_anti").select("row")).select("row.*")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([_digest(x) for x in shingle_sets(b.column(2))], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *map(pa.array, own.T.copy())], ["row", "id", *SAME])

    # The few rows without an id of their own are placed by their sets.
    counts = shared.filter("id IS NOT NULL").select("id", "n")
    of_shared = spread_join(maybe, odd_ids, ["id"], F.xxhash64("text"), counts=counts)
    odd = keyed.filter("id IS NULL").unionByName(of_shared.select("row", "id", "text"))
    kind = keyed.select("row").schema["row"].dataType.simpleString()
    odd = materialize(odd.mapInArrow(digests, f"row {kind}, id long, size long, s1 long, s2 long"), "odd")
    met = spread_join(odd.filter("size > 0"), found.drop("n"), SAME, F.xxhash64("row"), counts=found.select(*SAME, "n"))
    empty = odd.filter("size = 0")
    own = met.filter("id = component").select("id", "row").unionByName(empty.filter("id IS NOT NULL").select("id", "row"))
    alone = met.filter("component IS NULL").select("lead", "row")
    single = maybe.join(gone.unionByName(odd_ids), "id", "left_anti").select("row")
    parts = [
        sure,
        single,
        own.groupBy("id").agg(F.min("row").alias("row")).select("row"),
        alone.groupBy("lead").agg(F.min("row").alias("row")).select("row"),
        empty.filter("id IS NULL").select("row"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("row.*")
