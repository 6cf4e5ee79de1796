"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of the ring. A row goes clockwise from its
key's hash to the next point; where that shard is full, it goes on clockwise to
the next shard with room. All rows of one arc between two points meet the
shards in the same order, so the walk is settled for arcs, by counts: the
driver sees vnodes * shards arcs and no rows. Inside an arc, rows stand in the
order of (lane, hash, key, digest, whole row), where the lane is a hash of the
key, so rows of one key stay together but where a shard fills up; the first ones
stay with the arc's own shard. A lane with a large share of all rows is dealt
over further lanes: by key, then by the whole row, then, for rows alike in all,
by their number. Which row goes where depends on the rows alone.
"""

from __future__ import annotations

import hashlib

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftpool.sources.state import materialize

#: Sub-groups of an arc, so that no task ranks a whole arc.
LANES = 16
#: A lane with more than 1/HOT of all rows is dealt over SALTS lanes.
HOT, SALTS = 500, 64


def ring(shards: int, vnodes: int) -> tuple[list[float], list[int]]:
    """Sorted points in [0, 1) and the shard that owns each."""
    points = sorted(
        (int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:6], "big") / 2**48, s)
        for s in range(shards)
        for v in range(vnodes)
    )
    return [p for p, _ in points], [s for _, s in points]


def preferences(owners: list[int]) -> list[list[int]]:
    """For each arc (it ends at point i; arc len(owners) wraps round), the shards in clockwise order."""
    out = []
    for i in range(len(owners) + 1):
        order: dict[int, None] = {}
        for j in range(len(owners)):
            order.setdefault(owners[(i + j) % len(owners)])
        out.append(list(order))
    return out


def allot(counts: list[int], orders: list[list[int]], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc, runs (shard, rows) that fill it; nearer shards take rows before farther ones."""
    left, room = list(counts), list(capacity)
    runs: list[list[tuple[int, int]]] = [[] for _ in counts]
    for step in range(len(capacity)):
        for arc, order in enumerate(orders):
            if left[arc] and room[order[step]]:
                n = min(left[arc], room[order[step]])
                runs[arc].append((order[step], n))
                left[arc] -= n
                room[order[step]] -= n
    if any(left):
        raise ValueError("the shards' capacity is below the number of rows")
    return runs


def capacities(rows: int, shards: int, load: float) -> list[int]:
    """Rows that each shard may hold: the even share times `load`; at load 1 the shares differ by one at most."""
    if load < 1:
        raise ValueError("load must be 1 or more")
    if load == 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-rows * load // shards)] * shards


def _numbered(held: DataFrame) -> DataFrame:
    """held with `_number`: for rows of hot lanes, their number among the rows alike; counted in each part of the table, then added up."""
    alike = ["_arc", "_lane", "_whole"]
    hot = held.filter("_hot").withColumn("_part", F.shiftright("_seq", 33))
    sizes = hot.groupBy(*alike, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*alike).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*alike, "_part").orderBy("_seq"))
    known = hot.select("_seq", *alike, "_part", place.alias("_place")).join(sizes.withColumn("_before", before), [*alike, "_part"])
    return held.join(known.select("_seq", (F.col("_place") + F.col("_before") - 1).alias("_number")), "_seq", "left")


def assign_shards(
    df: DataFrame, key: str, shards: int, vnodes: int = 64, load: float = 1.25, digest: str | None = None
) -> DataFrame:
    """Add `shard` int and `slot` long (gapless from 0 in each shard) to df's columns; df is written once.

    key: column of any hashable kind; rows with a null key hash alike but are
    rows as any others. Rows of one key part where the shard fills up, or where
    they are a large share of all rows. Repeated rows are placed one by one.
    digest: a column that orders rows of one key.
    No shard holds more than ceil(load * rows / shards). Columns of df named
    shard or slot are replaced. An empty table gives an empty result.
    """
    points, owners = ring(shards, vnodes)
    held = df.drop("shard", "slot")
    names = held.columns
    named = [F.col(key), *([F.col(digest)] if digest else [])]
    spot = F.shiftrightunsigned(F.xxhash64(F.col(key)), 12).cast("double") / float(2**52)
    whole = F.xxhash64(*names)
    held = held.withColumns({"_spot": spot, "_lane": F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(LANES)), "_whole": whole, "_seq": F.monotonically_increasing_id()})
    held = Bucketizer(splits=[-1.0, *points, 2.0], inputCol="_spot", outputCol="_arc").transform(held)
    held = materialize(held.withColumn("_arc", F.col("_arc").cast("int")), "placed")
    arcs = len(points) + 1

    def count(rows: DataFrame) -> dict[tuple[int, int], int]:
        """Bounded by the number of lanes: arcs * LANES, and SALTS for each of less than HOT hot ones, three times."""
        return {(r["_arc"], r["_lane"]): r["n"] for r in rows.groupBy("_arc", "_lane").agg(F.count(F.lit(1)).alias("n")).collect()}

    groups = count(held)
    total = sum(groups.values())
    for deal in ("key", "row", "number"):
        hot = [k for k, n in groups.items() if n > max(total / HOT, 64)]
        if not hot:
            break
        marked = F.broadcast(df.sparkSession.createDataFrame(hot, "_arc int, _lane long").withColumn("_hot", F.lit(True)))
        held = held.join(marked, ["_arc", "_lane"], "left")
        if deal == "number":
            held = _numbered(held)
        salt = {"key": F.xxhash64(F.lit(2), F.col(key)), "row": F.col("_whole")}.get(deal, F.col("_number") if deal == "number" else None)
        held = held.withColumn("_lane", F.col("_lane") * SALTS + F.when(F.col("_hot"), F.pmod(salt, F.lit(SALTS))).otherwise(0)).drop("_hot", "_number")
        groups = count(held)
    lanes: list[list[int]] = [[] for _ in range(arcs)]
    for a, k in sorted(groups):
        lanes[a].append(k)
    counts = [sum(groups[a, k] for k in lanes[a]) for a in range(arcs)]
    runs = allot(counts, preferences(owners), capacities(total, shards, load))
    # Lanes follow each other inside an arc; each lane is cut where a run ends.
    filled, pieces = [0] * shards, []
    for arc, own in enumerate(runs):
        queue = [[s, n] for s, n in own]
        for lane in lanes[arc]:
            begin, n = 0, groups[arc, lane]
            while begin < n:
                take = min(n - begin, queue[0][1])
                pieces.append((arc, lane, begin, begin + take, queue[0][0], filled[queue[0][0]] - begin))
                filled[queue[0][0]] += take
                begin += take
                queue[0][1] -= take
                if not queue[0][1]:
                    queue.pop(0)
    cuts = df.sparkSession.createDataFrame(pieces, "_arc int, _lane long, _from long, _to long, shard int, _shift long")
    window = Window.partitionBy("_arc", "_lane").orderBy(F.col("_spot"), *named, "_whole")
    ranked = held.withColumn("_at", F.row_number().over(window).cast("long") - 1)
    # A row for each lane and each cut, whatever the input's size.
    placed = ranked.join(
        F.broadcast(cuts.withColumnsRenamed({"_arc": "_a", "_lane": "_l"})),
        (F.col("_arc") == F.col("_a")) & (F.col("_lane") == F.col("_l")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")),
    )
    return placed.select(*names, "shard", (F.col("_at") + F.col("_shift")).alias("slot"))
