"""Ordinal ranks over whole tables without a single-partition sort, and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftpool.sources.state import materialize


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", start: int = 1) -> DataFrame:
    """df with row_number() over the whole table's order, as a long.

    Rows are range-partitioned and written; each range is ranked alone and moved
    on by the sizes of the ranges before it, a table with a row for each range.
    `order` should end in a unique column.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("a._part") > F.col("b._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(out, (F.col("_local") + F.col("_before") + (start - 1)).cast("long")).drop("_part", "_local", "_before")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each (column: name) of sums, the sum of the column over all rows before this one in the whole table's order.

    As global_rank: ranges are summed alone and moved on by the ranges before
    them. `order` must be unique.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for c, n in sums.items()])
    before = sizes.alias("a").join(sizes.alias("b"), F.col("a._part") > F.col("b._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(*[F.coalesce(F.sum(f"b._s_{n}"), F.lit(0)).alias(f"_b_{n}") for n in sums.values()])
    ahead = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(before), "_part")
    for c, n in sums.items():
        out = out.withColumn(n, F.coalesce(F.sum(c).over(ahead), F.lit(0)) + F.col(f"_b_{n}"))
    return out.drop("_part", *[f"_b_{n}" for n in sums.values()])


def ranks(df: DataFrame, rankers: list[str], key: str) -> DataFrame:
    """(key, _r0, _r1, ...): each row's descending rank under every ranker; only keys and values are sorted."""
    out = None
    for i, r in enumerate(rankers):
        one = global_rank(df.select(key, r), [F.col(r).desc(), F.col(key)], f"_r{i}").select(key, f"_r{i}")
        out = one if out is None else out.join(one, key)
    return out


def borda(df: DataFrame, rankers: list[str], key: str = "row_idx", weights: list[float] | None = None, chunk: int | None = None, out: str = "mu") -> DataFrame:
    """Rank fusion: minus the weighted sum of each row's descending rank under every ranker.

    Weights are scaled to a sum of 1; without weights ranks are summed plainly.
    With `chunk`, ranks are taken inside runs of so many rows by `key` order.
    """
    names = [f"_r{i}" for i in range(len(rankers))]
    if chunk:
        ranked = global_rank(df, [F.col(key)], "_at", start=0).withColumn("_chunk", F.floor(F.col("_at") / F.lit(float(chunk))).cast("long"))
        for r, n in zip(rankers, names, strict=True):
            ranked = ranked.withColumn(n, F.row_number().over(Window.partitionBy("_chunk").orderBy(F.col(r).desc(), F.col(key))).cast("long"))
        ranked = ranked.drop("_at", "_chunk")
    else:
        ranked = df.join(ranks(df, rankers, key), key)
    total = F.lit(0)
    for i, n in enumerate(names):
        total = total + (F.col(n) if weights is None else F.col(n) * F.lit(weights[i] / sum(weights)))
    return ranked.withColumn(out, (-total).cast("double")).drop(*names)


def rank_disagreement(df: DataFrame, rankers: list[str], key: str = "row_idx", beta: float = 0.2, out: str = "u") -> DataFrame:
    """Minus the mean of the normalised ranks plus beta times their deviation: an upper bound from disagreement."""
    n = df.count()
    ranked, names = df.join(ranks(df, rankers, key), key), [f"_r{i}" for i in range(len(rankers))]
    parts = [F.col(c) / F.lit(float(n)) for c in names]
    mean = sum(parts[1:], parts[0]) / float(len(parts))
    spread = F.sqrt(sum(((p - mean) * (p - mean) for p in parts[1:]), (parts[0] - mean) * (parts[0] - mean)) / float(len(parts)))
    return ranked.withColumn(out, -mean + beta * spread).drop(*names)


def spearman(df: DataFrame, a: str, b: str, key: str = "row_idx") -> DataFrame:
    """One row with rho: the correlation of ordinal ranks, ties broken by key."""
    ranked = global_rank(global_rank(df, [F.col(a), F.col(key)], "_a"), [F.col(b), F.col(key)], "_b")
    d = (F.col("_a") - F.col("_b")).cast("decimal(38,0)")
    sums = ranked.agg(F.sum(d * d).cast("double").alias("d2"), F.count(F.lit(1)).cast("double").alias("n"))
    return sums.select((1.0 - 6.0 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1.0))).alias("rho"))
