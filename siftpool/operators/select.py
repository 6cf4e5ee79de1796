"""Batches, quotas, top-k and thresholds, with ties broken by a unique column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftpool.functions.math import hash_uniform

#: Parts of a group that are ranked apart before the whole group is.
PARTS = 64


def resolve(size: float, n: int, up: bool = True) -> int:
    """A count from a count or a share of n; ValueError unless positive. Never above n."""
    k = (math.ceil if up else int)(size * n) if isinstance(size, float) and 0 <= size <= 1 else int(size)
    if k <= 0:
        raise ValueError("the size must be positive")
    return min(k, n)


def batch_size(sizes: list[float], turn: int, n: int) -> int:
    """The turn's size; the last one repeats."""
    return resolve(sizes[min(turn, len(sizes) - 1)], n)


def top(df: DataFrame, by: str, k: int, tie: Column) -> DataFrame:
    """The k rows with the largest `by`."""
    return df.orderBy(F.col(by).desc_nulls_last(), tie).limit(k)


def unlabelled(pool: DataFrame, labelled: DataFrame, key: str = "row_idx") -> DataFrame:
    """Candidates: rows whose key was not drawn yet."""
    return pool.join(labelled.select(key), key, "left_anti")


def epsilon_greedy(df: DataFrame, k: int, share: float, n: int, key: str = "row_idx", seed: int = 0) -> DataFrame:
    """df with `u` infinite for ceil(k * share) rows drawn from the whole table; a round's own seed draws other rows."""
    drawn = df.orderBy(hash_uniform(F.col(key), seed).desc(), key).limit(math.ceil(k * share)).select(key, F.lit(True).alias("_drawn"))
    return df.join(F.broadcast(drawn), key, "left").withColumn("u", F.when(F.col("_drawn"), F.lit(float("inf"))).otherwise(F.col("u"))).drop("_drawn")


def acquire_batch(preds: DataFrame, explored: DataFrame, name: str, k: int, batch: int, epsilon: float = 0.0, key: str = "row_idx", seed: int = 0, **how: float) -> DataFrame:
    """The next batch: key, mu and `u` of the best rows that are not explored.

    The value to beat is the k-th largest explored score, null scores left out:
    the largest if there are fewer than k, -inf if there is none. Of the whole
    table ceil(batch * epsilon) random rows come first; of those, explored ones
    are lost. explored has key and score, to be maximised.
    """
    from siftpool.operators.acquire import utility

    if name in ("ei", "pi"):
        preds, how["best"] = preds.crossJoin(F.broadcast(kth_value(explored, "score", k))), F.col("kth")
    scored = utility(name, preds, key, seed=seed, **how)
    if epsilon:
        scored = epsilon_greedy(scored, batch, epsilon, 0, key, seed)
    return top(unlabelled(scored, explored, key), "u", batch, F.col(key)).select(key, "mu", "u")


def _first(df: DataFrame, group: str, quota: DataFrame, order: list[Column], key: str) -> DataFrame:
    """Of each group the first `quota` rows: first of each of PARTS hashed parts of a group, then of what is left."""
    sized = df.join(F.broadcast(quota), group)  # a row for each group
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("_part")
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    few = sized.withColumn("_part", part).withColumn("_place", inside).filter("_place <= quota")
    return few.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_place <= quota").drop("_place", "_part")


def stratified(pool: DataFrame, stratum: str, size: int, key: str = "row_idx", seed: int = 0) -> DataFrame:
    """From each stratum ceil(size * share) rows drawn at random; strata are few."""
    counts = pool.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    quota = counts.crossJoin(F.broadcast(total)).select(stratum, F.ceil(F.lit(size) * F.col("_n") / F.col("_total")).alias("quota"))
    return _first(pool, stratum, quota, [hash_uniform(F.col(key), seed).desc(), F.col(key)], key)


def decayed_quota(df: DataFrame, group: str, by: str, size: int, temperature: float, key: str = "row_idx") -> DataFrame:
    """Of each group the best ceil(size * exp(-(best - group's best) / temperature)) rows; groups are few."""
    best = df.groupBy(group).agg(F.max(by).alias("_own"))
    whole = best.agg(F.max("_own").alias("_all"))
    scale = F.exp(-(F.col("_all") - F.col("_own")) / temperature)
    quota = best.crossJoin(F.broadcast(whole)).select(group, F.ceil(F.round(size * scale, 9)).cast("long").alias("quota"))
    return _first(df, group, quota, [F.col(by).desc(), F.col(key)], key)


def temperature(turn: int, start: float, end: float) -> float:
    return (start - end) * math.exp(-turn) + end


def true_top(scored: DataFrame, k: int, order: str = "row_idx") -> DataFrame:
    """The k least scores, ties in table order."""
    return scored.filter("score IS NOT NULL").orderBy("score", order).limit(k)


def kth_value(df: DataFrame, by: str, k: int) -> DataFrame:
    """One row `kth`: the k-th largest value, the largest if there are fewer than k, -inf if there is none."""
    ordered = df.filter(F.col(by).isNotNull()).select(by).orderBy(F.col(by).desc()).limit(k)
    found = ordered.agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi"))
    return found.select(F.when(F.col("n") == 0, F.lit(float("-inf"))).when(F.col("n") < k, F.col("hi")).otherwise(F.col("lo")).alias("kth"))


def in_slice(pool: DataFrame, start: int, stop: int, key: str = "row_idx") -> DataFrame:
    """Rows start to stop, exclusive."""
    return pool.filter((F.col(key) >= start) & (F.col(key) < stop))


def python_slice(pool: DataFrame, n: int, start: int | None, stop: int | None, step: int = 1, key: str = "row_idx") -> DataFrame:
    """Rows of a slice as Python has it, negative bounds and steps included; `place` is each row's place in it."""
    chosen = range(*slice(start, stop, step).indices(n))
    if not len(chosen):
        return pool.filter(F.lit(False)).withColumn("place", F.lit(0).cast("long"))
    place = F.floor((F.col(key) - chosen.start) / F.lit(float(chosen.step))).cast("long")
    inside = pool.filter(F.col(key).between(min(chosen[0], chosen[-1]), max(chosen[0], chosen[-1])) & (F.pmod(F.col(key) - chosen.start, F.lit(abs(chosen.step))) == 0))
    return inside.withColumn("place", place)


def at(pool: DataFrame, row: int, n: int, key: str = "row_idx") -> DataFrame:
    """The one row; a negative number counts from the end, IndexError outside."""
    if not -n <= row < n:
        raise IndexError(f"a row number outside 0 to {n - 1}")
    return pool.filter(F.col(key) == row % n)


def renumbered(df: DataFrame, key: str = "row_idx", old: str = "old_idx") -> DataFrame:
    """df with dense numbers from 0 in the order of the old ones, which are kept beside them."""
    from siftpool.operators.rank import global_rank

    return global_rank(df.withColumnRenamed(key, old), [F.col(old)], key, start=0)


def within(labelled: DataFrame, turn: int, online: bool) -> DataFrame:
    """What a model is trained on: all labelled rows, or with `online` only those of the turn; failures never."""
    return labelled.filter(F.col("score").isNotNull() & ((F.col("round") == turn) if online else F.lit(True)))


def gather(pool: DataFrame, rows: DataFrame, n: int, key: str = "row_idx") -> DataFrame:
    """The rows asked for, in order; IndexError if one is outside 0 to n - 1."""
    outside = rows.filter((F.col(key) < 0) | (F.col(key) >= n)).limit(1).count()
    if outside:
        raise IndexError(f"a row number outside 0 to {n - 1}")
    return pool.join(rows.select(key).distinct(), key, "left_semi").orderBy(key)


def chunk_ceil(key: Column, n: int, chunks: int) -> Column:
    """Chunk number where every chunk but the last has ceil(n / chunks) rows."""
    return F.floor(key / F.lit(float(-(-n // chunks)))).cast("long")


def chunk_balanced(key: Column, n: int, chunks: int) -> Column:
    """Chunk number where the first n mod chunks chunks have one row more."""
    small, extra = divmod(n, chunks)
    edge = extra * (small + 1)
    later = F.floor((key - edge) / F.lit(float(max(small, 1)))) + extra
    return F.when(key < edge, F.floor(key / F.lit(float(small + 1)))).otherwise(later).cast("long")
