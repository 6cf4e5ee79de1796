"""Train, validation and test splits, folds and class balance, drawn by row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.math import hash_uniform
from siftpool.operators.rank import global_rank


def shuffled(df: DataFrame, key: str, out: str = "_at", seed: int = 0) -> DataFrame:
    """df with each row's place, from 0, in a random order of the key."""
    return global_rank(df, [hash_uniform(F.col(key), seed), F.col(key)], out, start=0)


def random_split(df: DataFrame, key: str, sizes: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """df with split train, val or test of int(share * n) rows each, the rest in test."""
    n = df.count()
    a = int(sizes[0] * n)
    b = int((sizes[0] + sizes[1]) * n)
    at = F.col("_at")
    return shuffled(df, key, seed=seed).withColumn("split", F.when(at < a, "train").when(at < b, "val").otherwise("test")).drop("_at")


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """df with fold 0 to k - 1, sizes one apart at most."""
    return shuffled(df, key, seed=seed).withColumn("fold", (F.col("_at") % k).cast("int")).drop("_at")


def cross_validation(df: DataFrame, key: str, k: int, turn: int, seed: int = 0) -> DataFrame:
    """df with split: fold turn mod k is test, the next one val, all others train."""
    f = F.col("fold")
    return folds(df, key, k, seed).withColumn("split", F.when(f == turn % k, "test").when(f == (turn + 1) % k, "val").otherwise("train"))


def predetermined(df: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """df with split from a table (key, split); rows without an entry train."""
    return df.join(assigned.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def hold_out(df: DataFrame, key: str, share: int = 5, seed: int = 0) -> DataFrame:
    """df with held_out true for max(1, n // share) rows."""
    n = df.count()
    return shuffled(df, key, seed=seed).withColumn("held_out", F.col("_at") < max(1, n // share)).drop("_at")


def two_way(df: DataFrame, key: str, val: float, seed: int = 0) -> DataFrame:
    """df with split train for int((1 - val) * n) rows and val for the others."""
    n = df.count()
    return shuffled(df, key, seed=seed).withColumn("split", F.when(F.col("_at") < int((1 - val) * n), "train").otherwise("val")).drop("_at")


def class_balanced(df: DataFrame, positive: Column, key: str, seed: int = 0) -> DataFrame:
    """As many rows of either class, interleaved by place: two for each place up to the smaller class."""
    marked = df.withColumn("_p", positive.cast("int")).filter("_p IS NOT NULL")
    ones = global_rank(marked.filter("_p = 1"), [hash_uniform(F.col(key), seed), F.col(key)], "place", start=0)
    rest = global_rank(marked.filter("_p = 0"), [hash_uniform(F.col(key), seed), F.col(key)], "place", start=0)
    n = marked.agg(F.least(F.sum("_p"), F.sum(1 - F.col("_p"))).alias("n")).first()["n"] or 0
    return ones.unionByName(rest).filter(F.col("place") < n).withColumn("place", F.col("place") * 2 + 1 - F.col("_p")).drop("_p")


def joined_back(df: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Rows of df with their split from a table (key, split); of repeated keys in df the last row by all columns stands for the key."""
    last = df.groupBy(key).agg(F.max(F.struct(*df.columns)).alias("_row")).select("_row.*")
    return last.join(splits.select(key, "split"), key)
