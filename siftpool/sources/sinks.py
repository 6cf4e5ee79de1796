"""Results and per-round state, written with the counts and schemas they must have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.sources import state


def write_scores(df: DataFrame, path: str, final: bool, ascending: bool = False) -> None:
    """CSV parts of (id, score), whose names sort as their rows do: by score, best first and failures last, if final; else in the order of acquisition.

    ascending: the least score is the best.
    """
    best = F.col("score").asc_nulls_last() if ascending else F.col("score").desc_nulls_last()
    order = [best, F.col("acq_order")] if final else [F.col("acq_order")]
    df.orderBy(*order).select("id", "score").write.mode("overwrite").csv(path, header=True)


def write_history(df: DataFrame, path: str) -> None:
    """Round records as JSON lines in one file."""
    df.orderBy("round").coalesce(1).write.mode("overwrite").json(path)


def write_round(df: DataFrame, root: str, number: int) -> None:
    """The state after a round; its _SUCCESS mark is written last, so a torn round is not resumed from."""
    df.write.mode("overwrite").parquet(f"{root}/round={number}")


def write_checked(df: DataFrame, path: str, rows: int, dim: int | None = None, vector: str | None = None) -> None:
    """Parquet, refused unless df has so many rows and, if given, vectors of that length only."""
    bad = F.sum((F.size(vector) != dim).cast("long")) if vector and dim is not None else F.lit(0)
    found = df.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).first()
    if found["n"] != rows or found["bad"]:
        raise ValueError(f"{found['n']} rows for {rows}, {found['bad'] or 0} of another dimension")
    df.write.mode("overwrite").parquet(path)


def write_chunk(df: DataFrame, root: str, chunk: int) -> None:
    """One chunk of a chunked table; other chunks stay."""
    df.write.mode("overwrite").parquet(f"{root}/chunk_id={chunk}")


def write_slice(df: DataFrame, root: str, chunk: int, start: int, end: int, dim: int, key: str = "row_idx", vector: str = "vector") -> None:
    """One chunk, refused unless it has the rows start to end, exclusive, once each, and vectors of that length only."""
    found = df.agg(F.count_distinct(key).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum((F.size(vector) != dim).cast("long")).alias("bad")).first()
    if (found["n"], found["rows"]) != (end - start, end - start) or found["bad"] or (found["n"] and (found["lo"], found["hi"]) != (start, end - 1)):
        raise ValueError(f"{found['rows']} rows from {found['lo']} to {found['hi']} for {start} to {end - 1}, {found['bad'] or 0} of another dimension")
    write_chunk(df, root, chunk)


def prepare(spark: SparkSession, root: str, rows: int, dim: int) -> bool:
    """Note the size of a chunked table in its folder; False if that was done before, ValueError if it has another size."""
    path = f"{root}/_shape"
    if state.exists(spark, path):
        known = spark.read.json(path, schema="rows long, dim long").first()
        if (known["rows"], known["dim"]) != (rows, dim):
            raise ValueError(f"the table has {known['rows']} rows of {known['dim']}, not {rows} of {dim}")
        return False
    spark.createDataFrame([(rows, dim)], "rows long, dim long").coalesce(1).write.json(path)
    return True


def save_snapshot(df: DataFrame, root: str) -> None:
    """Replace the snapshot: the new one is written beside it and renamed when it is whole."""
    df.write.mode("overwrite").parquet(f"{root}/_next")
    state.move(df.sparkSession, f"{root}/_next", f"{root}/snapshot")


def load_snapshot(spark: SparkSession, root: str, fallback: str) -> DataFrame:
    """The snapshot, or what the fallback holds if there is none."""
    whole = f"{root}/snapshot"
    return spark.read.parquet(whole if state.exists(spark, f"{whole}/_SUCCESS") else fallback)


def merge_shards(shards: list[DataFrame], key: str) -> DataFrame:
    """Rows of key-value shards, a later shard's in place of an earlier one's, sorted by key."""
    whole = shards[0].withColumn("_shard", F.lit(0))
    for i, s in enumerate(shards[1:], 1):
        whole = whole.unionByName(s.withColumn("_shard", F.lit(i)))
    last = whole.groupBy(key).agg(F.max(F.struct("_shard", *shards[0].columns)).alias("_row"))
    return last.select(*[F.col(f"_row.{c}").alias(c) for c in shards[0].columns]).orderBy(key)


def write_splits(df: DataFrame, path: str) -> None:
    """A table with a `split` column, one folder for each split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
