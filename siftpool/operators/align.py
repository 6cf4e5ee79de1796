"""Label look-up, key maps and checks that tables belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.math import hash_uniform


def last_row_of(pool: DataFrame, id_col: str = "id", key: str = "row_idx") -> DataFrame:
    """(id, row): an id that stands at several places has its last one."""
    return pool.groupBy(id_col).agg(F.max(key).alias("row"))


def look_up(batch: DataFrame, scores: DataFrame, key: str, minimise: bool = True, strict: bool = False) -> DataFrame:
    """batch with `label`: the score, negated if smaller is better; null if there is none.

    strict: ValueError if any row has no score.
    """
    sign = -1.0 if minimise else 1.0
    out = batch.join(scores.select(key, (F.col("score") * sign).alias("label")), key, "left")
    if strict and not out.filter("label IS NULL").isEmpty():
        raise ValueError("some rows have no score")
    return out


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with new's rows in place of its own where keys meet."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of a and b, and keys that only one of them has."""
    left, right = a.select(key).withColumn("_a", F.lit(1)), b.select(key).withColumn("_b", F.lit(1))
    both = left.join(right, key, "full")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.agg(count(F.col("_a").isNotNull()).alias("n_left"), count(F.col("_b").isNotNull()).alias("n_right"), count(F.col("_b").isNull()).alias("only_left"), count(F.col("_a").isNull()).alias("only_right"))


def must_align(a: DataFrame, b: DataFrame, key: str) -> None:
    """ValueError unless a and b have the same keys."""
    r = report(a, b, key).first()
    if r["only_left"] or r["only_right"]:
        raise ValueError(f"{r['only_left']} keys without a partner, {r['only_right']} the other way")


def stitch(spine: DataFrame, chunks: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """A row for each row of spine; vectors that no chunk holds are zero."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return spine.select(key).join(chunks.select(key, vector), key, "left").withColumn(vector, F.coalesce(F.col(vector), zero))


def resume_stitch(spine: DataFrame, done: DataFrame, chunks: DataFrame, chunk: str, key: str, vector: str, dim: int, partial: bool = False) -> DataFrame:
    """(key, chunk, vector) for all rows of spine (key, chunk): what is done already, then chunks, else zeros.

    Chunks of rows that are done are not read again. Rows that no chunk holds
    raise a ValueError unless `partial`.
    """
    waiting = spine.select(key, chunk).join(done.select(key), key, "left_anti")
    new = waiting.join(chunks.select(key, vector), key, "left")
    if not partial and not new.filter(F.col(vector).isNull()).isEmpty():
        raise ValueError("some rows are in no chunk")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    old = spine.select(key, chunk).join(done.select(key, vector), key)
    return old.unionByName(new.withColumn(vector, F.coalesce(F.col(vector), zero)))


def pending(spine: DataFrame, done: DataFrame, chunk: str) -> DataFrame:
    """Chunks of spine that done (chunk) does not name: what a restarted job still has to do."""
    return spine.select(chunk).distinct().join(done.select(chunk).distinct(), chunk, "left_anti")


def gather_shards(spine: DataFrame, parts: DataFrame, key: str, value: str, shard: str, excluded: list[int] | None = None) -> DataFrame:
    """(key, value) for all rows of spine (key, shard) from what the shards' workers gave; excluded shards get 0.

    ValueError if a row of another shard is missing or given twice.
    """
    out = F.col(shard).isin(excluded) if excluded else F.lit(False)
    given = parts.groupBy(key).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("_n"))
    met = spine.select(key, shard).join(given, key, "left").withColumn("_out", out)
    wrong = met.filter("NOT _out AND coalesce(_n, 0) != 1").count()
    if wrong:
        raise ValueError(f"{wrong} rows were not given once")
    return met.select(key, F.when(F.col("_out"), F.lit(0.0)).otherwise(F.col(value)).alias(value))


def sampled_check(stored: DataFrame, fresh: DataFrame, key: str, value: str, rows: int, seed: int = 0) -> DataFrame:
    """One row: how many of `rows` drawn rows were compared, and how many of them differ between the two tables."""
    drawn = stored.orderBy(hash_uniform(F.col(key), seed), key).limit(rows)
    met = drawn.select(key, F.col(value).alias("_a")).join(fresh.select(key, F.col(value).alias("_b")), key, "left")
    return met.agg(F.count(F.lit(1)).alias("compared"), F.coalesce(F.sum((~F.col("_a").eqNullSafe(F.col("_b"))).cast("long")), F.lit(0)).alias("differ"))


def rows_of(ids: DataFrame, pool: DataFrame, table: DataFrame, id_col: str = "id", key: str = "row_idx") -> DataFrame:
    """Rows of table (key, ...) for ids, by each id's last place in pool; ids that the pool lacks are left out."""
    places = ids.select(id_col).distinct().join(last_row_of(pool, id_col, key).withColumnRenamed("row", key), id_col)
    return places.join(table, key)


def fill_cache(cache: DataFrame, wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The cache with those wanted rows of table that it lacks; only they are read by key."""
    new = wanted.select(key).distinct().join(cache.select(key), key, "left_anti")
    return cache.unionByName(table.join(new, key, "left_semi").select(*cache.columns))


def compacted(df: DataFrame, valid: Column, key: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """(valid rows numbered densely from 0, old numbers of the others)."""
    from siftpool.operators.select import renumbered

    marked = df.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    return renumbered(marked.filter("_valid").drop("_valid"), key), marked.filter("NOT _valid").select(key)


def completeness(spine: DataFrame, chunks: DataFrame, chunk: str, key: str) -> DataFrame:
    """For each chunk: rows expected and found, and whether it is complete."""
    have = chunks.select(key).withColumn("_have", F.lit(1))
    out = spine.select(chunk, key).join(have, key, "left").groupBy(chunk).agg(F.count(F.lit(1)).alias("expected"), F.count("_have").alias("found"))
    return out.withColumn("complete", F.col("expected") == F.col("found"))
