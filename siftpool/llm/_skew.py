"""Joins that hold when one key has a third of the rows, and that move few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/SHARES of the rows is dealt over several tasks; there are fewer than SHARES such keys.
SHARES = 500
#: Bits of the table that probable() broadcasts: 64 in a row, so at most 2**18 rows of 12 bytes whatever the input.
BITS = 24


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: Column,
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join left (any skew) with right (few rows for a key) on the columns `on`.

    Keys that hold more than 1/SHARES of left's rows get ceil(share * SHARES)
    salts: left rows draw one from `spread`, right rows are repeated once for
    each salt. The table of hot keys has under SHARES rows whatever the input's
    size, so it is safe to broadcast. `counts` (on, n) saves counting left's
    keys. Keys must not be null. Left should be cheap to read twice.
    """
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(total / SHARES, 64)).select(
        *on, F.ceil(F.col("n") * SHARES / F.lit(max(total, 1))).cast("int").alias("_fan")
    )
    hot = F.broadcast(hot)
    dealt = left.join(hot, on, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_fan")).cast("int"), F.lit(0))
    )
    copies = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1))
    )
    return dealt.drop("_fan").join(copies.drop("_fan"), [*on, "_salt"], how).drop("_salt")


def probable(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """rows with `_maybe`: false only where the 64-bit key is none of wanted's (its one column, not null).

    Rows marked false need no join with the wanted keys and so no shuffle; the
    others, true ones and a share of false ones that grows with the number of
    keys, still need the exact join. The table behind it has one bit for each of
    2**BITS hashes, so its size has a bound.
    """
    spot = F.pmod(F.col("_h"), F.lit(1 << BITS))
    held = wanted.toDF("_h").select(F.shiftright(spot, 6).alias("_word"), F.expr(f"shiftleft(1L, CAST(pmod(_h, {1 << BITS}) & 63 AS INT))").alias("_bit"))
    words = held.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_h", key).withColumn("_word", F.shiftright(spot, 6)).join(F.broadcast(words), "_word", "left")
    hit = F.expr(f"bit_get(_bits, CAST(pmod(_h, {1 << BITS}) & 63 AS INT)) = 1")
    return marked.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_h", "_word", "_bits")
