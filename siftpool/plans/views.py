"""Roles of the supplied tables: pool, predictions, explored rows; each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.functions.math import hash_uniform



def u(seed: int = 0, first: int = 1) -> str:
    """The uniform draw of row_idx in SQL, as functions.math has it."""
    return f"(CAST('0x' || substr(md5(CAST(row_idx AS VARCHAR) || '/{seed}'), {first}, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


U = u()
NORMAL = f"(sqrt(-2.0 * ln(1.0 - {U})) * cos(2 * pi() * {u(0, 14)}))"

POOL = "pool AS (SELECT p_partkey AS row_idx, p_name AS id, p_retailprice AS score, p_brand AS stratum FROM part)"
PREDS = """preds AS (
    SELECT l_partkey AS row_idx, n, CAST(s1 AS DOUBLE) / (CAST(n AS DOUBLE) * 100) AS mu,
           CAST(n * s2 - s1 * s1 AS DOUBLE) / (CAST(n AS DOUBLE) * CAST(n AS DOUBLE) * 10000) AS var,
           CAST(d AS DOUBLE) / (CAST(n AS DOUBLE) * 100) AS cost, CAST(q AS DOUBLE) / CAST(n AS DOUBLE) AS vol
    FROM (SELECT l_partkey, count(*) AS n, sum(c) AS s1, sum(c * c) AS s2, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, sum(CAST(l_quantity AS BIGINT)) AS q
          FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) GROUP BY l_partkey))"""
EXPLORED = f"explored AS (SELECT *, row_idx AS acq_order FROM pool WHERE {U} < 0.05)"
FAILED = f"failed AS (SELECT row_idx, id, stratum, row_idx AS acq_order, CASE WHEN row_idx % 7 <> 0 THEN -score END AS score FROM pool WHERE {U} < 0.05)"


def phi(z: str) -> str:
    """Normal distribution function in SQL, by the approximation of functions.math."""
    t = f"(1.0 / (1.0 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    tail = f"(0.5 * {poly} * exp(-({z}) * ({z}) / 2.0))"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("id"), F.col("p_retailprice").alias("score"), F.col("p_brand").alias("stratum"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of each part from its order lines; sums are over whole cents, so they do not depend on their order."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    wide = "decimal(19,0)"
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row_idx")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cents).alias("s1"),
        F.sum(cents * cents).alias("s2"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"),
        F.sum(F.col("l_quantity").cast("long")).alias("q"),
    )
    n = F.col("n").cast("double")
    square = F.col("n").cast("decimal(15,0)") * F.col("s2").cast(wide) - F.col("s1").cast("decimal(18,0)") * F.col("s1").cast("decimal(18,0)")
    return sums.select("row_idx", "n", (F.col("s1").cast("double") / (n * 100.0)).alias("mu"), (square.cast("double") / (n * n * 10000.0)).alias("var"), (F.col("d").cast("double") / (n * 100.0)).alias("cost"), (F.col("q").cast("double") / n).alias("vol"))


def is_explored(share: float = 0.05) -> Column:
    return hash_uniform(F.col("row_idx")) < share


def explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).filter(is_explored()).withColumn("acq_order", F.col("row_idx"))


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explored rows as scores to maximise, with some failures."""
    return explored(spark, sf_dir).withColumn("score", F.when(F.col("row_idx") % 7 != 0, -F.col("score")))
