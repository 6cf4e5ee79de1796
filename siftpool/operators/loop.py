"""The select-label-learn loop: rounds on the driver, rows in Spark, state in Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftpool.operators import metrics, select
from siftpool.operators.surrogate import fit_ridge, linear
from siftpool.sources.ingest import last_complete_round
from siftpool.sources.sinks import write_round
from siftpool.sources.state import materialize


def line_surrogate(features: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A surrogate that fits -score on the features by least squares and adds `u`."""

    def predict(labelled: DataFrame, candidates: DataFrame) -> DataFrame:
        w = fit_ridge(labelled.filter("score IS NOT NULL").withColumn("_y", -F.col("score")), features, "_y")
        return candidates.withColumn("u", F.round(linear(features, w), 6))

    return predict


def run(pool: DataFrame, initial: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame], rounds: int, batch: int, k: int, root: str | None = None, key: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """(labelled rows with their round, a history row for each round) after `rounds` rounds.

    pool has key, id, score and what predict reads; initial has key. Each round
    labels the `batch` best candidates. With a root, each round's labelled rows
    are written there and a later run goes on after the last complete round.
    """
    spark = pool.sparkSession
    truth = materialize(select.true_top(pool, k, key).select("id").distinct(), "truth")
    start = last_complete_round(root) if root else 0
    if start:
        labelled = spark.read.parquet(f"{root}/round={start}").join(pool.select(key), key, "left_semi")
    else:
        labelled = materialize(pool.join(initial.select(key), key, "left_semi").withColumn("round", F.lit(0)), "labelled")
    for turn in range(start + 1, rounds + 1):
        candidates = select.unlabelled(pool, labelled, key)
        chosen = select.top(predict(labelled, candidates), "u", batch, F.col(key)).drop("u").withColumn("round", F.lit(turn))
        labelled = labelled.unionByName(chosen)
        if root:
            write_round(labelled, root, turn)
            labelled = spark.read.parquet(f"{root}/round={turn}")
        else:
            labelled = materialize(labelled, "labelled")
    first = labelled.groupBy("id").agg(F.min("round").alias("round"))
    hits = first.join(truth, "id", "left_semi").groupBy("round").agg(F.count(F.lit(1)).alias("hits"))
    per = labelled.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("best")).join(hits, "round", "left").fillna(0, ["hits"])
    return labelled, metrics.history(per, k)


def explore(pool: DataFrame, initial: DataFrame, predict: Callable, batch: int, k: int, window: int, delta: float, max_rounds: int, key: str = "row_idx", budget: int | None = None) -> DataFrame:
    """Labelled rows of a loop that stops by the moving average of top-k means, or after max_rounds batches.

    It also stops when `budget` rows are labelled, the last batch being cut to
    it, and when the pool is exhausted.
    """
    total = pool.count()
    budget = total if budget is None else min(budget, total)
    averages: list[tuple[int, float]] = []
    labelled = materialize(pool.join(initial.select(key), key, "left_semi").withColumn("round", F.lit(0)), "labelled")
    turn = 0
    while True:
        mean = metrics.top_average(labelled.withColumn("score", -F.col("score")), k, key).first()["topk_avg"]
        averages.append((turn, mean if mean is not None else 0.0))
        rounds = pool.sparkSession.createDataFrame(averages, "iter int, topk_avg double")
        done = labelled.count()
        if turn >= max_rounds or done >= budget or metrics.moving_average_stop(rounds, window, delta).orderBy(F.desc("iter")).first()["stop"]:
            return labelled
        turn += 1
        chosen = select.top(predict(labelled, select.unlabelled(pool, labelled, key)), "u", min(batch, budget - done), F.col(key)).drop("u").withColumn("round", F.lit(turn))
        labelled = materialize(labelled.unionByName(chosen), "labelled")
