"""Evaluation: recall, averages, regression, classification, calibration and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftpool.functions.math import sigmoid
from siftpool.operators.rank import running_sums


def recall(explored: DataFrame, truth: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """One row: distinct ids of truth that were explored, and their share of k."""
    hits = explored.select(id_col).distinct().join(truth.select(id_col).distinct(), id_col, "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("hits")).withColumn("recall", F.col("hits") / F.lit(float(k)))


def top_rate(explored: DataFrame, truth: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """One row: hits among the explored ids, and their share of k, or of the explored ids if those are fewer."""
    own = explored.select(id_col).distinct()
    n = own.agg(F.count(F.lit(1)).alias("n"))
    hits = own.join(truth.select(id_col).distinct(), id_col, "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(n).select("hits", (F.col("hits") / F.nullif(F.least(F.col("n"), F.lit(k)), F.lit(0)).cast("double")).alias("rate"))


def best(explored: DataFrame) -> DataFrame:
    return explored.agg(F.min("score").alias("best_score"))


def top_average(explored: DataFrame, k: int, order: str = "acq_order") -> DataFrame:
    """Mean of the k best scores; failures count 0 and k is at most the number of rows."""
    chosen = explored.orderBy(F.col("score").desc_nulls_last(), order).limit(k)
    return chosen.agg((F.sum(F.coalesce("score", F.lit(0.0))) / F.count(F.lit(1))).alias("topk_avg"), F.count(F.lit(1)).alias("n"))


def batch_average(new: DataFrame) -> DataFrame:
    """Mean of the scores that did not fail, null if all did."""
    return new.agg(F.avg("score").alias("batch_avg"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """rmse, mse, mae and r2 of p against y."""
    e = F.col(y) - F.col(p)
    s = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    return s.select(F.sqrt("mse").alias("rmse"), "mse", "mae", (1.0 - F.col("mse") / F.col("v")).alias("r2"))


def classification(df: DataFrame, y: str, score: str, key: str, cut: float = 0.5) -> DataFrame:
    """accuracy, auc (rank sum; tied scores share their mean rank), log_loss of a probability against 0/1, and pr_auc; one row.

    pr_auc is the average precision: over distinct scores from the largest, the
    precision so far times the gain in recall. Scores are counted first, so a
    frequent one is one row where they are sorted.
    """
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))
    plain = df.agg(F.avg(((F.col(score) >= cut).cast("int") == F.col(y)).cast("double")).alias("accuracy"), F.sum(F.col(y).cast("double")).alias("n1"), F.sum((1 - F.col(y)).cast("double")).alias("n0"), F.avg(loss).alias("log_loss"))
    counts = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("long")).alias("_p"))
    at = running_sums(counts, [F.col("_s").desc()], {"_n": "_above", "_p": "_hits"})
    # Of the rows at a score, their ones beat all zeros below and half of those at the score.
    sums = at.crossJoin(F.broadcast(plain)).agg(
        F.sum(F.col("_p") * (F.col("n0") - (F.col("_above") - F.col("_hits")) - (F.col("_n") - F.col("_p")) / 2.0)).alias("won"),
        F.sum(F.col("_p") / F.col("n1") * (F.col("_hits") + F.col("_p")) / (F.col("_above") + F.col("_n"))).alias("pr_auc"),
    )
    out = plain.crossJoin(F.broadcast(sums))
    return out.select("accuracy", (F.col("won") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0.0))).alias("auc"), "log_loss", "pr_auc")


def cross_entropy(label: Column, shares: Column) -> Column:
    """Minus the logarithm of the share that an array gives the label, classes from 0; the loss is its mean."""
    return -F.log(F.greatest(F.element_at(shares, label.cast("int") + 1), F.lit(1e-15)))


def multitask(df: DataFrame, targets: dict[str, str], pred: str) -> DataFrame:
    """For each task, rows with a target, mse and accuracy; the target's column may be null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(c).cast("double").alias("y")) for t, c in targets.items()])).alias("_t")
    rows = df.select(pairs, F.col(pred).alias("p")).select("_t.*", "p").filter("y IS NOT NULL")
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("mse"), F.avg(((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("double")).alias("accuracy"))


def class_sizes(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """For each task the share of ones among its targets, null if it has none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(c).cast("double").alias("y")) for t, c in targets.items()])).alias("_t")
    return df.select(pairs).select("_t.*").groupBy("task").agg(F.avg("y").alias("positive_share"), F.count("y").alias("n"))


def gaussian_nll(y: Column, mu: Column, var: Column, least: float = 1e-5) -> Column:
    """Half of log v + (y - mu)^2 / v, with v at least `least`."""
    v = F.greatest(var, F.lit(least))
    return 0.5 * (F.log(v) + (mu - y) * (mu - y) / v)


def soft_ranks(df: DataFrame, key: str, value: str, scale: float, size: int = 200) -> DataFrame:
    """Each row's smooth rank in its batch: the sum over the batch of the sigmoid of scaled differences.

    A batch has the rows of `size` consecutive integer keys, so what is paired is
    bounded whatever the input's size. Keys are distinct; null values have and give no rank.
    """
    batch = F.floor(F.col(key) / size)
    own = F.struct(F.col(key).alias("k"), F.col(value).alias("x"))
    held = df.filter(F.col(value).isNotNull()).groupBy(batch.alias("_batch")).agg(F.collect_list(own).alias("_all"))
    part = held.select("_all", F.explode("_all").alias("_own"))
    rank = F.aggregate("_all", F.lit(0.0), lambda total, other: total + sigmoid((F.col("_own.x") - other["x"]) / scale))
    return part.select(F.col("_own.k").alias(key), rank.alias("soft_rank"))


def soft_spearman(df: DataFrame, key: str, a: str, b: str, scale: float, size: int = 200) -> DataFrame:
    """(batch, rho, n): the correlation of a batch's soft ranks of two columns."""
    ra, rb = soft_ranks(df, key, a, scale, size), soft_ranks(df, key, b, scale, size)
    both = ra.join(rb.withColumnRenamed("soft_rank", "_b"), key)
    return both.groupBy(F.floor(F.col(key) / size).alias("batch")).agg(F.corr("soft_rank", "_b").alias("rho"), F.count(F.lit(1)).alias("n"))


def ranking_loss(df: DataFrame, key: str, y: str, mu: str, var: str, scale: float, size: int = 200, weight: float = 0.1) -> DataFrame:
    """(batch, loss): the mean Gaussian loss of a batch plus `weight` times one minus its soft rank correlation."""
    rho = soft_spearman(df, key, mu, y, scale, size)
    nll = df.groupBy(F.floor(F.col(key) / size).alias("batch")).agg(F.avg(gaussian_nll(F.col(y), F.col(mu), F.col(var))).alias("_nll"))
    return nll.join(rho, "batch").select("batch", (F.col("_nll") + weight * (1.0 - F.col("rho"))).alias("loss"))


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with <c>_mean and <c>_std (population) of each column; a missing mean is 0, a missing or zero deviation 1."""
    aggs = []
    for c in columns:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None))
        aggs += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.nullif(F.stddev_pop(v), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std")]
    return df.agg(*aggs)


def standardise(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """df with <c>_z for each column; missing values become `fill`."""
    out = df.crossJoin(F.broadcast(scaler(df, columns)))
    for c in columns:
        out = out.withColumn(f"{c}_z", F.coalesce((F.nanvl(F.col(c).cast("double"), F.lit(None)) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), F.lit(fill)))
    return out.drop(*[f"{c}_{k}" for c in columns for k in ("mean", "std")])


def unscaled(df: DataFrame, scales: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of standardise: <c>_back from <c>_z and one row of scaler()."""
    out = df.crossJoin(F.broadcast(scales))
    for c in columns:
        out = out.withColumn(f"{c}_back", F.col(f"{c}_z") * F.col(f"{c}_std") + F.col(f"{c}_mean"))
    return out.drop(*scales.columns)


def quality_rules(df: DataFrame, id_col: str, targets: dict[str, str], binary: bool = True) -> DataFrame:
    """(rule, violations) of a target table."""
    bad = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    rules = {"id_missing": bad(F.col(id_col).isNull() | (F.col(id_col).cast("string") == "")), "no_target": bad(F.coalesce(*[F.col(c).cast("double") for c in targets.values()]).isNull())}
    for t, c in targets.items():
        rules[f"{t}_missing"] = bad(F.col(c).isNull())
        rules[f"{t}_constant"] = (F.count_distinct(c) < 2).cast("long")
        if binary:
            rules[f"{t}_not_binary"] = bad(F.coalesce(~F.col(c).isin(0, 1), F.lit(False)))
    rules["id_repeated"] = (F.count(id_col) - F.count_distinct(id_col)).cast("long")
    one = df.agg(*[v.alias(k) for k, v in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("r")).select("r.*")


def moving_average_stop(rounds: DataFrame, window: int, delta: float, order: str = "iter", value: str = "topk_avg") -> DataFrame:
    """rounds with the moving average over the last `window` values and whether the relative gain over it is at most delta.

    The relative gain keeps the sign of its denominator, so for negative averages
    the test turns round. A round has no verdict before `window` values exist.
    rounds is a history: its size is the number of rounds.
    """
    w = Window.orderBy(order)
    out = rounds.withColumn("sma", F.avg(value).over(w.rowsBetween(-(window - 1), 0))).withColumn("_n", F.row_number().over(w))
    gain = (F.col(value) - F.col("sma")) / F.nullif(F.col("sma"), F.lit(0.0))
    return out.withColumn("stop", (F.col("_n") >= window) & F.coalesce(gain <= delta, F.lit(False))).drop("_n")


def history(per_round: DataFrame, k: int) -> DataFrame:
    """Cumulative labelled rows, best score so far and recall so far from (round, n, best, hits); a row for each round."""
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return per_round.select("round", F.sum("n").over(w).alias("n_labeled"), F.min("best").over(w).alias("best_score"), (F.sum("hits").over(w) / F.lit(float(k))).alias("topk_recall"))
