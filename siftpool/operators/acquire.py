"""Acquisition functions: columns (mu, var) to a utility that is maximised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.math import hash_normal, hash_uniform, normal_cdf, normal_pdf

#: What each function reads.
NEEDS: dict[str, frozenset[str]] = {
    "random": frozenset(),
    "threshold": frozenset({"means"}),
    "greedy": frozenset({"means"}),
    "noisy": frozenset({"means"}),
    "ucb": frozenset({"means", "vars"}),
    "lcb": frozenset({"means", "vars"}),
    "thompson": frozenset({"means", "vars"}),
    "ts": frozenset({"means", "vars"}),
    "ei": frozenset({"means", "vars"}),
    "pi": frozenset({"means", "vars"}),
    "borda": frozenset({"means"}),
}


def random(key: Column, seed: int = 0) -> Column:
    return hash_uniform(key, seed)


def threshold(mu: Column, key: Column, least: float, seed: int = 0) -> Column:
    """A random order of rows with mu of at least `least`, all others behind."""
    return F.when(mu >= least, hash_uniform(key, seed)).otherwise(-1.0)


def greedy(mu: Column) -> Column:
    return mu


def noisy(mu: Column, key: Column, spread: Column, seed: int = 0) -> Column:
    """mu with normal noise of the pool's own deviation."""
    return mu + spread * hash_normal(key, seed)


def ucb(mu: Column, var: Column, beta: float = 2.0) -> Column:
    return mu + beta * F.sqrt(var)


def lcb(mu: Column, var: Column, beta: float = 2.0) -> Column:
    return mu - beta * F.sqrt(var)


def thompson(mu: Column, var: Column, key: Column, stochastic: bool = False, seed: int = 0) -> Column:
    """A draw from N(mu, var); mu itself where the model's means are draws already."""
    return mu if stochastic else mu + F.sqrt(var) * hash_normal(key, seed)


def expected_improvement(mu: Column, var: Column, best: Column, xi: float = 0.01) -> Column:
    gain = mu - best + xi
    sigma = F.sqrt(var)
    z = gain / F.when(var > 0, sigma)
    return F.when(var > 0, gain * normal_cdf(z) + sigma * normal_pdf(z)).otherwise(gain)


def probability_of_improvement(mu: Column, var: Column, best: Column, xi: float = 0.01) -> Column:
    gain = mu - best + xi
    z = gain / F.when(var > 0, F.sqrt(var))
    return F.when(var > 0, normal_cdf(z)).otherwise(F.when(gain > 0, 1.0).otherwise(0.0))


def probability_above(mu: Column, var: Column, least: Column) -> Column:
    """The probability that a row's value exceeds a threshold."""
    z = (mu - least) / F.when(var > 0, F.sqrt(var))
    return F.when(var > 0, normal_cdf(z)).otherwise(F.when(mu >= least, 1.0).otherwise(0.0))


def prune(preds: DataFrame, least: Column, p_min: float = 0.025) -> DataFrame:
    """Rows that exceed the threshold with a probability of p_min or more."""
    return preds.filter(probability_above(F.col("mu"), F.col("var"), least) >= p_min)


def utility(name: str, preds: DataFrame, key: str = "row_idx", best: Column | None = None, least: float = 0.0, beta: float = 2.0, xi: float = 0.01, seed: int = 0) -> DataFrame:
    """preds with a column `u` by the function's name; ValueError for an unknown one. Draws differ by seed: pass the round's."""
    from siftpool.operators.rank import global_rank

    k, mu, var = F.col(key), F.col("mu"), F.col("var") if "var" in preds.columns else F.lit(0.0)
    if name == "borda":
        return global_rank(preds, [F.col("mu"), k], "u", start=0)
    if name == "noisy":
        spread = preds.agg(F.stddev_pop("mu").alias("_spread"))
        return preds.crossJoin(F.broadcast(spread)).withColumn("u", noisy(mu, k, F.col("_spread"), seed)).drop("_spread")
    made: dict[str, Callable[[], Column]] = {
        "random": lambda: random(k, seed),
        "threshold": lambda: threshold(mu, k, least, seed),
        "greedy": lambda: greedy(mu),
        "ucb": lambda: ucb(mu, var, beta),
        "lcb": lambda: lcb(mu, var, beta),
        "thompson": lambda: thompson(mu, var, k, seed=seed),
        "ts": lambda: thompson(mu, var, k, seed=seed),
        "ei": lambda: expected_improvement(mu, var, best, xi),
        "pi": lambda: probability_of_improvement(mu, var, best, xi),
    }
    if name not in made:
        raise ValueError(f"unknown acquisition function {name!r}; known: {sorted(NEEDS)}")
    if name in ("ei", "pi") and best is None:
        raise ValueError(f"{name} needs the best value so far")
    return preds.withColumn("u", made[name]())


def compatible(name: str, provides: set[str]) -> bool:
    """Whether a model that provides these serves the function."""
    return not NEEDS[name] - provides
