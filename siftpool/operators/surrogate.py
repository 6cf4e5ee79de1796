"""Surrogate models as aggregates: sums go to the driver, rows never do."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftpool.functions.math import hash_uniform


def normal_sums(df: DataFrame, xs: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """n and the sums of products of (1, xs..., y), for each group of `by`."""
    names = [*xs, y]
    cols = [F.col(c).cast("double") for c in names]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)]]
    sums += [F.sum(cols[i] * cols[j]).alias(f"s_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*(by or [])).agg(*sums)


def solve(row: dict, p: int, ridge: float = 0.0) -> np.ndarray:
    """Intercept and weights from a row of normal_sums; the intercept is not penalised. Zeros if there are no rows."""
    if not row["n"]:
        return np.zeros(p + 1)
    n = float(row["n"])
    mean, top = np.array([row[f"s_{i}"] for i in range(p)]) / n, row[f"s_{p}"] / n
    cover = np.array([[row[f"s_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]).reshape(p, p) - n * np.outer(mean, mean) + ridge * np.eye(p)
    slope = np.array([row[f"s_{i}_{p}"] for i in range(p)]) - n * mean * top
    # Columns of all sizes: the system is solved in units of their own deviations.
    unit = np.sqrt(np.maximum(np.diag(cover), 0.0))
    unit[unit == 0] = 1.0
    w = np.linalg.lstsq(cover / np.outer(unit, unit), slope / unit, rcond=None)[0] / unit
    return np.append(top - w @ mean, w)


def linear(xs: list[str], w: np.ndarray) -> Column:
    out = F.lit(float(w[0]))
    for x, v in zip(xs, w[1:], strict=True):
        out = out + F.col(x) * float(v)
    return out


def fit_ridge(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0) -> np.ndarray:
    return solve(normal_sums(df, xs, y).first().asDict(), len(xs), ridge)


def stack(df: DataFrame, train: Column, xs: list[str], y: str, ridge: float = 0.0, out: str = "mu") -> DataFrame:
    """Learned fusion: weights of the members from the rows marked by `train`; without such rows the members' mean."""
    row = normal_sums(df.filter(train), xs, y).first().asDict()
    fused = linear(xs, solve(row, len(xs), ridge)) if row["n"] else sum((F.col(x) for x in xs[1:]), F.col(xs[0])) / float(len(xs))
    return df.withColumn(out, fused).withColumn("var", F.lit(0.0))


def out_of_fold(df: DataFrame, fold: str, k: int, x: str, y: str, out: str) -> DataFrame:
    """df with each row's prediction by the line that the other folds' rows give."""
    sums = {r[fold]: r.asDict() for r in normal_sums(df, [x], y, [fold]).collect()}  # k rows
    cases = F.lit(None).cast("double")
    for f in range(k):
        rest = [s for g, s in sums.items() if g != f]
        total = {c: sum(s[c] for s in rest) for c in ("n", "s_0", "s_1", "s_0_0", "s_0_1", "s_1_1")}
        cases = F.when(F.col(fold) == f, linear([x], solve(total, 1))).otherwise(cases)
    return df.withColumn(out, cases)


def vector_sums(df: DataFrame, vector: str, y: str, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Gram matrix with an intercept, X'y and n, summed in Arrow batches to one matrix a task."""
    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        g, b, n = np.zeros((dim + 1, dim + 1)), np.zeros(dim + 1), 0
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.ones(batch.num_rows), np.array(batch[0].to_pylist(), float)])
                t = np.array(batch[1].to_pylist(), float)
                g += x.T @ x
                b += x.T @ t
                n += len(t)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((dim + 1) ** 2 + dim + 2)), pa.array(np.concatenate([g.ravel(), b, [n]]))], ["i", "v"])

    rows = df.filter(F.col(y).isNotNull()).select(vector, F.col(y).cast("double").alias("y")).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    v = np.array([r["v"] for r in rows]) if rows else np.zeros((dim + 1) ** 2 + dim + 2)
    return v[: (dim + 1) ** 2].reshape(dim + 1, dim + 1), v[(dim + 1) ** 2 : -1], int(v[-1])


def ridge_vectors(df: DataFrame, vector: str, y: str, dim: int, ridge: float = 1.0) -> DataFrame:
    """df with mu and var: a ridge regression on the vectors and its Bayesian predictive variance (a dot-product kernel's Gaussian process)."""
    g, b, n = vector_sums(df, vector, y, dim)
    penalty = ridge * np.eye(dim + 1)
    w = np.linalg.solve(g + penalty, b)
    cover = np.linalg.inv(g + penalty)
    weights = F.array(*[F.lit(float(v)) for v in w[1:]])
    from siftpool.functions.vector import dot

    scored = df.withColumn("mu", dot(F.col(vector), weights) + float(w[0]))
    noise = scored.filter(F.col(y).isNotNull()).agg(F.avg((F.col(y) - F.col("mu")) * (F.col(y) - F.col("mu"))).alias("s2"))
    root = np.linalg.cholesky(cover)
    x = F.concat(F.array(F.lit(1.0)), F.transform(vector, lambda v: v.cast("double")))
    spread = F.lit(0.0)
    parts = [dot(x, F.array(*[F.lit(float(v)) for v in root[:, j]])) for j in range(dim + 1)]
    spread = F.aggregate(F.array(*parts), F.lit(0.0), lambda s, v: s + v * v)
    return scored.crossJoin(F.broadcast(noise)).withColumn("var", F.col("s2") * (1.0 + spread)).drop("s2")


def forest(df: DataFrame, vector: str, y: str, trees: int = 20, depth: int = 5, seed: int = 0) -> DataFrame:
    """df with mu and var, the mean and population variance over a random forest's trees."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    ready = df.withColumn("_x", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    model = RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed).fit(ready.filter(F.col(y).isNotNull()))
    out = ready
    for i, t in enumerate(model.trees):
        out = t.setFeaturesCol("_x").setPredictionCol(f"_t{i}").transform(out)
    values = F.array(*[F.col(f"_t{i}") for i in range(trees)])
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / float(trees)
    out = out.withColumn("mu", mean)
    var = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - F.col("mu")) * (v - F.col("mu"))) / float(trees)
    return out.withColumn("var", var).drop("_x", *[f"_t{i}" for i in range(trees)])


def boosted(df: DataFrame, vector: str, y: str, rounds: int = 20, seed: int = 0) -> DataFrame:
    """df with mu, the full prediction of gradient-boosted trees."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    ready = df.withColumn("_x", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    model = GBTRegressor(featuresCol="_x", labelCol=y, maxIter=rounds, seed=seed, predictionCol="mu").fit(ready.filter(F.col(y).isNotNull()))
    return model.transform(ready).drop("_x")


def bagged(df: DataFrame, key: str, xs: list[str], y: str, members: int = 5) -> DataFrame:
    """df with mu and var over lines fitted to random halves of the rows."""
    outs = []
    for m in range(members):
        part = df.filter(hash_uniform(F.col(key), m) < 0.5)
        outs.append(linear(xs, fit_ridge(part, xs, y)))
    mean = sum(outs[1:], outs[0]) / float(members)
    out = df.withColumn("mu", mean)
    var = sum(((o - F.col("mu")) * (o - F.col("mu")) for o in outs[1:]), (outs[0] - F.col("mu")) * (outs[0] - F.col("mu"))) / float(members)
    return out.withColumn("var", var)


def member_mean_var(df: DataFrame, key: str, value: str) -> DataFrame:
    """mu, var over members (population) and var_samp over passes, for each key."""
    return df.groupBy(key).agg(F.avg(value).alias("mu"), F.var_pop(value).alias("var"), F.var_samp(value).alias("var_samp"))


def normalise(df: DataFrame, y: str) -> DataFrame:
    """df with y_norm, y_mean and y_std (population, plus 1e-8)."""
    s = df.agg(F.avg(y).alias("y_mean"), (F.stddev_pop(y) + 1e-8).alias("y_std"))
    return df.crossJoin(F.broadcast(s)).withColumn("y_norm", (F.col(y) - F.col("y_mean")) / F.col("y_std"))


def denormalise(mu: Column, var: Column, mean: Column, std: Column, rescale_var: bool = True) -> tuple[Column, Column]:
    """Predictions in the target's own units; rescale_var=False leaves the variance in standard units."""
    return mu * std + mean, var * std * std if rescale_var else var


def map_batches(df: DataFrame, columns: list[str], load: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply an external model: load() gives a function from a pandas frame to a pandas frame, once in each task."""

    def run(batches):  # noqa: ANN001, ANN202
        model = load()
        for b in batches:
            yield model(b)

    return df.select(*columns).mapInPandas(run, schema)


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 0) -> DataFrame:
    """df with cluster_id by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("_x", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster_id").fit(ready).transform(ready).drop("_x")


def centroids(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """The mean vector of each group."""
    return df.groupBy(group).agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dim)]).alias("centroid"))


def assign(df: DataFrame, centres: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(key, group, d2): the nearest centre of each row, the least group of equally near ones; no row is moved.

    centres have a row for each of a bounded number of groups and go to all tasks
    as one array.
    """
    from siftpool.functions.vector import squared_distance

    held = centres.agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), "centroid"))).alias("_centres"))
    own = F.transform(vector, lambda v: v.cast("double"))
    near = F.array_min(F.transform("_centres", lambda c: F.struct(F.round(squared_distance(own, c["centroid"]), 9).alias("d2"), c["g"].alias("g"))))
    return df.select(key, vector).crossJoin(F.broadcast(held)).withColumn("_m", near).select(key, F.col("_m.g").alias(group), F.col("_m.d2").alias("d2"))


#: The grid of ridge penalties of learned fusion.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def ridge_cv(df: DataFrame, xs: list[str], y: str, alphas: tuple[float, ...] = ALPHAS) -> tuple[np.ndarray, float]:
    """Weights with the intercept first, and the penalty with the least mean squared leave-one-out error.

    Two passes over df: sums of products, then every penalty's errors at once,
    each from a row's residual and leverage.
    """
    sums = normal_sums(df, xs, y).first().asDict()
    if not sums["n"]:
        return np.zeros(len(xs) + 1), alphas[0]
    p, n = len(xs), float(sums["n"])
    mean = np.array([sums[f"s_{i}"] for i in range(p)]) / n
    cover = np.array([[sums[f"s_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) - n * np.outer(mean, mean)
    errors = []
    for k, alpha in enumerate(alphas):
        inverse = np.linalg.pinv(cover + alpha * np.eye(p))
        off = [F.col(x).cast("double") - float(m) for x, m in zip(xs, mean, strict=True)]
        leverage = F.lit(1.0 / n)
        for i in range(p):
            for j in range(p):
                leverage = leverage + off[i] * off[j] * float(inverse[i, j])
        left = (F.col(y) - linear(xs, solve(sums, p, alpha))) / (1.0 - leverage)
        errors.append(F.avg(left * left).alias(f"e{k}"))
    found = df.agg(*errors).first()
    best = min(range(len(alphas)), key=lambda k: (np.inf if found[k] is None else found[k], k))
    return solve(sums, p, alphas[best]), alphas[best]


def stack_cv(df: DataFrame, train: Column, xs: list[str], y: str, out: str = "mu") -> DataFrame:
    """Learned fusion with the penalty chosen from ALPHAS on the rows marked by `train`; without such rows the members' mean."""
    rows = df.filter(train)
    if rows.isEmpty():
        return stack(df, train, xs, y, out=out)
    return df.withColumn(out, linear(xs, ridge_cv(rows, xs, y)[0])).withColumn("var", F.lit(0.0))


def stack_out_of_fold(df: DataFrame, fold: str, k: int, xs: list[str], y: str, ridge: float = 0.0, out: str = "mu") -> DataFrame:
    """Out-of-fold stacking: one line for each member; the fusion learns from their out-of-fold predictions; the lines are then fitted to all rows."""
    inner = df
    for i, x in enumerate(xs):
        inner = out_of_fold(inner, fold, k, x, y, f"_o{i}")
    weights = fit_ridge(inner, [f"_o{i}" for i in range(len(xs))], y, ridge)
    full = df
    for i, x in enumerate(xs):
        full = full.withColumn(f"_f{i}", linear([x], fit_ridge(df, [x], y)))
    return full.withColumn(out, linear([f"_f{i}" for i in range(len(xs))], weights)).withColumn("var", F.lit(0.0)).drop(*[f"_f{i}" for i in range(len(xs))])


def fuse_softmax(df: DataFrame, xs: list[str], logits: list[float], out: str = "mu") -> DataFrame:
    """Members' means weighed by the softmax of fixed logits."""
    shares = np.exp(np.array(logits) - max(logits))
    shares /= shares.sum()
    return df.withColumn(out, sum((F.col(x) * float(s) for x, s in zip(xs[1:], shares[1:], strict=True)), F.col(xs[0]) * float(shares[0])))


def random_model(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df with mu and var drawn from [0, 1): the model that knows nothing."""
    return df.withColumn("mu", hash_uniform(F.col(key), seed)).withColumn("var", hash_uniform(F.col(key), seed + 1))


#: Models by name, and whether they give variances.
MODELS: dict[str, tuple[Callable, bool]] = {"random": (random_model, True), "rf": (forest, True), "gbt": (boosted, False), "ridge": (ridge_vectors, True), "bagged": (bagged, True), "fusion": (stack_cv, False), "oof": (stack_out_of_fold, False)}


def model(name: str) -> Callable:
    """The model's function; ValueError for an unknown name."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name][0]
