"""Queries of aggregates, evaluation, surrogates and the loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.functions import vector
from siftpool.functions.math import softplus
from siftpool.operators import loop, metrics, select, split, surrogate
from siftpool.plans import views as v
from siftpool.plans.registry import registry

QUERIES, SQL, query = registry()


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return v.preds(spark, d).join(v.pool(spark, d).select("row_idx", "score"), "row_idx")


_SCORED = f"{v.POOL}, {v.PREDS}, scored AS (SELECT p.*, score FROM preds p JOIN pool USING (row_idx))"


@query(f"WITH {v.POOL}, {v.EXPLORED} SELECT min(score) AS best_score, count(*) AS n_positions, count(DISTINCT id) AS n_ids FROM explored")
def labelled_summary(spark: SparkSession, d: str) -> DataFrame:
    e = v.explored(spark, d)
    return metrics.best(e).crossJoin(e.agg(F.count(F.lit(1)).alias("n_positions"), F.count_distinct("id").alias("n_ids")))


@query("SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS mu, round(var_pop(l_quantity), 6) AS var, round(var_samp(l_quantity), 6) AS var_samp FROM lineitem GROUP BY l_partkey")
def ensemble_mean_var(spark: SparkSession, d: str) -> DataFrame:
    out = surrogate.member_mean_var(v.table(spark, d, "lineitem"), "l_partkey", "l_quantity")
    return out.select("l_partkey", *[F.round(c, 6).alias(c) for c in ("mu", "var", "var_samp")])


@query(f"WITH {_SCORED} SELECT row_idx, round((score - (SELECT avg(score) FROM scored)) / (SELECT stddev_pop(score) FROM scored), 6) AS score_z, round(coalesce((CASE WHEN row_idx % 5 <> 0 THEN cost END - (SELECT avg(cost) FROM scored WHERE row_idx % 5 <> 0)) / (SELECT stddev_pop(cost) FROM scored WHERE row_idx % 5 <> 0), 0.0), 6) AS cost_z FROM scored")
def standard_scaler(spark: SparkSession, d: str) -> DataFrame:
    df = _scored(spark, d).withColumn("cost", F.when(F.col("row_idx") % 5 != 0, F.col("cost")))
    return metrics.standardise(df, ["score", "cost"]).select("row_idx", F.round("score_z", 6).alias("score_z"), F.round("cost_z", 6).alias("cost_z"))


@query(f"WITH {_SCORED} SELECT row_idx, round((score - (SELECT avg(score) FROM scored)) / ((SELECT stddev_pop(score) FROM scored) + 1e-8), 6) AS y_norm, round(score, 6) AS back FROM scored")
def target_normalise_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    df = surrogate.normalise(_scored(spark, d), "score")
    back, _ = surrogate.denormalise(F.col("y_norm"), F.lit(0.0), F.col("y_mean"), F.col("y_std"))
    return df.select("row_idx", F.round("y_norm", 6).alias("y_norm"), F.round(back, 6).alias("back"))


@query(f"WITH {v.PREDS} SELECT row_idx, round(ln(1 + exp(-abs(cost * 100 - 5))) + greatest(cost * 100 - 5, 0), 6) AS sp FROM preds")
def softplus_scale(spark: SparkSession, d: str) -> DataFrame:
    return v.preds(spark, d).select("row_idx", F.round(softplus(F.col("cost") * 100 - 5), 6).alias("sp"))


@query(f"WITH {_SCORED}, m AS (SELECT avg(0.5 * (ln(greatest(var, 1e-5)) + (mu - score) * (mu - score) / greatest(var, 1e-5))) AS nll FROM scored) SELECT round(log10(abs(nll)), 8) AS log10_nll, sign(nll) AS sign FROM m")
def loss_gaussian_nll(spark: SparkSession, d: str) -> DataFrame:
    """The mean loss over all parts; parts of one order line have the least variance and make it large, so its logarithm is given."""
    m = _scored(spark, d).agg(F.avg(metrics.gaussian_nll(F.col("score"), F.col("mu"), F.col("var"))).alias("nll"))
    return m.select(F.round(F.log10(F.abs("nll")), 8).alias("log10_nll"), F.signum("nll").cast("int").alias("sign"))


@query(f"WITH {_SCORED}, s AS (SELECT avg((score - mu / 30) * (score - mu / 30)) AS mse, avg(abs(score - mu / 30)) AS mae, var_pop(score) AS v FROM scored) SELECT round(sqrt(mse), 4) AS rmse, round(mse, 2) AS mse, round(mae, 4) AS mae, round(1 - mse / v, 6) AS r2 FROM s")
def metric_regression(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.regression(_scored(spark, d).withColumn("p", F.col("mu") / 30), "score", "p")
    return m.select(F.round("rmse", 4).alias("rmse"), F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


_CLASS = "c AS (SELECT doc_id, quality AS y, 1.0::DOUBLE - 1.0::DOUBLE / (2 + n_chars % 100) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"""WITH {_CLASS}, r AS (SELECT *, avg(k) OVER (PARTITION BY p) AS m FROM (SELECT *, row_number() OVER (ORDER BY p, doc_id) AS k FROM c)),
s AS (SELECT avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, sum(CASE WHEN y = 1 THEN m END) AS rs, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll FROM r)
, g AS (SELECT p, count(*) AS n, sum(y) AS k FROM c GROUP BY p), t AS (SELECT k, sum(n) OVER (ORDER BY p DESC) AS a, sum(k) OVER (ORDER BY p DESC) AS h FROM g)
SELECT round(accuracy, 6) AS accuracy, round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc, round(ll, 6) AS log_loss, round((SELECT sum(CAST(k AS DOUBLE) * h / a) FROM t) / n1, 6) AS pr_auc FROM s""")
def metric_classification(spark: SparkSession, d: str) -> DataFrame:
    df = v.table(spark, d, "labels").join(v.table(spark, d, "documents"), "doc_id").filter("quality IS NOT NULL")
    df = df.select("doc_id", F.col("quality").alias("y"), (1.0 - 1.0 / (2 + F.col("n_chars") % 100)).alias("p"))
    m = metrics.classification(df, "y", "p", "doc_id")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_TASKS = {"quality": "quality", "toxic": "toxic"}


@query("""WITH j AS (SELECT 1.0::DOUBLE / (1 + n_chars % 3) AS p, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), t AS (SELECT 'quality' AS task, quality AS y, p FROM j UNION ALL SELECT 'toxic', toxic, p FROM j)
SELECT task, count(*) AS n, round(avg((y - p) * (y - p)), 6) AS mse, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM t WHERE y IS NOT NULL GROUP BY task""")
def multitask_eval(spark: SparkSession, d: str) -> DataFrame:
    df = v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id", "left").withColumn("p", 1.0 / (1 + F.col("n_chars") % 3))
    m = metrics.multitask(df, _TASKS, "p")
    return m.select("task", "n", F.round("mse", 6).alias("mse"), F.round("accuracy", 6).alias("accuracy"))


@query("SELECT 'quality' AS task, round(avg(quality), 6) AS positive_share, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', round(avg(toxic), 6), count(toxic) FROM documents LEFT JOIN labels USING (doc_id)")
def class_sizes(spark: SparkSession, d: str) -> DataFrame:
    df = v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id", "left")
    return metrics.class_sizes(df, _TASKS).withColumn("positive_share", F.round("positive_share", 6))


@query("""WITH j AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT unnest(['id_missing', 'no_target', 'quality_missing', 'quality_constant', 'quality_not_binary', 'toxic_missing', 'toxic_constant', 'toxic_not_binary', 'id_repeated']) AS rule,
unnest([count(*) FILTER (doc_id IS NULL), count(*) FILTER (quality IS NULL AND toxic IS NULL), count(*) FILTER (quality IS NULL), CAST(count(DISTINCT quality) < 2 AS BIGINT), count(*) FILTER (quality NOT IN (0, 1)),
count(*) FILTER (toxic IS NULL), CAST(count(DISTINCT toxic) < 2 AS BIGINT), count(*) FILTER (toxic NOT IN (0, 1)), count(doc_id) - count(DISTINCT doc_id)]) AS violations FROM j""")
def data_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    df = v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id", "left")
    return metrics.quality_rules(df, "doc_id", _TASKS)


@query(f"WITH {v.PREDS} SELECT a.row_idx, round(sum(1 / (1 + exp(-(a.mu - c.mu) / 1000.0))), 4) AS soft_rank FROM preds a JOIN preds c ON a.row_idx // 200 = c.row_idx // 200 GROUP BY a.row_idx")
def soft_rank_pairwise(spark: SparkSession, d: str) -> DataFrame:
    ranked = metrics.soft_ranks(v.preds(spark, d), "row_idx", "mu", 1000.0, 200)
    return ranked.select("row_idx", F.round("soft_rank", 4).alias("soft_rank"))


_MONTHS = "m AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS iter, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 100) AS topk_avg FROM orders GROUP BY 1)"


@query(f"""WITH {_MONTHS}, s AS (SELECT *, avg(topk_avg) OVER (ORDER BY iter ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sma, row_number() OVER (ORDER BY iter) AS k FROM m)
SELECT iter, round(topk_avg, 4) AS topk_avg, round(sma, 4) AS sma, k >= 3 AND (topk_avg - sma) / sma <= 0.01 AS stop FROM s""")
def stop_rule_moving_average(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    rounds = o.groupBy(month.alias("iter")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / (F.count(F.lit(1)).cast("double") * 100.0)).alias("topk_avg"))
    out = metrics.moving_average_stop(rounds, 3, 0.01)
    return out.select("iter", F.round("topk_avg", 4).alias("topk_avg"), F.round("sma", 4).alias("sma"), "stop")


@query(f"""WITH {v.POOL}, e AS (SELECT row_idx % 6 AS round, id, score FROM pool WHERE {v.U} < 0.3), truth AS (SELECT DISTINCT id FROM (SELECT id FROM pool ORDER BY score, row_idx LIMIT 100)),
f AS (SELECT id, min(round) AS round FROM e GROUP BY id), h AS (SELECT round, count(*) AS hits FROM f WHERE id IN (SELECT id FROM truth) GROUP BY round),
p AS (SELECT round, count(*) AS n, min(score) AS best FROM e GROUP BY round)
SELECT round, CAST(sum(n) OVER w AS BIGINT) AS n_labeled, min(best) OVER w AS best_score, round(CAST(sum(coalesce(hits, 0)) OVER w AS DOUBLE) / 100.0, 6) AS topk_recall FROM p LEFT JOIN h USING (round) WINDOW w AS (ORDER BY round)""")
def history_recall_curve(spark: SparkSession, d: str) -> DataFrame:
    pool = v.pool(spark, d)
    e = pool.filter(v.is_explored(0.3)).withColumn("round", F.col("row_idx") % 6)
    truth = select.true_top(pool, 100).select("id").distinct()
    hits = e.groupBy("id").agg(F.min("round").alias("round")).join(truth, "id", "left_semi").groupBy("round").agg(F.count(F.lit(1)).alias("hits"))
    per = e.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("best")).join(hits, "round", "left").fillna(0, ["hits"])
    h = metrics.history(per, 100)
    return h.select("round", "n_labeled", "best_score", F.round("topk_recall", 6).alias("topk_recall"))


_LINE = "regr_slope(y, x) AS b, avg(y) - regr_slope(y, x) * avg(x) AS a"


@query(f"""WITH {_SCORED}, t AS (SELECT row_idx, mu / 1000 AS x, score AS y, (row_number() OVER (ORDER BY {v.U}, row_idx) - 1) % 3 AS fold FROM scored),
w AS (SELECT k.fold, {_LINE} FROM (SELECT unnest([0, 1, 2]) AS fold) k JOIN t ON t.fold <> k.fold GROUP BY k.fold)
SELECT row_idx, CAST(fold AS INTEGER) AS fold, round(a + b * x, 4) AS mu FROM t JOIN w USING (fold)""")
def stack_oof_fusion(spark: SparkSession, d: str) -> DataFrame:
    df = split.folds(_scored(spark, d), "row_idx", 3).withColumn("x", F.col("mu") / 1000)
    out = surrogate.out_of_fold(df, "fold", 3, "x", "score", "p")
    return out.select("row_idx", "fold", F.round("p", 4).alias("mu"))


@query(f"""WITH {_SCORED}, t AS (SELECT row_idx, vol AS x, score AS y, row_number() OVER (ORDER BY {v.U}, row_idx) - 1 < greatest(1, count(*) OVER () // 5) AS h FROM scored), w AS (SELECT {_LINE} FROM t WHERE h)
SELECT row_idx, round(a + b * x, 4) AS mu, 0.0::DOUBLE AS var FROM t, w""")
def stack_holdout_fusion(spark: SparkSession, d: str) -> DataFrame:
    df = split.hold_out(_scored(spark, d).drop("mu", "var"), "row_idx")
    return surrogate.stack(df, F.col("held_out"), ["vol"], "score").select("row_idx", F.round("mu", 4).alias("mu"), "var")


def _normal(xs: list[str], source: str, name: str, ridge: float = 0.0) -> str:
    """SQL tables for a linear fit of y on two or three columns: centred sums of products, then Cramer's rule."""
    n = len(xs)
    means = ", ".join(f"avg({x}) OVER () AS m{i}" for i, x in enumerate(xs))
    sums = [f"sum((x{i} - m{i}) * (x{j} - m{j}))" + (f" + {ridge}" if i == j and ridge else "") + f" AS s{i}{j}" for i in range(n) for j in range(i, n)]
    sums += [f"sum((x{i} - m{i}) * (y - my)) AS b{i}" for i in range(n)] + [f"any_value(m{i}) AS m{i}" for i in range(n)] + ["any_value(my) AS my"]
    cell = lambda i, j: f"s{min(i, j)}{max(i, j)}"

    def det(a: list[list[str]]) -> str:
        if len(a) == 2:
            return f"({a[0][0]} * {a[1][1]} - {a[0][1]} * {a[1][0]})"
        return "(" + " ".join(f"{'-' if k % 2 else '+'} {a[0][k]} * {det([r[:k] + r[k + 1 :] for r in a[1:]])}" for k in range(len(a))) + ")"

    whole = [[cell(i, j) for j in range(n)] for i in range(n)]
    put = lambda k: [[f"b{i}" if j == k else cell(i, j) for j in range(n)] for i in range(n)]
    weights = ", ".join(f"{det(put(k))} / {det(whole)} AS w{k}" for k in range(n))
    back = " - ".join(["my", *[f"w{k} * m{k}" for k in range(n)]])
    rows = f"(SELECT y, {', '.join(f'CAST({x} AS DOUBLE) AS x{i}' for i, x in enumerate(xs))}, {means}, avg(y) OVER () AS my FROM {source})"
    return f"{name}_s AS (SELECT {', '.join(sums)} FROM {rows}), {name}_w AS (SELECT *, {weights} FROM {name}_s), {name} AS (SELECT *, {back} AS w FROM {name}_w)"


_HELD = f"t AS (SELECT row_idx, mu AS m, cost, vol, score AS y, row_number() OVER (ORDER BY {v.U}, row_idx) - 1 < greatest(1, count(*) OVER () // 5) AS h FROM scored), th AS (SELECT * FROM t WHERE h)"


@query(f"WITH {_SCORED}, {_HELD}, {_normal(['m', 'cost', 'vol'], 'th', 'f', 1.0)} SELECT row_idx, round(w + w0 * m + w1 * cost + w2 * vol, 4) AS mu, 0.0::DOUBLE AS var FROM t, f")
def stack_three_members(spark: SparkSession, d: str) -> DataFrame:
    df = split.hold_out(_scored(spark, d).withColumnRenamed("mu", "m"), "row_idx").drop("var")
    return surrogate.stack(df, F.col("held_out"), ["m", "cost", "vol"], "score", ridge=1.0).select("row_idx", F.round("mu", 4).alias("mu"), "var")


@query()
def stack_ridge_cv(spark: SparkSession, d: str) -> DataFrame:
    """Learned fusion as the experiment has it: 80/20 hold-out, the penalty from the grid by leave-one-out errors."""
    df = split.hold_out(_scored(spark, d).withColumnRenamed("mu", "m"), "row_idx").drop("var")
    return surrogate.stack_cv(df, F.col("held_out"), ["m", "cost", "vol"], "score").select("row_idx", "mu", "var")


_FOLD_LINES = ", ".join(f"{x}w AS (SELECT k.fold, regr_slope(y, {x}) AS b, avg(y) - regr_slope(y, {x}) * avg({x}) AS a FROM (SELECT unnest([0, 1, 2]) AS fold) k JOIN t ON t.fold <> k.fold GROUP BY k.fold)" for x in ("x", "z"))


@query(f"""WITH {_SCORED}, t AS (SELECT row_idx, mu / 1000 AS x, vol AS z, score AS y, (row_number() OVER (ORDER BY {v.U}, row_idx) - 1) % 3 AS fold FROM scored), {_FOLD_LINES},
o AS (SELECT y, xw.a + xw.b * x AS p, zw.a + zw.b * z AS q FROM t JOIN xw ON t.fold = xw.fold JOIN zw ON t.fold = zw.fold), {_normal(['p', 'q'], 'o', 'f')},
l AS (SELECT regr_slope(y, x) AS bx, avg(y) - regr_slope(y, x) * avg(x) AS ax, regr_slope(y, z) AS bz, avg(y) - regr_slope(y, z) * avg(z) AS az FROM t)
SELECT row_idx, round(w + w0 * (ax + bx * x) + w1 * (az + bz * z), 3) AS mu, 0.0::DOUBLE AS var FROM t, f, l""")
def stack_oof_members(spark: SparkSession, d: str) -> DataFrame:
    df = split.folds(_scored(spark, d).withColumn("x", F.col("mu") / 1000).drop("mu", "var"), "row_idx", 3)
    return surrogate.stack_out_of_fold(df, "fold", 3, ["x", "vol"], "score").select("row_idx", F.round("mu", 3).alias("mu"), "var")


@query(f"WITH {v.PREDS} SELECT row_idx, round((mu * exp(1.0) + cost * exp(0.5) + vol) / (exp(1.0) + exp(0.5) + 1), 6) AS fused FROM preds")
def fusion_softmax(spark: SparkSession, d: str) -> DataFrame:
    return surrogate.fuse_softmax(v.preds(spark, d), ["mu", "cost", "vol"], [1.0, 0.5, 0.0], "fused").select("row_idx", F.round("fused", 6).alias("fused"))


@query(f"WITH {v.POOL} SELECT row_idx, round({v.u(3)}, 9) AS mu, round({v.u(4)}, 9) AS var FROM pool")
def random_model(spark: SparkSession, d: str) -> DataFrame:
    return surrogate.random_model(v.pool(spark, d), "row_idx", 3).select("row_idx", F.round("mu", 9).alias("mu"), F.round("var", 9).alias("var"))


@query(f"""WITH {_SCORED}, s AS (SELECT row_idx // 200 AS batch, row_idx, mu, score, var FROM scored),
r AS (SELECT a.batch, a.row_idx, sum(1 / (1 + exp(-(a.mu - c.mu) / 1000.0))) AS ra, sum(1 / (1 + exp(-(a.score - c.score) / 1000.0))) AS rb FROM s a JOIN s c USING (batch) GROUP BY ALL),
q AS (SELECT batch, corr(ra, rb) AS rho FROM r GROUP BY batch), e AS (SELECT batch, avg(0.5 * (ln(greatest(var, 1e-5)) + (mu - score) * (mu - score) / greatest(var, 1e-5))) AS nll FROM s GROUP BY batch)
SELECT batch, round(rho, 6) AS rho, round(log10(nll + 0.1 * (1 - rho)), 6) AS log10_loss FROM q JOIN e USING (batch)""")
def soft_spearman_loss(spark: SparkSession, d: str) -> DataFrame:
    df = _scored(spark, d)
    rho = metrics.soft_spearman(df, "row_idx", "mu", "score", 1000.0)
    loss = metrics.ranking_loss(df, "row_idx", "score", "mu", "var", 1000.0)
    return rho.join(loss, "batch").select("batch", F.round("rho", 6).alias("rho"), F.round(F.log10("loss"), 6).alias("log10_loss"))


@query("WITH p AS (SELECT doc_id, quality, [1.0 / (2 + n_chars % 7), 1 - 1.0 / (2 + n_chars % 7)] AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL) SELECT round(avg(-ln(CAST(p[quality + 1] AS DOUBLE))), 5) AS cross_entropy FROM p")
def metric_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    df = v.table(spark, d, "labels").join(v.table(spark, d, "documents"), "doc_id").filter("quality IS NOT NULL")
    one = 1.0 / (2 + F.col("n_chars") % 7)
    return df.agg(F.round(F.avg(metrics.cross_entropy(F.col("quality"), F.array(one, 1 - one))), 5).alias("cross_entropy"))


@query(f"""WITH {v.POOL}, {v.EXPLORED}, truth AS (SELECT DISTINCT id FROM (SELECT id FROM pool ORDER BY score, row_idx LIMIT 500)), e AS (SELECT DISTINCT id FROM explored WHERE row_idx % 2 = 0),
h AS (SELECT count(*) AS hits FROM e WHERE id IN (SELECT id FROM truth)) SELECT hits, round(hits / CAST(least((SELECT count(*) FROM e), 500) AS DOUBLE), 6) AS rate FROM h""")
def topk_rate(spark: SparkSession, d: str) -> DataFrame:
    """Fewer ids than k are explored, so their number divides."""
    out = metrics.top_rate(v.explored(spark, d).filter("row_idx % 2 = 0"), select.true_top(v.pool(spark, d), 500), 500)
    return out.select("hits", F.round("rate", 6).alias("rate"))


@query(f"WITH {_SCORED}, s AS (SELECT avg(score) AS m, stddev_pop(score) AS sd FROM scored) SELECT row_idx, round((score - m) / sd, 6) AS z, round(score, 6) AS back FROM scored, s")
def scaler_inverse(spark: SparkSession, d: str) -> DataFrame:
    df = _scored(spark, d)
    out = metrics.unscaled(metrics.standardise(df, ["score"]), metrics.scaler(df, ["score"]), ["score"])
    return out.select("row_idx", F.round("score_z", 6).alias("z"), F.round("score_back", 6).alias("back"))


@query("SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, i")
def pool_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Mean pooling: a label's vectors stand for a sequence's token vectors."""
    pooled = v.table(spark, d, "embeddings").groupBy("label").agg(vector.mean_vector("embedding", 64).alias("m"))
    return pooled.select("label", F.posexplode("m").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"""WITH {_SCORED}, l AS (SELECT row_idx, row_idx % 3 AS round, CASE WHEN row_idx % 7 <> 0 THEN score END AS score, cost AS x FROM scored WHERE {v.U} < 0.5)
SELECT 'all' AS scope, count(*) AS n, round(regr_slope(score, x), 4) AS slope FROM l WHERE score IS NOT NULL UNION ALL SELECT 'new', count(*), round(regr_slope(score, x), 4) FROM l WHERE score IS NOT NULL AND round = 2""")
def retrain_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter(v.is_explored(0.5)).select("row_idx", (F.col("row_idx") % 3).alias("round"), F.when(F.col("row_idx") % 7 != 0, F.col("score")).alias("score"), F.col("cost").alias("x"))
    every, new = (select.within(rows, 2, online).agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("score", "x"), 4).alias("slope")) for online in (False, True))
    return every.select(F.lit("all").alias("scope"), "n", "slope").unionByName(new.select(F.lit("new").alias("scope"), "n", "slope"))


@query()
def ridge_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return surrogate.ridge_vectors(v.table(spark, d, "embeddings").withColumn("y", F.col("label").cast("double")), "embedding", "y", 64).select("vec_id", "mu", "var")


@query()
def rf_mean_var(spark: SparkSession, d: str) -> DataFrame:
    return surrogate.forest(v.table(spark, d, "embeddings").withColumn("y", F.col("label").cast("double")), "embedding", "y", trees=100, depth=8).select("vec_id", "mu", "var")


@query()
def boosted_mean(spark: SparkSession, d: str) -> DataFrame:
    return surrogate.boosted(v.table(spark, d, "embeddings").withColumn("y", F.col("label").cast("double")), "embedding", "y", rounds=100).select("vec_id", "mu")


_BAGS = ", ".join(f"b{m} AS (SELECT cost, vol, score AS y FROM scored WHERE {v.u(m)} < 0.5), {_normal(['cost', 'vol'], f'b{m}', f'f{m}')}" for m in range(5))
_BAGGED = ", ".join(f"(SELECT w FROM f{m}) + (SELECT w0 FROM f{m}) * cost + (SELECT w1 FROM f{m}) * vol" for m in range(5))


@query(f"WITH {_SCORED}, {_BAGS}, p AS (SELECT row_idx, unnest([{_BAGGED}]) AS o FROM scored) SELECT row_idx, round(avg(o), 4) AS mu, round(sqrt(var_pop(o)), 3) AS sigma FROM p GROUP BY row_idx")
def bagged_linear(spark: SparkSession, d: str) -> DataFrame:
    out = surrogate.bagged(_scored(spark, d).drop("mu", "var"), "row_idx", ["cost", "vol"], "score")
    return out.select("row_idx", F.round("mu", 4).alias("mu"), F.round(F.sqrt("var"), 3).alias("sigma"))


@query()
def kmeans_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return surrogate.kmeans(v.table(spark, d, "embeddings"), "embedding", 10).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


_CENTRES = "c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, i)"
_NEAREST = f"{_CENTRES}, e AS (SELECT vec_id, label AS own, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), q AS (SELECT vec_id, c.label, round(sum((x - m) * (x - m)), 9) AS d2 FROM e JOIN c USING (i) GROUP BY vec_id, c.label), z AS (SELECT vec_id, label, d2, row_number() OVER (PARTITION BY vec_id ORDER BY d2, label) AS k FROM q)"


@query(f"WITH {_NEAREST} SELECT vec_id, label, round(d2, 4) AS d2 FROM z WHERE k = 1")
def centroid_assign(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings")
    return surrogate.assign(e, surrogate.centroids(e, "label", "embedding", 64), "vec_id", "embedding", "label").withColumn("d2", F.round("d2", 4))


@query(f"WITH {_NEAREST} SELECT z.label, count(*) AS n, round(avg(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * i))), 4) AS x FROM z JOIN embeddings USING (vec_id) WHERE k = 1 GROUP BY z.label")
def kmeans_one_step(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings")
    placed = surrogate.assign(e, surrogate.centroids(e, "label", "embedding", 64), "vec_id", "embedding", "label").select("vec_id", F.col("label").alias("g")).join(e, "vec_id")
    moved = surrogate.centroids(placed, "g", "embedding", 64)
    sizes = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return moved.join(sizes, "g").select(F.col("g").alias("label"), "n", F.round(vector.dot(F.col("centroid"), F.sequence(F.lit(1), F.lit(64))), 4).alias("x"))


def _loop_sql() -> str:
    ctes = [f"WITH {_SCORED}", f"p AS (SELECT s.row_idx, q.id, s.score, s.mu / 1000 AS x FROM scored s JOIN pool q USING (row_idx))", f"l0 AS (SELECT row_idx, 0 AS round FROM p WHERE {v.U} < 0.05)"]
    for t in (1, 2, 3):
        ctes.append(f"w{t} AS (SELECT regr_slope(-score, x) AS b, avg(-score) - regr_slope(-score, x) * avg(x) AS a FROM p JOIN l{t - 1} USING (row_idx))")
        ctes.append(f"s{t} AS (SELECT row_idx, {t} AS round FROM p, w{t} WHERE row_idx NOT IN (SELECT row_idx FROM l{t - 1}) ORDER BY round(a + b * x, 6) DESC, row_idx LIMIT 40)")
        ctes.append(f"l{t} AS (SELECT * FROM l{t - 1} UNION ALL SELECT * FROM s{t})")
    ctes.append("truth AS (SELECT DISTINCT id FROM (SELECT id FROM p ORDER BY score, row_idx LIMIT 100))")
    ctes.append("j AS (SELECT l3.round, id, score FROM l3 JOIN p USING (row_idx))")
    ctes.append("h AS (SELECT round, count(*) AS hits FROM (SELECT id, min(round) AS round FROM j GROUP BY id) WHERE id IN (SELECT id FROM truth) GROUP BY round)")
    ctes.append("g AS (SELECT round, count(*) AS n, min(score) AS best FROM j GROUP BY round)")
    return ", ".join(ctes) + " SELECT round, CAST(sum(n) OVER w AS BIGINT) AS n_labeled, min(best) OVER w AS best_score, round(CAST(sum(coalesce(hits, 0)) OVER w AS DOUBLE) / 100.0, 6) AS topk_recall FROM g LEFT JOIN h USING (round) WINDOW w AS (ORDER BY round)"


def _loop_pool(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).join(v.pool(spark, d).select("row_idx", "id"), "row_idx").select("row_idx", "id", "score", (F.col("mu") / 1000).alias("x"))


@query(_loop_sql())
def loop_three_rounds(spark: SparkSession, d: str) -> DataFrame:
    pool = _loop_pool(spark, d)
    _, history = loop.run(pool, pool.filter(v.is_explored()), loop.line_surrogate(["x"]), 3, 40, 100)
    return history.select("round", "n_labeled", "best_score", F.round("topk_recall", 6).alias("topk_recall"))


@query()
def resume_equals_uninterrupted(spark: SparkSession, d: str) -> DataFrame:
    """Rows labelled by a run that stopped after one round and went on, and by one that did not stop; both columns agree."""
    import uuid

    from siftpool.sources.state import own_root

    pool = _loop_pool(spark, d)
    first = pool.filter(v.is_explored())
    learn = loop.line_surrogate(["x"])
    whole, _ = loop.run(pool, first, learn, 2, 40, 100)
    root = f"{own_root(spark)}/{uuid.uuid4().hex}/rounds"
    loop.run(pool, first, learn, 1, 40, 100, root)
    again, _ = loop.run(pool, first, learn, 2, 40, 100, root)
    a, b = whole.select("row_idx", F.col("round").alias("a")), again.select("row_idx", F.col("round").alias("b"))
    return a.join(b, "row_idx", "full").select("row_idx", "a", "b", F.col("a").eqNullSafe(F.col("b")).alias("same"))
