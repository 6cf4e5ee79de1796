"""Queries of acquisition, selection, ranks and look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.operators import acquire, align, metrics, rank, select
from siftpool.plans import views as v
from siftpool.plans.registry import registry

QUERIES, SQL, query = registry()
BATCH, K = 50, 100
BEST = "best AS (SELECT CASE WHEN count(*) = 0 THEN CAST('-inf' AS DOUBLE) WHEN count(*) < 20 THEN max(mu) ELSE min(mu) END AS best FROM (SELECT mu FROM preds JOIN explored USING (row_idx) ORDER BY mu DESC LIMIT 20))"


@query(f"""
WITH {v.POOL}, {v.PREDS}, {v.EXPLORED},
cand AS (SELECT row_idx, id, score, mu + 2.0 * sqrt(var) AS u FROM preds JOIN pool USING (row_idx) WHERE row_idx NOT IN (SELECT row_idx FROM explored)),
chosen AS (SELECT * FROM cand ORDER BY u DESC, row_idx LIMIT {BATCH}),
truth AS (SELECT DISTINCT id FROM (SELECT id FROM pool ORDER BY score, row_idx LIMIT {K})),
done AS (SELECT id, score FROM explored UNION ALL SELECT id, score FROM chosen)
SELECT (SELECT count(*) FROM done) AS n_labeled, (SELECT min(score) FROM done) AS best_score,
       (SELECT count(DISTINCT id) FROM done WHERE id IN (SELECT id FROM truth)) AS hits""")
def screen_round_ucb(spark: SparkSession, d: str) -> DataFrame:
    """One round: predictions, unlabelled rows, upper bound, batch, labels, recall."""
    pool, seen = v.pool(spark, d), v.explored(spark, d)
    cand = select.unlabelled(acquire.utility("ucb", v.preds(spark, d)), seen)
    chosen = align.look_up(select.top(cand, "u", BATCH, F.col("row_idx")), pool, "row_idx").join(pool.select("row_idx", "id"), "row_idx")
    done = seen.select("id", "score").unionByName(chosen.select("id", (-F.col("label")).alias("score")))
    hits = metrics.recall(done, select.true_top(pool, K), K).select("hits")
    return done.agg(F.count(F.lit(1)).alias("n_labeled"), F.min("score").alias("best_score")).crossJoin(hits)


def _acquired(name: str, **how) -> None:  # noqa: ANN003
    def run(spark: SparkSession, d: str) -> DataFrame:
        kw = dict(how)
        preds = v.preds(spark, d)
        if name in ("ei", "pi"):
            best = select.kth_value(preds.join(v.explored(spark, d).select("row_idx"), "row_idx", "left_semi"), "mu", 20)
            preds, kw["best"] = preds.crossJoin(F.broadcast(best)), F.col("kth")
        out = acquire.utility(name, preds, **kw)
        exact = name in ("borda", "greedy")  # equal bit for bit in both engines
        return out.select("row_idx", F.col("u") if exact else F.round("u", 6).alias("u"))

    run.__name__ = f"acq_{name}"
    gain = "(mu - best + 0.01)"
    z = f"({gain} / CASE WHEN var > 0 THEN sqrt(var) END)"
    sql = {
        "random": v.U,
        "threshold": f"CASE WHEN mu >= 25000.0 THEN {v.U} ELSE -1.0 END",
        "ucb": "mu + 2.0 * sqrt(var)",
        "lcb": "mu - 2.0 * sqrt(var)",
        "noisy": f"mu + (SELECT stddev_pop(mu) FROM preds) * {v.NORMAL}",
        "thompson": f"mu + sqrt(var) * {v.NORMAL}",
        "ei": f"CASE WHEN var > 0 THEN {gain} * {v.phi(z)} + sqrt(var) * exp(-{z} * {z} / 2.0) / sqrt(2 * pi()) ELSE {gain} END",
        "pi": f"CASE WHEN var > 0 THEN {v.phi(z)} WHEN {gain} > 0 THEN 1.0 ELSE 0.0 END",
    }
    if name == "borda":
        text = f"WITH {v.PREDS} SELECT row_idx, row_number() OVER (ORDER BY mu, row_idx) - 1 AS u FROM preds"
    elif name == "greedy":
        text = f"WITH {v.PREDS} SELECT row_idx, mu AS u FROM preds"
    elif name in ("ei", "pi"):
        text = f"WITH {v.POOL}, {v.PREDS}, {v.EXPLORED}, {BEST} SELECT row_idx, round({sql[name]}, 6) AS u FROM preds, best"
    else:
        text = f"WITH {v.PREDS} SELECT row_idx, round({sql[name]}, 6) AS u FROM preds"
    query(text)(run)


for _name in ("random", "greedy", "ucb", "lcb", "noisy", "thompson", "ei", "pi", "borda"):
    _acquired(_name)
_acquired("threshold", least=25000.0)

_ABOVE = f"CASE WHEN var > 0 THEN {v.phi('((mu - 40000.0) / CASE WHEN var > 0 THEN sqrt(var) END)')} WHEN mu >= 40000.0 THEN 1.0 ELSE 0.0 END"


@query(f"WITH {v.PREDS} SELECT row_idx, round({_ABOVE}, 6) AS p FROM preds")
def prob_above(spark: SparkSession, d: str) -> DataFrame:
    return v.preds(spark, d).select("row_idx", F.round(acquire.probability_above(F.col("mu"), F.col("var"), F.lit(40000.0)), 6).alias("p"))


@query(f"WITH {v.PREDS} SELECT row_idx FROM preds WHERE {_ABOVE} >= 0.25")
def prune_pool(spark: SparkSession, d: str) -> DataFrame:
    return acquire.prune(v.preds(spark, d), F.lit(40000.0), 0.25).select("row_idx")


@query(f"WITH {v.PREDS} SELECT round(sum({_ABOVE}), 4) AS expected, count(*) AS pruned FROM preds WHERE NOT ({_ABOVE} >= 0.25)")
def expected_positives_pruned(spark: SparkSession, d: str) -> DataFrame:
    preds = v.preds(spark, d)
    gone = preds.join(acquire.prune(preds, F.lit(40000.0), 0.25).select("row_idx"), "row_idx", "left_anti")
    p = acquire.probability_above(F.col("mu"), F.col("var"), F.lit(40000.0))
    return gone.agg(F.round(F.sum(p), 4).alias("expected"), F.count(F.lit(1)).alias("pruned"))


@query(f"WITH {v.POOL}, {v.PREDS} SELECT row_idx, id, vol FROM preds JOIN pool USING (row_idx) ORDER BY round(vol) DESC, id DESC, row_idx LIMIT {BATCH}")
def select_topk_id_ties(spark: SparkSession, d: str) -> DataFrame:
    df = v.preds(spark, d).join(v.pool(spark, d), "row_idx")
    return df.orderBy(F.round("vol").desc(), F.col("id").desc(), "row_idx").limit(BATCH).select("row_idx", "id", "vol")


@query(f"WITH {v.PREDS} SELECT row_idx, round(vol) AS u FROM preds ORDER BY round(vol) DESC, row_idx LIMIT {BATCH}")
def select_topk_row_ties(spark: SparkSession, d: str) -> DataFrame:
    return select.top(v.preds(spark, d).select("row_idx", F.round("vol").alias("u")), "u", BATCH, F.col("row_idx"))


@query(f"""WITH {v.POOL}, {v.PREDS}, {v.EXPLORED},
drawn AS (SELECT row_idx FROM preds ORDER BY {v.U} DESC, row_idx LIMIT 10),
s AS (SELECT row_idx, row_idx IN (SELECT row_idx FROM drawn) AS by_chance, mu FROM preds WHERE row_idx NOT IN (SELECT row_idx FROM explored))
SELECT row_idx, by_chance FROM s ORDER BY by_chance DESC, CASE WHEN by_chance THEN 0 ELSE mu END DESC, row_idx LIMIT {BATCH}""")
def select_epsilon_greedy(spark: SparkSession, d: str) -> DataFrame:
    preds = acquire.utility("greedy", v.preds(spark, d))
    mixed = select.epsilon_greedy(preds, BATCH, 0.2, 0)
    left = select.unlabelled(mixed, v.explored(spark, d))
    return select.top(left, "u", BATCH, F.col("row_idx")).select("row_idx", (F.col("u") == float("inf")).alias("by_chance"))


@query(f"""WITH {v.POOL}, {v.PREDS}, e AS (SELECT row_idx, CASE WHEN row_idx % 7 <> 0 THEN mu END AS score FROM preds WHERE {v.U} < 0.05),
best AS (SELECT min(score) AS best FROM (SELECT score FROM e WHERE score IS NOT NULL ORDER BY score DESC LIMIT 3)),
g AS (SELECT row_idx, mu, var, mu - best + 0.01 AS gain, CASE WHEN var > 0 THEN sqrt(var) END AS sd FROM preds, best),
drawn AS (SELECT row_idx FROM preds ORDER BY {v.u(4)} DESC, row_idx LIMIT 10),
s AS (SELECT row_idx, mu, row_idx IN (SELECT row_idx FROM drawn) AS by_chance, CASE WHEN var > 0 THEN gain * {v.phi('(gain / sd)')} + sd * exp(-(gain / sd) * (gain / sd) / 2.0) / sqrt(2 * pi()) ELSE gain END AS u FROM g WHERE row_idx NOT IN (SELECT row_idx FROM e))
SELECT row_idx, mu, CASE WHEN by_chance THEN -1.0 ELSE round(u, 5) END AS u FROM s ORDER BY by_chance DESC, CASE WHEN by_chance THEN 0 ELSE s.u END DESC, row_idx LIMIT {BATCH}""")
def acquire_batch_ei(spark: SparkSession, d: str) -> DataFrame:
    """A whole batch in round 4: expected improvement over the third best explored score, a fifth by chance, explored rows left out."""
    preds = v.preds(spark, d)
    seen = preds.filter(v.is_explored()).select("row_idx", F.when(F.col("row_idx") % 7 != 0, F.col("mu")).alias("score"))
    out = select.acquire_batch(preds, seen, "ei", 3, BATCH, 0.2, seed=4)
    return out.select("row_idx", "mu", F.when(F.col("u") == float("inf"), -1.0).otherwise(F.round("u", 5)).alias("u"))


@query(f"WITH {v.PREDS} SELECT row_idx, round({v.u(1)}, 9) AS first, round({v.u(2)}, 9) AS second FROM preds")
def seeded_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The random function in two rounds."""
    a, b = (acquire.utility("random", v.preds(spark, d), seed=s).select("row_idx", F.round("u", 9).alias(n)) for s, n in ((1, "first"), (2, "second")))
    return a.join(b, "row_idx")


@query(f"WITH {v.POOL}, {v.EXPLORED}, u AS (SELECT * FROM pool WHERE id IN (SELECT id FROM explored)) SELECT row_idx, id FROM u ORDER BY {v.u(5)} DESC, row_idx LIMIT {BATCH}")
def initial_usable(spark: SparkSession, d: str) -> DataFrame:
    """The first draw among rows that have a label."""
    usable = v.pool(spark, d).join(v.explored(spark, d).select("id").distinct(), "id", "left_semi").withColumn("mu", F.lit(0.0))
    return select.top(acquire.utility("random", usable, seed=5), "u", BATCH, F.col("row_idx")).select("row_idx", "id")


@query(f"WITH {v.POOL} SELECT row_idx, id FROM pool ORDER BY {v.U} DESC, row_idx LIMIT {BATCH}")
def initial_random(spark: SparkSession, d: str) -> DataFrame:
    return select.top(acquire.utility("random", v.pool(spark, d).withColumn("mu", F.lit(0.0))), "u", BATCH, F.col("row_idx")).select("row_idx", "id")


@query(f"""WITH {v.POOL}, c AS (SELECT stratum, count(*) AS n FROM pool GROUP BY stratum),
q AS (SELECT stratum, CAST(ceil({BATCH} * n / (SELECT count(*) FROM pool)::DOUBLE) AS BIGINT) AS quota FROM c),
r AS (SELECT row_idx, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {v.U} DESC, row_idx) AS place FROM pool)
SELECT row_idx, stratum, quota FROM r JOIN q USING (stratum) WHERE place <= quota""")
def initial_stratified(spark: SparkSession, d: str) -> DataFrame:
    return select.stratified(v.pool(spark, d), "stratum", BATCH).select("row_idx", "stratum", F.col("quota").cast("long"))


@query(f"""WITH {v.POOL}, {v.PREDS}, j AS (SELECT row_idx, stratum, mu FROM preds JOIN pool USING (row_idx)),
b AS (SELECT stratum, max(mu) AS own FROM j GROUP BY stratum),
q AS (SELECT stratum, CAST(ceil(round(20 * exp(-((SELECT max(own) FROM b) - own) / 5000.0), 9)) AS BIGINT) AS quota FROM b),
r AS (SELECT row_idx, stratum, row_number() OVER (PARTITION BY stratum ORDER BY mu DESC, row_idx) AS place FROM j)
SELECT row_idx, stratum, quota FROM r JOIN q USING (stratum) WHERE place <= quota""")
def cluster_quota_decay(spark: SparkSession, d: str) -> DataFrame:
    df = v.preds(spark, d).join(v.pool(spark, d).select("row_idx", "stratum"), "row_idx")
    return select.decayed_quota(df, "stratum", "mu", 20, 5000.0).select("row_idx", "stratum", "quota")


@query(f"WITH {v.POOL}, {v.FAILED} SELECT id, score, acq_order FROM failed ORDER BY score DESC NULLS LAST, acq_order LIMIT {BATCH}")
def top_explored(spark: SparkSession, d: str) -> DataFrame:
    return select.top(v.failed(spark, d), "score", BATCH, F.col("acq_order")).select("id", "score", "acq_order")


@query(f"WITH {v.POOL}, {v.FAILED} SELECT round(sum(coalesce(score, 0)) / count(*), 6) AS topk_avg, count(*) AS n FROM (SELECT * FROM failed ORDER BY score DESC NULLS LAST, acq_order LIMIT 1000)")
def topk_avg_null_as_zero(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_average(v.failed(spark, d), 1000).select(F.round("topk_avg", 6).alias("topk_avg"), "n")


@query(f"WITH {v.POOL}, {v.FAILED} SELECT round(avg(score), 6) AS batch_avg FROM failed")
def batch_average(spark: SparkSession, d: str) -> DataFrame:
    return metrics.batch_average(v.failed(spark, d)).select(F.round("batch_avg", 6).alias("batch_avg"))


@query(f"WITH {v.PREDS} SELECT row_idx, mu FROM preds ORDER BY mu DESC, row_idx LIMIT {BATCH}")
def top_preds(spark: SparkSession, d: str) -> DataFrame:
    return select.top(v.preds(spark, d), "mu", BATCH, F.col("row_idx")).select("row_idx", "mu")


@query(f"WITH {v.POOL} SELECT row_idx, id, score FROM pool WHERE score IS NOT NULL ORDER BY score, row_idx LIMIT {K}")
def true_topk(spark: SparkSession, d: str) -> DataFrame:
    return select.true_top(v.pool(spark, d), K).select("row_idx", "id", "score")


@query(f"WITH {v.POOL}, {v.PREDS}, {v.EXPLORED}, {BEST} SELECT best AS kth FROM best")
def kth_threshold(spark: SparkSession, d: str) -> DataFrame:
    return select.kth_value(v.preds(spark, d).join(v.explored(spark, d).select("row_idx"), "row_idx", "left_semi"), "mu", 20)


@query(f"""WITH {v.POOL}, {v.EXPLORED}, truth AS (SELECT DISTINCT id FROM (SELECT id FROM pool ORDER BY score, row_idx LIMIT {K})),
h AS (SELECT count(DISTINCT id) AS hits FROM explored WHERE id IN (SELECT id FROM truth)) SELECT hits, round(hits / {float(K)}, 6) AS recall FROM h""")
def topk_recall(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.recall(v.explored(spark, d), select.true_top(v.pool(spark, d), K), K)
    return out.select("hits", F.round("recall", 6).alias("recall"))


@query(f"WITH {v.POOL}, {v.PREDS}, {v.EXPLORED} SELECT p.row_idx, -e.score AS label FROM preds p LEFT JOIN explored e ON p.row_idx = e.row_idx")
def label_lookup_nullable(spark: SparkSession, d: str) -> DataFrame:
    return align.look_up(v.preds(spark, d).select("row_idx"), v.explored(spark, d), "row_idx")


@query(f"WITH {v.POOL}, {v.PREDS} SELECT p.row_idx, -e.score AS label FROM preds p JOIN pool e ON p.row_idx = e.row_idx")
def label_lookup_minimize(spark: SparkSession, d: str) -> DataFrame:
    return align.look_up(v.preds(spark, d).select("row_idx"), v.pool(spark, d), "row_idx", strict=True)


@query(f"WITH {v.POOL}, {v.EXPLORED} SELECT row_idx, id FROM pool WHERE id IN (SELECT id FROM explored)")
def semi_filter_scored(spark: SparkSession, d: str) -> DataFrame:
    return v.pool(spark, d).join(v.explored(spark, d).select("id").distinct(), "id", "left_semi").select("row_idx", "id")


@query(f"WITH {v.POOL}, {v.EXPLORED} SELECT row_idx, id FROM pool WHERE row_idx NOT IN (SELECT row_idx FROM explored)")
def anti_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    return select.unlabelled(v.pool(spark, d), v.explored(spark, d)).select("row_idx", "id")


@query(f"WITH {v.POOL}, {v.EXPLORED} SELECT row_idx, id IN (SELECT id FROM explored) AS usable FROM pool")
def usable_mask(spark: SparkSession, d: str) -> DataFrame:
    known = v.explored(spark, d).select("id").distinct().withColumn("k", F.lit(True))
    return v.pool(spark, d).join(known, "id", "left").select("row_idx", F.coalesce("k", F.lit(False)).alias("usable"))


@query(f"WITH {v.POOL}, {v.EXPLORED} SELECT row_idx, id FROM pool WHERE id NOT IN (SELECT id FROM explored)")
def skip_explored_ids(spark: SparkSession, d: str) -> DataFrame:
    return v.pool(spark, d).join(v.explored(spark, d).select("id"), "id", "left_anti").select("row_idx", "id")


@query(f"WITH {v.POOL} SELECT row_idx, id FROM pool WHERE row_idx >= 100 AND row_idx < 160 UNION ALL SELECT row_idx, id FROM pool WHERE row_idx < 3")
def pool_slices(spark: SparkSession, d: str) -> DataFrame:
    pool = v.pool(spark, d).select("row_idx", "id")
    return select.in_slice(pool, 100, 160).unionByName(select.in_slice(pool, 0, 3))


@query(f"WITH {v.POOL} SELECT row_idx, id FROM pool WHERE row_idx IN (5, 17, 3, 90)")
def pool_gather(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(5,), (17,), (3,), (90,), (5,)], "row_idx long")
    pool = v.pool(spark, d).select("row_idx", "id")
    return select.gather(pool, rows, pool.agg(F.max("row_idx")).first()[0] + 1)


@query(f"""WITH {v.POOL}, {v.EXPLORED}, fresh AS (SELECT id, max(score) AS score FROM explored GROUP BY id),
old AS (SELECT id, min(score) AS score FROM pool GROUP BY id)
SELECT id, coalesce(f.score, o.score) AS score FROM old o LEFT JOIN fresh f USING (id)""")
def upsert_scores(spark: SparkSession, d: str) -> DataFrame:
    old = v.pool(spark, d).groupBy("id").agg(F.min("score").alias("score"))
    return align.upsert(old, v.explored(spark, d).groupBy("id").agg(F.max("score").alias("score")))


_RANKS = ", ".join(f"row_number() OVER (ORDER BY {c} DESC, row_idx) AS r{i}" for i, c in enumerate(("mu", "cost", "vol")))
_THREE = ["mu", "cost", "vol"]


@query(f"WITH {v.PREDS}, r AS (SELECT row_idx, {_RANKS} FROM preds) SELECT row_idx, CAST(-(r0 + r1 + r2) AS DOUBLE) AS fused FROM r")
def fusion_borda_global(spark: SparkSession, d: str) -> DataFrame:
    return rank.borda(v.preds(spark, d), _THREE, out="fused").select("row_idx", "fused")


@query(f"""WITH {v.PREDS}, c AS (SELECT *, (row_number() OVER (ORDER BY row_idx) - 1) // 300 AS chunk FROM preds),
r AS (SELECT row_idx, {_RANKS.replace('OVER (', 'OVER (PARTITION BY chunk ')} FROM c) SELECT row_idx, CAST(-(r0 + r1 + r2) AS DOUBLE) AS fused FROM r""")
def fusion_borda_chunk(spark: SparkSession, d: str) -> DataFrame:
    return rank.borda(v.preds(spark, d), _THREE, chunk=300, out="fused").select("row_idx", "fused")


@query(f"WITH {v.PREDS}, r AS (SELECT row_idx, {_RANKS} FROM preds) SELECT row_idx, round(-(r0 * CAST(0.5 AS DOUBLE) + r1 * CAST(0.25 AS DOUBLE) + r2 * CAST(0.25 AS DOUBLE)), 6) AS fused FROM r")
def fusion_borda_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rank.borda(v.preds(spark, d), _THREE, weights=[2.0, 1.0, 1.0], out="fused").select("row_idx", F.round("fused", 6).alias("fused"))


@query(f"""WITH {v.PREDS}, r AS (SELECT row_idx, {_RANKS}, CAST(count(*) OVER () AS DOUBLE) AS n FROM preds),
m AS (SELECT row_idx, r0 / n AS a, r1 / n AS b, r2 / n AS c, (r0 / n + r1 / n + r2 / n) / 3.0 AS m FROM r)
SELECT row_idx, round(-m + 0.2 * sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3.0), 6) AS u FROM m""")
def fusion_rank_disagreement_ucb(spark: SparkSession, d: str) -> DataFrame:
    return rank.rank_disagreement(v.preds(spark, d), _THREE).select("row_idx", F.round("u", 6).alias("u"))


@query(f"""WITH {v.POOL}, {v.PREDS}, r AS (SELECT row_number() OVER (ORDER BY mu, row_idx) - row_number() OVER (ORDER BY score, row_idx) AS d FROM preds JOIN pool USING (row_idx)),
s AS (SELECT CAST(sum(d * d) AS DOUBLE) AS d2, CAST(count(*) AS DOUBLE) AS n FROM r) SELECT round(1.0 - 6.0 * d2 / (n * (n * n - 1.0)), 6) AS rho FROM s""")
def spearman_ordinal(spark: SparkSession, d: str) -> DataFrame:
    df = v.preds(spark, d).join(v.pool(spark, d).select("row_idx", "score"), "row_idx")
    return rank.spearman(df, "mu", "score").select(F.round("rho", 6).alias("rho"))
