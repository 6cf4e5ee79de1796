"""Operators on tables of at most twenty rows with known answers, and their invariants."""

import json
import math

import pyspark.sql.functions as F
import pytest

from siftpool.functions import math as fm
from siftpool.functions import text, vector
from siftpool.operators import acquire, align, graph, loop, metrics, rank, select, split, surrogate
from siftpool.sources import ingest, sinks
from siftpool.streaming.leaders import windowed


@pytest.fixture(scope="module")
def preds(spark):
    rows = [(i, float((i * 7) % 10), 0.0 if i % 3 == 0 else 4.0) for i in range(20)]
    return spark.createDataFrame(rows, "row_idx long, mu double, var double")


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_normal_functions(spark):
    z = [(x / 4,) for x in range(-20, 21)]
    for r in spark.createDataFrame(z, "z double").select("z", fm.normal_cdf(F.col("z")).alias("c"), fm.softplus(F.col("z") * 300).alias("s")).collect():
        assert abs(r["c"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-7
        assert math.isclose(r["s"], max(r["z"] * 300, 0) + math.log1p(math.exp(-abs(r["z"] * 300))))


def test_acquisition_invariants(spark, preds):
    u = lambda name, df=preds, **k: {r["row_idx"]: r["u"] for r in acquire.utility(name, df, **k).collect()}
    assert u("ucb", beta=0.0) == u("greedy")
    flat = preds.withColumn("var", F.lit(0.0))
    assert u("ucb", flat) == u("greedy", flat) == u("lcb", flat) == u("thompson", flat)
    ei, pi = u("ei", best=F.lit(5.0)), u("pi", best=F.lit(5.0))
    mu = {r["row_idx"]: r["mu"] for r in preds.collect()}
    for i in range(0, 20, 3):
        assert math.isclose(ei[i], mu[i] - 5 + 0.01) and pi[i] == float(mu[i] - 5 + 0.01 > 0)
    assert sorted(u("borda").values()) == list(range(20))
    assert all(x == -1 or 0 <= x < 1 for x in u("threshold", least=5.0).values())
    assert u("random", preds.repartition(7)) == u("random", preds.coalesce(1))
    with pytest.raises(ValueError):
        acquire.utility("nothing", preds)
    with pytest.raises(ValueError):
        acquire.utility("ei", preds)
    assert acquire.compatible("greedy", {"means"}) and not acquire.compatible("lcb", {"means"})


def test_global_rank_equals_a_single_sort(spark, preds):
    got = values(rank.global_rank(preds, [F.col("mu").desc(), F.col("row_idx")], "k"), "row_idx", "k")
    order = sorted(preds.collect(), key=lambda r: (-r["mu"], r["row_idx"]))
    assert got == sorted((r["row_idx"], i + 1) for i, r in enumerate(order))


def test_borda(spark):
    df = spark.createDataFrame([(i, float(i), float(i), float(-i)) for i in range(7)], "row_idx long, a double, b double, c double")
    assert [r["mu"] for r in rank.borda(df, ["a"]).orderBy("row_idx").collect()] == [-7.0, -6.0, -5.0, -4.0, -3.0, -2.0, -1.0]
    assert {r["mu"] for r in rank.borda(df, ["a", "c"]).collect()} == {-8.0}
    chunked = [r["mu"] for r in rank.borda(df, ["a", "b"], chunk=3).orderBy("row_idx").collect()]
    assert chunked == [-6.0, -4.0, -2.0, -6.0, -4.0, -2.0, -2.0]
    assert rank.spearman(df, "a", "b").first()["rho"] == 1.0 and rank.spearman(df, "a", "c").first()["rho"] == -1.0


def test_selection(spark, preds):
    assert select.resolve(0.1, 11) == 2 and select.resolve(0.1, 19, up=False) == 1 and select.resolve(50, 20) == 20
    with pytest.raises(ValueError):
        select.resolve(0, 5)
    assert [select.batch_size([2, 3], t, 9) for t in range(3)] == [2, 3, 3]
    u = acquire.utility("greedy", preds)
    plain = values(select.top(u, "u", 5, F.col("row_idx")), "row_idx")
    assert values(select.top(select.epsilon_greedy(u, 5, 0.0, 20), "u", 5, F.col("row_idx")), "row_idx") == plain
    assert select.epsilon_greedy(u, 5, 0.5, 20).filter(F.col("u") == float("inf")).count() == 3
    strata = spark.createDataFrame([(i, 0 if i < 1 else 1 if i < 6 else 2) for i in range(20)], "row_idx long, s int")
    assert values(select.stratified(strata, "s", 6).groupBy("s").count(), "s", "count") == [(0, 1), (1, 2), (2, 5)]
    few = spark.createDataFrame([(3.0,), (1.0,), (None,)], "x double")
    assert select.kth_value(few, "x", 2).first()["kth"] == 1.0 and select.kth_value(few, "x", 9).first()["kth"] == 3.0
    assert select.kth_value(few.limit(0), "x", 2).first()["kth"] == float("-inf")
    with pytest.raises(IndexError):
        select.gather(preds, spark.createDataFrame([(20,)], "row_idx long"), 20)
    assert select.temperature(0, 5.0, 1.0) == 5.0


@pytest.mark.parametrize(("n", "c"), [(12, 4), (13, 4), (3, 5)])
def test_chunk_rules(spark, n, c):
    df = spark.range(n)
    ceil = [r[0] for r in df.select(select.chunk_ceil(F.col("id"), n, c)).collect()]
    even = [r[0] for r in df.select(select.chunk_balanced(F.col("id"), n, c)).collect()]
    assert ceil == [i // -(-n // c) for i in range(n)]
    sizes = [even.count(k) for k in range(c)]
    assert sizes == [n // c + (k < n % c) for k in range(c)] and even == sorted(even)


def test_ingest_policies(spark, tmp_path):
    path = tmp_path / "scores.csv"
    path.write_text(" Smiles ,dockScore\nA,1.5\nB,no_score\nA,2.5\nC,\nD,nan\n")
    assert values(ingest.read_scores(spark, str(path)), "id", "score", "first_idx") == [("A", 2.5, 0)]
    kept = {r["id"]: r["score"] for r in ingest.read_scores(spark, str(path), keep_failed=True).collect()}
    assert kept == {"A": 2.5, "B": None, "C": None, "D": None}
    pool = tmp_path / "pool.txt"
    pool.write_text("x1 |ext,2|\n\nx2\nx1\n")
    assert values(ingest.read_pool(spark, str(pool)), "row_idx", "id") == [(0, "x1"), (2, "x2"), (3, "x1")]
    assert ingest.read_pool(spark, str(pool), limit=2).count() == 1
    tasks = tmp_path / "tasks.csv"
    tasks.write_text("smiles,a,b\nq,1,\nr,,\n")
    assert values(ingest.read_targets(spark, str(tasks), ["smiles"]), "row_idx") == [(0,), (1,)]
    assert ingest.read_targets(spark, str(tasks), ["smiles"], skip_empty=True).first()["targets"] == [1.0, None]
    assert values(ingest.distinct_values(spark, str(tmp_path / "tas*.csv"), "smiles"), "smiles") == [("q",), ("r",)]


def test_history_and_rounds(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    record = {"round": 1, "n_labeled": 10, "best_score": -9.0, "topk_recall": 0.5, "elapsed": 1.0}
    (tmp_path / "run1" / "history.json").write_text(json.dumps([record, record | {"round": 2}]))
    assert values(ingest.read_history(spark, str(tmp_path)), "run", "round") == [("run1", 1), ("run1", 2)]
    df = spark.range(3)
    root = str(tmp_path / "state")
    assert ingest.last_complete_round(root) == 0
    sinks.write_round(df, root, 1)
    sinks.write_round(df, root, 3)
    (tmp_path / "state" / "round=3" / "_SUCCESS").unlink()
    assert ingest.last_complete_round(root) == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 0), ("b", None, 1), ("c", 3.0, 2)], "id string, score double, acq_order int")
    sinks.write_scores(df, str(tmp_path / "f"), final=True)
    assert [r["id"] for r in spark.read.csv(str(tmp_path / "f"), header=True).collect()] == ["c", "a", "b"]
    sinks.write_scores(df, str(tmp_path / "i"), final=False)
    assert [r["id"] for r in spark.read.csv(str(tmp_path / "i"), header=True).collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        sinks.write_checked(df, str(tmp_path / "x"), rows=2)
    sinks.write_checked(df.withColumn("v", F.array(F.lit(1.0))), str(tmp_path / "x"), 3, 1, "v")
    sinks.write_chunk(df, str(tmp_path / "c"), 4)
    sinks.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    sinks.write_history(spark.createDataFrame([(1, 2)], "round int, n_labeled int"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "c")).first()["chunk_id"] == 4


def test_alignment(spark):
    a, b = spark.range(5).withColumnRenamed("id", "k"), spark.range(1, 6).withColumnRenamed("id", "k")
    assert tuple(align.report(a, b, "k").first()) == (5, 5, 1, 1)
    with pytest.raises(ValueError):
        align.must_align(a, b, "k")
    align.must_align(a, a, "k")
    scores = spark.createDataFrame([(1, 2.0)], "k long, score double")
    assert {r["k"]: r["label"] for r in align.look_up(a, scores, "k").collect()} == {0: None, 1: -2.0, 2: None, 3: None, 4: None}
    with pytest.raises(ValueError):
        align.look_up(a, scores, "k", strict=True)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "y int, p double").withColumn("k", F.monotonically_increasing_id())
    m = metrics.classification(df, "y", "p", "k").first()
    assert m["accuracy"] == 0.75 and m["auc"] == 0.875
    r = metrics.regression(spark.createDataFrame([(1.0, 1.0), (3.0, 2.0)], "y double, p double"), "y", "p").first()
    assert (r["mse"], r["mae"], r["r2"]) == (0.5, 0.5, 0.5)
    scored = spark.createDataFrame([(i, s) for i, s in enumerate([3.0, None, 5.0])], "acq_order int, score double")
    assert metrics.top_average(scored, 10).first()["topk_avg"] == 8 / 3
    s = metrics.scaler(spark.createDataFrame([(1.0, None, float("nan")), (1.0, None, 4.0)], "a double, b double, c double"), ["a", "b", "c"]).first()
    assert (s["a_std"], s["b_mean"], s["b_std"], s["c_mean"], s["c_std"]) == (1.0, 0.0, 1.0, 4.0, 1.0)
    stops = metrics.moving_average_stop(spark.createDataFrame([(0, -1.0), (1, -1.0)], "iter int, topk_avg double"), 1, 0.0)
    assert [r["stop"] for r in stops.orderBy("iter").collect()] == [True, True]


def test_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    sizes = {r["split"]: r["count"] for r in split.random_split(df, "k").groupBy("split").count().collect()}
    assert sizes == {"train": 82, "val": 10, "test": 11}
    folds = [r["count"] for r in split.folds(df, "k", 4).groupBy("fold").count().collect()]
    assert sorted(folds) == [25, 26, 26, 26]
    assert split.hold_out(df, "k").filter("held_out").count() == 20
    balanced = split.class_balanced(df, F.col("k") % 4 == 0, "k").orderBy("place").collect()
    assert len(balanced) == 52 and [r["k"] % 4 == 0 for r in balanced] == [True, False] * 26


def test_vectors_and_text(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0], "Cl[nH] |x|", "q")], "a array<double>, b array<double>, s string, c string")
    r = df.select(vector.cosine(F.col("a"), F.col("a")).alias("one"), vector.cosine(F.col("a"), F.col("b")).alias("none"), vector.pad(F.col("a"), 3).alias("p"), text.strip_suffix(F.col("s")).alias("t"), text.tokens(F.col("s")).alias("k"), vector.one_hot(F.col("c"), ["x", "y"]).alias("h"), vector.is_written(F.col("b")).alias("w")).first()
    assert math.isclose(r["one"], 1.0) and r["none"] is None and r["p"] == [1.0, 2.0, 0.0] and r["t"] == "Cl[nH]" and r["k"][:2] == ["Cl", "[nH]"] and r["h"] == [0, 0, 1] and r["w"] is False
    assert spark.range(1).select(vector.padded_size(F.lit(5)).alias("w")).first()["w"] == 7
    assert text.normal_header(df.toDF(" A ", "b", "s", "c")).columns[0] == "a"


def test_shortest_paths_against_floyd_warshall(spark):
    import random

    rng = random.Random(0)
    edges, vertices, expected = [], [], set()
    for g in range(12):
        n = rng.randint(2, 7)
        far = [[0 if i == j else 99 for j in range(n)] for i in range(n)]
        for i in range(n):
            vertices.append((g, i))
            for j in range(i):
                if rng.random() < 0.3:
                    edges.append((g, i, j))
                    far[i][j] = far[j][i] = 1
        for k in range(n):
            for i in range(n):
                for j in range(n):
                    far[i][j] = min(far[i][j], far[i][k] + far[k][j])
        expected |= {(g, i, j, far[i][j]) for i in range(n) for j in range(n) if far[i][j] < 99}
    got = graph.shortest_paths(spark.createDataFrame(edges, "graph_id int, src int, dst int"), spark.createDataFrame(vertices, "graph_id int, v int"), 7)
    assert set(map(tuple, got.collect())) == expected


def test_surrogates(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + 1) for i in range(20)], "k long, x double, y double")
    w = surrogate.fit_ridge(df, ["x"], "y")
    assert abs(w[0] - 1) < 1e-9 and abs(w[1] - 2) < 1e-9
    out = surrogate.out_of_fold(split.folds(df, "k", 3), "fold", 3, "x", "y", "p").collect()
    assert all(abs(r["p"] - r["y"]) < 1e-6 for r in out)
    unfit = surrogate.stack(df, F.lit(False), ["x", "y"], "y").filter("k = 2").first()
    assert unfit["mu"] == 3.5 and unfit["var"] == 0
    vec = df.withColumn("v", F.array("x"))
    r = surrogate.ridge_vectors(vec, "v", "y", 1, 1e-6).collect()
    assert all(abs(x["mu"] - x["y"]) < 1e-3 and x["var"] >= 0 for x in r)
    assert surrogate.map_batches(df, ["x"], lambda: lambda b: b * 2, "x double").agg(F.sum("x")).first()[0] == 380.0


def test_loop_invariants(spark, tmp_path):
    pool = spark.createDataFrame([(i, f"m{i}", float((i * 37) % 101), float((i * 37) % 101) + (i % 3)) for i in range(60)], "row_idx long, id string, score double, x double")
    first = pool.filter("row_idx < 6")
    labelled, history = loop.run(pool, first, loop.line_surrogate(["x"]), 3, 4, 5)
    h = history.orderBy("round").collect()
    assert [r["n_labeled"] for r in h] == [6, 10, 14, 18]
    assert all(a["topk_recall"] <= b["topk_recall"] and a["best_score"] >= b["best_score"] for a, b in zip(h, h[1:], strict=False))
    assert labelled.select("row_idx").distinct().count() == 18 and h[-1]["topk_recall"] == 1.0
    assert loop.explore(pool, first, loop.line_surrogate(["x"]), 4, 5, 2, 0.0, 2).count() <= 14


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = windowed(spark.readStream.schema(events.schema).parquet(source))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("leaders").start()
    q.processAllAvailable()
    q.stop()
    key = ("window_start", "event_type", "n", "best")
    assert values(spark.table("leaders"), *key) == values(windowed(events), *key)


def test_tree_queries_have_the_references_size(spark, monkeypatch):
    from siftpool.plans import learning

    took = []
    for name in ("forest", "boosted"):
        monkeypatch.setattr(surrogate, name, lambda df, *_, **how: took.append(how) or df.selectExpr("*", "0D AS mu", "0D AS var"))
    learning.rf_mean_var(spark, "/root/testdata/sf0.001")
    learning.boosted_mean(spark, "/root/testdata/sf0.001")
    assert took == [{"trees": 100, "depth": 8}, {"rounds": 100}]


def test_draws_are_normal_uniform_and_seeded(spark):
    for n in (200, 20_000):
        rows = spark.range(1, n + 1).select(*[fm.hash_normal(F.col("id"), s).alias(f"z{s}") for s in (0, 1)], *[fm.hash_uniform(F.col("id"), s).alias(f"u{s}") for s in (0, 1)]).toPandas()
        wide = 4 / math.sqrt(n)
        for s in (0, 1):
            z, u = rows[f"z{s}"], rows[f"u{s}"]
            assert abs(z.mean()) < wide and abs(z.std() - 1) < wide and abs(u.mean() - 0.5) < wide and abs(u.std() - math.sqrt(1 / 12)) < wide
            assert abs(z.autocorr(1)) < wide and abs(u.autocorr(1)) < wide
        assert abs(rows["z0"].corr(rows["z1"])) < wide and abs(rows["u0"].corr(rows["u1"])) < wide


def test_rounds_draw_other_rows(spark, preds):
    u = acquire.utility("greedy", preds)
    drawn = [values(select.epsilon_greedy(u, 10, 0.5, 20, seed=s).filter(F.col("u") == float("inf")), "row_idx") for s in range(4)]
    assert len({tuple(d) for d in drawn}) == 4 and all(len(d) == 5 for d in drawn)
    assert values(acquire.utility("thompson", preds, seed=1), "u") != values(acquire.utility("thompson", preds, seed=2), "u")
    splits = [values(split.random_split(preds, "row_idx", seed=s), "row_idx", "split") for s in (0, 1)]
    assert splits[0] != splits[1]
    seen = preds.filter("row_idx < 4").select("row_idx", F.col("mu").alias("score"))
    batch = select.acquire_batch(preds, seen, "greedy", 2, 6, 0.5, seed=3).collect()
    assert len(batch) == 6 and all(r["row_idx"] >= 4 for r in batch)
    nothing = select.acquire_batch(preds, seen.limit(0), "ei", 2, 3)
    assert nothing.count() == 3


def test_shortest_paths_of_a_long_path(spark):
    edges = [(0, i, i + 1) for i in range(39)] + [(1, 0, 1), (1, 1, 2), (1, 2, 0)]
    vertices = [(0, i) for i in range(40)] + [(1, i) for i in range(4)]
    got = graph.shortest_paths(spark.createDataFrame(edges, "graph_id int, src int, dst int"), spark.createDataFrame(vertices, "graph_id int, v int"))
    expected = {(0, i, j, abs(i - j)) for i in range(40) for j in range(40)} | {(1, i, j, int(i != j)) for i in range(3) for j in range(3)} | {(1, 3, 3, 0)}
    assert set(map(tuple, got.collect())) == expected


def test_quotas_of_a_large_stratum(spark):
    df = spark.range(3000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 > 0, 1).otherwise(2).alias("s"), (F.col("id") * 37 % 3001).cast("double").alias("m"))
    got = values(select.decayed_quota(df, "s", "m", 150, 1e9), "s", "row_idx")
    for s in (1, 2):
        best = sorted(((-r["m"], r["row_idx"]) for r in df.filter(F.col("s") == s).collect()))[:150]
        assert [i for g, i in got if g == s] == sorted(i for _, i in best)


def test_slices_and_points(spark):
    pool = spark.range(23).withColumnRenamed("id", "row_idx")
    for bounds in ((None, None, 1), (-5, None, 1), (3, -3, 4), (None, None, -1), (-2, 4, -3), (30, 40, 1), (9, 2, 1)):
        got = [r["row_idx"] for r in select.python_slice(pool, 23, *bounds).orderBy("place").collect()]
        assert got == list(range(23))[slice(*bounds)], bounds
    assert select.at(pool, -1, 23).first()["row_idx"] == 22
    for row in (23, -24):
        with pytest.raises(IndexError):
            select.at(pool, row, 23)


def test_vector_files_and_snapshots(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    parts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (4, 0, 2)]
    for i, p in enumerate(parts):
        np.save(tmp_path / f"chunk_{i}.npy", p)
    np.savez(tmp_path / "all.npz", embeddings=np.concatenate(parts), smiles=np.array(list("abcdef")))
    for path, count in ((f"{tmp_path}/chunk_*.npy", 2), (f"{tmp_path}/all.npz", 1)):
        rows = ingest.read_vectors(spark, path).orderBy("file", "place").collect()
        assert np.allclose([r["vector"] for r in rows], np.concatenate(parts)) and len({r["file"] for r in rows}) == count
    root, df = str(tmp_path / "cache"), spark.range(3)
    df.write.parquet(str(tmp_path / "round"))
    assert sinks.load_snapshot(spark, root, str(tmp_path / "round")).count() == 3
    for n in (5, 7):
        sinks.save_snapshot(spark.range(n), root)
        assert sinks.load_snapshot(spark, root, str(tmp_path / "round")).count() == n
    assert sinks.prepare(spark, str(tmp_path / "t"), 6, 3) and not sinks.prepare(spark, str(tmp_path / "t"), 6, 3)
    with pytest.raises(ValueError):
        sinks.prepare(spark, str(tmp_path / "t"), 6, 4)
    chunk = spark.createDataFrame([(2, [1.0, 2.0]), (3, [0.0, 0.0])], "row_idx long, vector array<float>")
    sinks.write_slice(chunk, str(tmp_path / "t"), 1, 2, 4, 2)
    for start, end, dim in ((2, 5, 2), (1, 3, 2), (2, 4, 3)):
        with pytest.raises(ValueError):
            sinks.write_slice(chunk, str(tmp_path / "t"), 1, start, end, dim)


def test_tables_of_libraries(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;A\ny;B\nz;\nw;D\n")
    bad = spark.createDataFrame([(1,)], "row_idx long")
    got = ingest.read_pool(spark, str(tmp_path / "a.csv"), sep=";", title=False, ordinal=1, invalid=bad)
    assert values(got, "row_idx", "id") == [(0, "A"), (3, "D")]
    (tmp_path / "b.txt").write_text("p\n\nq\n")
    (tmp_path / "c.csv").write_text("SMILES,n\np,1\n,2\n")
    assert ingest.count_rows(spark, str(tmp_path / "b.txt")) == 3 and ingest.count_rows(spark, str(tmp_path / "c.csv")) == 1
    assert values(ingest.from_ids(spark, ["a", None, "b"]), "row_idx", "id") == [(0, "a"), (2, "b")]
    wide = spark.range(1000, numPartitions=7)
    assert all(r["id"] == r["row_idx"] for r in ingest.with_row_idx(wide).collect())
    ingest.must_have(spark.range(1).withColumn("extra_a", F.lit(1)), ["id"], ("extra_",))
    for required, allowed in ((["id", "x"], ()), (["id"], ("other",))):
        with pytest.raises(ValueError):
            ingest.must_have(spark.range(1).withColumn("extra_a", F.lit(1)), required, allowed)
    ids = spark.createDataFrame([(1, 2), (2, 1)], "k long, size int")
    arrays = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (2, 0, [float("nan"), 1.0])], "k long, at int, v array<double>")
    with pytest.raises(ValueError):
        ingest.align_arrays(ids, arrays, "k", "at", "v", "size")
    with pytest.raises(ValueError):
        ingest.align_arrays(ids, arrays.filter("k = 1"), "k", "at", "v", "size")


def test_shards_and_stitches_refuse_holes(spark):
    spine = spark.range(6).select(F.col("id").alias("k"), (F.col("id") / 2).cast("int").alias("s"))
    parts = spine.select("k", F.lit(1.5).alias("mu"))
    assert values(align.gather_shards(spine, parts.filter("k < 4"), "k", "mu", "s", [2]), "k", "mu") == [(i, 1.5 if i < 4 else 0.0) for i in range(6)]
    for wrong in (parts.filter("k != 1"), parts.unionByName(parts.limit(1))):
        with pytest.raises(ValueError):
            align.gather_shards(spine, wrong, "k", "mu", "s")
    vectors = spine.select("k", F.array(F.lit(1.0).cast("float")).alias("v"))
    with pytest.raises(ValueError):
        align.resume_stitch(spine, vectors.filter("k < 2"), vectors.filter("k = 3"), "s", "k", "v", 1)


def test_ridge_penalty_by_leave_one_out(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=30)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    errors = []
    for alpha in surrogate.ALPHAS:
        left = []
        for i in range(30):
            keep = np.arange(30) != i
            m, n = x[keep].mean(axis=0), y[keep].mean()
            w = np.linalg.solve((x[keep] - m).T @ (x[keep] - m) + alpha * np.eye(3), (x[keep] - m).T @ (y[keep] - n))
            left.append(y[i] - n - (x[i] - m) @ w)
        errors.append(np.mean(np.square(left)))
    weights, alpha = surrogate.ridge_cv(df, ["a", "b", "c"], "y")
    assert alpha == surrogate.ALPHAS[int(np.argmin(errors))] and np.isclose(weights[1:], np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(3), (x - x.mean(0)).T @ (y - y.mean()))).all()
    with pytest.raises(ValueError):
        surrogate.model("nothing")
    assert surrogate.model("oof") is surrogate.stack_out_of_fold


def test_loop_stops_at_budget_and_empty_pool(spark):
    pool = spark.createDataFrame([(i, f"m{i}", float(i), float(i)) for i in range(12)], "row_idx long, id string, score double, x double")
    first = pool.filter("row_idx < 3")
    learn = loop.line_surrogate(["x"])
    assert loop.explore(pool, first, learn, 4, 3, 99, 0.0, 9, budget=8).count() == 8
    assert loop.explore(pool, first, learn, 8, 3, 99, 0.0, 9).count() == 12


def test_tables_go_when_discarded(spark):
    from siftpool.sources import state

    df = state.materialize(spark.range(3), "t")
    assert df.count() == 3 and state.exists(spark, df.siftpool_path)
    state.discard(df, spark.range(1))
    assert not state.exists(spark, df.siftpool_path)
