"""Queries of ingest rules, chunks, alignment, splits, sequences, vectors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.functions import text, vector
from siftpool.operators import align, graph, select, split
from siftpool.plans import views as v
from siftpool.plans.registry import registry
from siftpool.sources import ingest

QUERIES, SQL, query = registry()
_DIRTY = "raw AS (SELECT event_type AS id, CASE WHEN event_id % 30 = 0 THEN 'no_score' WHEN event_id % 31 = 0 THEN '' ELSE CAST(event_id % 97 AS VARCHAR) END AS score, event_id AS row_idx FROM events)"


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    i = F.col("event_id")
    return e.select(F.col("event_type").alias("id"), F.when(i % 30 == 0, "no_score").when(i % 31 == 0, "").otherwise((i % 97).cast("string")).alias("score"), i.alias("row_idx"))


@query(f"WITH {_DIRTY}, c AS (SELECT id, TRY_CAST(score AS DOUBLE) AS score, row_idx FROM raw) SELECT id, arg_max(score, row_idx) AS score, min(row_idx) AS first_idx FROM c WHERE score IS NOT NULL GROUP BY id")
def oracle_clean_drop(spark: SparkSession, d: str) -> DataFrame:
    return ingest.clean_scores(_dirty(spark, d), "id", "score", "row_idx")


@query(f"""WITH {_DIRTY}, c AS (SELECT id || CAST(row_idx % 50 AS VARCHAR) AS id, TRY_CAST(score AS DOUBLE) AS score, row_idx FROM raw),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_idx DESC) AS k, min(row_idx) OVER (PARTITION BY id) AS first_idx FROM c) SELECT id, score, first_idx FROM r WHERE k = 1""")
def oracle_clean_keep_null(spark: SparkSession, d: str) -> DataFrame:
    raw = _dirty(spark, d).withColumn("id", F.concat("id", (F.col("row_idx") % 50).cast("string")))
    return ingest.keep_failed_scores(raw, "id", "score", "row_idx")


@query(f"WITH {_DIRTY} SELECT count(*) AS n, count(*) - count(TRY_CAST(score AS DOUBLE)) AS unscored, min(TRY_CAST(score AS DOUBLE)) AS lo, max(TRY_CAST(score AS DOUBLE)) AS hi FROM raw")
def score_range(spark: SparkSession, d: str) -> DataFrame:
    s = _dirty(spark, d).select(ingest.number(F.col("score")).alias("s"))
    return s.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("s")).alias("unscored"), F.min("s").alias("lo"), F.max("s").alias("hi"))


@query(f"WITH {v.POOL} SELECT id, arg_max(score, row_idx) AS score, min(row_idx) AS first_idx FROM pool GROUP BY id")
def oracle_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return ingest.clean_scores(v.pool(spark, d), "id", "score", "row_idx")


@query(f"WITH {v.POOL} SELECT id, max(row_idx) AS row FROM pool GROUP BY id")
def id_to_last_row(spark: SparkSession, d: str) -> DataFrame:
    return align.last_row_of(v.pool(spark, d))


_N = "(SELECT count(*) FROM pool)"


def _chunked(spark: SparkSession, d: str, rule) -> DataFrame:  # noqa: ANN001
    pool = v.pool(spark, d)
    return pool.withColumn("chunk", rule(F.col("row_idx"), pool.count(), 7))


@query(f"WITH {v.POOL} SELECT row_idx, row_idx // CAST(ceil({_N} / 7.0) AS BIGINT) AS chunk FROM pool")
def chunk_bounds_ceil(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, select.chunk_ceil).select("row_idx", "chunk")


@query(f"""WITH {v.POOL}, s AS (SELECT {_N} // 7 AS b, {_N} % 7 AS r)
SELECT row_idx, CASE WHEN row_idx < r * (b + 1) THEN row_idx // (b + 1) ELSE (row_idx - r * (b + 1)) // greatest(b, 1) + r END AS chunk FROM pool, s""")
def chunk_bounds_balanced(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, select.chunk_balanced).select("row_idx", "chunk")


@query(f"WITH {v.POOL} SELECT row_idx, id FROM pool WHERE row_idx // CAST(ceil({_N} / 7.0) AS BIGINT) NOT IN (2, 5)")
def exclude_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, select.chunk_ceil).filter(~F.col("chunk").isin(2, 5)).select("row_idx", "id")


@query("SELECT vec_id, CASE WHEN vec_id % 10 IN (3, 4) THEN 0.0 ELSE round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) END AS total, vec_id % 10 NOT IN (3, 4) AS written FROM embeddings")
def chunk_stitch_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings")
    out = align.stitch(e, e.filter(~(F.col("vec_id") % 10).isin(3, 4)), "vec_id", "embedding", 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("vec_id", F.round(total, 4).alias("total"), vector.is_written(F.col("embedding")).alias("written"))


@query("SELECT label, count(*) AS expected, count(*) FILTER (vec_id % 10 <> 3) AS found, count(*) = count(*) FILTER (vec_id % 10 <> 3) AS complete FROM embeddings GROUP BY label")
def chunk_completeness(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings")
    return align.completeness(e, e.filter("vec_id % 10 <> 3"), "label", "vec_id")


@query(f"""WITH {v.POOL}, {v.PREDS} SELECT (SELECT count(*) FROM pool) AS n_left, (SELECT count(*) FROM preds) AS n_right,
(SELECT count(*) FROM pool WHERE row_idx NOT IN (SELECT row_idx FROM preds)) AS only_left, (SELECT count(*) FROM preds WHERE row_idx NOT IN (SELECT row_idx FROM pool)) AS only_right""")
def alignment_report(spark: SparkSession, d: str) -> DataFrame:
    return align.report(v.pool(spark, d), v.preds(spark, d), "row_idx")


_AT = f"(SELECT *, row_number() OVER (ORDER BY {v.U}, row_idx) - 1 AS pos, count(*) OVER () AS n FROM pool) z"


@query(f"WITH {v.POOL} SELECT row_idx, CASE WHEN pos < CAST(floor(0.8::DOUBLE * n) AS BIGINT) THEN 'train' WHEN pos < CAST(floor((0.8::DOUBLE + 0.1::DOUBLE) * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM {_AT}")
def split_random(spark: SparkSession, d: str) -> DataFrame:
    return split.random_split(v.pool(spark, d), "row_idx").select("row_idx", "split")


@query(f"WITH {v.POOL} SELECT row_idx, CAST(pos % 5 AS INTEGER) AS fold, CASE pos % 5 WHEN 2 THEN 'test' WHEN 3 THEN 'val' ELSE 'train' END AS split FROM {_AT}")
def split_cv(spark: SparkSession, d: str) -> DataFrame:
    return split.cross_validation(v.pool(spark, d), "row_idx", 5, 7).select("row_idx", "fold", "split")


@query(f"WITH {v.POOL} SELECT row_idx, pos < greatest(1, n // 5) AS held_out FROM {_AT}")
def split_holdout(spark: SparkSession, d: str) -> DataFrame:
    return split.hold_out(v.pool(spark, d), "row_idx").select("row_idx", "held_out")


@query(f"WITH {v.POOL} SELECT row_idx, CASE WHEN pos < CAST(floor((1 - 0.25::DOUBLE) * n) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM {_AT}")
def split_two_way(spark: SparkSession, d: str) -> DataFrame:
    return split.two_way(v.pool(spark, d), "row_idx", 0.25).select("row_idx", "split")


@query(f"WITH {v.POOL} SELECT row_idx, CASE WHEN row_idx % 9 = 0 THEN 'test' ELSE 'train' END AS split FROM pool")
def split_predetermined(spark: SparkSession, d: str) -> DataFrame:
    pool = v.pool(spark, d)
    fixed = pool.filter("row_idx % 9 = 0").select("row_idx", F.lit("test").alias("split"))
    return split.predetermined(pool, fixed, "row_idx").select("row_idx", "split")


@query(f"""WITH l AS (SELECT doc_id AS row_idx, toxic FROM labels WHERE toxic IS NOT NULL), r AS (SELECT row_idx, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {v.U}, row_idx) - 1 AS p FROM l)
SELECT row_idx, toxic, p * 2 + 1 - toxic AS place FROM r WHERE p < (SELECT least(sum(toxic), sum(1 - toxic)) FROM l)""")
def split_class_balanced(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "labels").select(F.col("doc_id").alias("row_idx"), "toxic")
    return split.class_balanced(rows, F.col("toxic") == 1, "row_idx").select("row_idx", "toxic", F.col("place").cast("long"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\[[^\\]]+\\]|[A-Za-z][a-z]?|[0-9]|[^A-Za-z0-9\\s]')) AS n, md5(array_to_string(regexp_extract_all(text, '\\[[^\\]]+\\]|[A-Za-z][a-z]?|[0-9]|[^A-Za-z0-9\\s]'), ' ')) AS digest FROM documents")
def seq_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = text.tokens(F.col("text"))
    return v.table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ")).alias("digest"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '|kept|' ELSE url END AS id FROM pages")
def suffix_strip(spark: SparkSession, d: str) -> DataFrame:
    """An extension goes, with what follows it; bars without a space in front stay; other rows are untouched."""
    kind = F.col("page_id") % 3
    given = F.concat("url", F.when(kind == 0, F.lit(" |ext,1| tail |x|")).when(kind == 1, F.lit("|kept|")).otherwise(F.lit("")))
    return v.table(spark, d, "pages").select("page_id", text.strip_suffix(given).alias("id"))


@query("SELECT doc_id, CAST(coalesce(lang = 'en', false) AS INTEGER) AS h1, CAST(coalesce(lang = 'de', false) AS INTEGER) AS h2, CAST(NOT coalesce(lang IN ('en', 'de'), false) AS INTEGER) AS h3 FROM documents")
def onehot_unknown(spark: SparkSession, d: str) -> DataFrame:
    hot = vector.one_hot(F.col("lang"), ["en", "de"])
    return v.table(spark, d, "documents").select("doc_id", hot[0].alias("h1"), hot[1].alias("h2"), hot[2].alias("h3"))


@query("SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS item FROM lineitem")
def distribute_flatten(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array("l_partkey", "l_suppkey")).alias("item"))


@query("""WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY l_orderkey), s AS (SELECT CAST(ceil((max(len(q)) + 1) / 4.0) * 4 - 1 AS BIGINT) AS w FROM o)
SELECT l_orderkey, w AS width, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * i)), 4) AS mix, CASE WHEN len(q) < w THEN 0.0 ELSE q[-1] END AS tail FROM o, s""")
def pad_collate(spark: SparkSession, d: str) -> DataFrame:
    pair = F.struct("l_linenumber", "l_quantity")
    orders = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["l_quantity"]).alias("q"))
    width = orders.agg(vector.padded_size(F.max(F.size("q"))).cast("long").alias("width"))
    padded = orders.crossJoin(F.broadcast(width)).withColumn("p", vector.pad(F.col("q"), F.col("width")))
    return padded.select("l_orderkey", "width", F.round(vector.dot(F.col("p"), F.sequence(F.lit(1), F.size("p"))), 4).alias("mix"), F.element_at("p", -1).alias("tail"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i]))"


@query(f"""SELECT a.vec_id, round({_DOT}, 4) AS dot, round({_DOT} / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x)))), 5) AS cosine
FROM embeddings a, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) b""")
def vec_dot_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings")
    one = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("b"))
    a, b = F.col("embedding"), F.col("b")
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(vector.dot(a, b), 4).alias("dot"), F.round(vector.cosine(a, b), 5).alias("cosine"))


@query("SELECT vec_id, len(list_concat(embedding, embedding[1:16])) AS dim, round(list_sum(list_transform(range(1, 81), lambda i: CAST(list_concat(embedding, embedding[1:16])[i] AS DOUBLE) * i)), 4) AS mix FROM embeddings")
def vec_concat(spark: SparkSession, d: str) -> DataFrame:
    whole = vector.concat(F.col("embedding"), F.slice("embedding", 1, 16))
    return v.table(spark, d, "embeddings").select("vec_id", F.size(whole).cast("long").alias("dim"), F.round(vector.dot(whole, F.sequence(F.lit(1), F.size(whole))), 4).alias("mix"))


@query("SELECT vec_id, 24 AS n_a, 40 AS n_b, round(list_sum(list_transform(range(1, 25), lambda i: CAST(embedding[i] AS DOUBLE) * i)), 4) AS mix_a, round(list_sum(list_transform(range(1, 41), lambda i: CAST(embedding[24 + i] AS DOUBLE) * i)), 4) AS mix_b FROM embeddings")
def vec_split(spark: SparkSession, d: str) -> DataFrame:
    a, b = vector.split(F.col("embedding"), [24, 40])
    return v.table(spark, d, "embeddings").select("vec_id", F.size(a).alias("n_a"), F.size(b).alias("n_b"), *[F.round(vector.dot(p, F.sequence(F.lit(1), F.size(p))), 4).alias(f"mix_{n}") for p, n in ((a, "a"), (b, "b"))])


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * CAST(embedding[i] AS DOUBLE) * CASE WHEN i <= 32 THEN exp(1.0) ELSE 1.0 END / (exp(1.0) + 1))), 4) AS mix FROM embeddings")
def vec_softmax_concat(spark: SparkSession, d: str) -> DataFrame:
    whole = vector.softmax_concat([1.0, 0.0], vector.split(F.col("embedding"), [32, 32]))
    return v.table(spark, d, "embeddings").select("vec_id", F.round(vector.dot(whole, F.sequence(F.lit(1), F.lit(64))), 4).alias("mix"))


_EDGES = "e AS (SELECT DISTINCT r AS graph_id, a AS src, b AS dst FROM (SELECT n_regionkey AS r, n_nationkey AS a, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL AND a % 7 <> 3), g AS (SELECT graph_id, src, dst FROM e UNION SELECT graph_id, dst, src FROM e), x AS (SELECT n_regionkey AS graph_id, n_nationkey AS v FROM nation)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    nation = v.table(spark, d, "nation")
    ahead = F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    edges = nation.select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("src"), ahead.alias("dst")).filter("dst IS NOT NULL AND src % 7 <> 3")
    return edges, nation.select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("v"))


@query(f"WITH {_EDGES} SELECT x.graph_id, x.v, count(g.dst) AS degree FROM x LEFT JOIN g ON g.graph_id = x.graph_id AND g.src = x.v GROUP BY ALL")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(*_graph(spark, d))


@query(f"WITH {_EDGES} SELECT x.graph_id, x.v, CAST(coalesce(sum(g.dst), 0) AS DOUBLE) AS total FROM x LEFT JOIN g ON g.graph_id = x.graph_id AND g.src = x.v GROUP BY ALL")
def graph_neighbour_sum(spark: SparkSession, d: str) -> DataFrame:
    edges, vertices = _graph(spark, d)
    return graph.neighbour_sum(edges, vertices.withColumn("x", F.col("v").cast("double")))


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT graph_id, v AS src, v AS dst, 0 AS hops FROM x UNION SELECT p.graph_id, p.src, g.dst, p.hops + 1 FROM p JOIN g ON g.graph_id = p.graph_id AND g.src = p.dst WHERE p.hops < (SELECT count(*) FROM x))
SELECT graph_id, src, dst, min(hops) AS hops FROM p GROUP BY ALL""")
def graph_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(*_graph(spark, d))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, max(value) AS best FROM events GROUP BY ALL")
def stream_window_leaders(spark: SparkSession, d: str) -> DataFrame:
    from siftpool.streaming.leaders import windowed

    return windowed(v.table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
