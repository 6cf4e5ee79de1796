"""Queries of row addressing, caches, shards, checks of alignment, and small graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.functions import vector
from siftpool.operators import acquire, align, graph, select, split
from siftpool.plans import views as v
from siftpool.plans.registry import registry
from siftpool.plans.shaping import _EDGES, _graph
from siftpool.sources import ingest, sinks

QUERIES, SQL, query = registry()


def _mix(c: str) -> F.Column:
    """A number that every element of an array and its place go into."""
    return F.round(vector.dot(F.col(c), F.sequence(F.lit(1), F.size(c))), 4)


@query(f"WITH {v.POOL}, n AS (SELECT max(row_idx) + 1 AS n FROM pool) SELECT row_idx, id, row_number() OVER (ORDER BY row_idx DESC) - 1 AS place FROM pool, n WHERE row_idx <= n - 2 AND row_idx > n - 50 AND (n - 2 - row_idx) % 3 = 0")
def slice_backwards(spark: SparkSession, d: str) -> DataFrame:
    """pool[-2:-50:-3]"""
    pool = v.pool(spark, d)
    n = pool.agg(F.max("row_idx")).first()[0] + 1
    return select.python_slice(pool, n, -2, -50, -3).select("row_idx", "id", "place")


@query(f"WITH {v.POOL} SELECT row_idx, id FROM pool WHERE row_idx = (SELECT max(row_idx) - 4 FROM pool)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    pool = v.pool(spark, d)
    return select.at(pool, -5, pool.agg(F.max("row_idx")).first()[0] + 1).select("row_idx", "id")


@query(f"WITH {v.PREDS}, k AS (SELECT row_idx FROM preds WHERE mu >= 40000) SELECT row_idx AS old_idx, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx FROM k")
def prune_renumbered(spark: SparkSession, d: str) -> DataFrame:
    kept = acquire.prune(v.preds(spark, d).withColumn("var", F.lit(0.0)), F.lit(40000.0), 0.5).select("row_idx")
    return select.renumbered(kept)


@query("""WITH t AS (SELECT vec_id, label % 4 <> 0 AS ok FROM embeddings) SELECT vec_id AS old_idx, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY vec_id) - 1 ELSE -1 END AS row_idx FROM t""")
def compact_valid(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a valid vector leave, the others close up; rows that left are told."""
    rows = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), "label")
    kept, gone = align.compacted(rows, F.col("label") % 4 != 0)
    return kept.select("old_idx", "row_idx").unionByName(gone.select(F.col("row_idx").alias("old_idx"), F.lit(-1).cast("long").alias("row_idx")))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * i)), 4) AS mix FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 = 0")
def cached_gather(spark: SparkSession, d: str) -> DataFrame:
    """Rows wanted now join those of earlier rounds; only the new ones are read."""
    e = v.table(spark, d, "embeddings").select("vec_id", "embedding")
    return align.fill_cache(e.filter("vec_id % 3 = 0"), e.filter("vec_id % 5 = 0").select("vec_id"), e, "vec_id").select("vec_id", _mix("embedding").alias("mix"))


@query(f"WITH {v.POOL}, {v.PREDS}, {v.EXPLORED}, l AS (SELECT id, max(row_idx) AS row_idx FROM pool GROUP BY id) SELECT l.id, row_idx, mu FROM l JOIN preds USING (row_idx) WHERE l.id IN (SELECT id FROM explored)")
def rows_of_ids(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows of labelled ids, by each id's last place in the pool."""
    return align.rows_of(v.explored(spark, d), v.pool(spark, d), v.preds(spark, d)).select("id", "row_idx", "mu")


@query("SELECT count(*) AS compared, count(*) FILTER (vec_id % 3 = 0) AS differ FROM (SELECT vec_id FROM (SELECT vec_id, vec_id AS row_idx FROM embeddings) ORDER BY " + v.u(2) + ", vec_id LIMIT 20)")
def alignment_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty drawn rows made again; every third row of the table was shifted."""
    e = v.table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"))
    return align.sampled_check(e, e.withColumn("x", F.when(F.col("vec_id") % 3 == 0, F.col("x") + 1).otherwise(F.col("x"))), "vec_id", "x", 20, 2)


@query("SELECT vec_id, label % 6 AS chunk, round(CASE WHEN label % 6 = 4 THEN 0 ELSE list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * i)) END, 4) AS mix FROM embeddings")
def stitch_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks 0 and 1 were stitched before, chunk 4 is missing and stays zero."""
    e = v.table(spark, d, "embeddings").withColumn("chunk", F.col("label") % 6)
    out = align.resume_stitch(e.select("vec_id", "chunk"), e.filter("chunk < 2").select("vec_id", "embedding"), e.filter("chunk > 1 AND chunk != 4"), "chunk", "vec_id", "embedding", 64, partial=True)
    return out.select("vec_id", "chunk", _mix("embedding").alias("mix"))


@query("SELECT DISTINCT label AS chunk FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id % 40 = 0)")
def pending_chunks(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings").withColumnRenamed("label", "chunk")
    return align.pending(e, e.filter("vec_id % 40 = 0"), "chunk")


@query(f"WITH {v.PREDS} SELECT row_idx, CASE WHEN row_idx // 300 = 2 THEN 0.0 ELSE mu END AS mu FROM preds")
def shard_gather(spark: SparkSession, d: str) -> DataFrame:
    """Predictions from each shard's worker; shard 2 is left out and gets zeros."""
    p = v.preds(spark, d).select("row_idx", "mu", F.floor(F.col("row_idx") / 300).alias("shard"))
    return align.gather_shards(p.drop("mu"), p.filter("shard != 2"), "row_idx", "mu", "shard", [2]).select("row_idx", "mu")


@query("SELECT doc_id, max(source) AS source, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 4 = 0 GROUP BY doc_id")
def split_rows_joined(spark: SparkSession, d: str) -> DataFrame:
    """Source rows of the split ids; the table has every row twice."""
    docs = v.table(spark, d, "documents").select("doc_id", "source")
    splits = docs.filter("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"))
    return split.joined_back(docs.unionByName(docs), splits, "doc_id").select("doc_id", "source", "split")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'new' WHEN page_id % 3 = 0 THEN 'old' ELSE 'first' END AS value FROM pages")
def shards_merged(spark: SparkSession, d: str) -> DataFrame:
    """Three key-value shards; a later one's rows take the place of an earlier one's."""
    p = v.table(spark, d, "pages").select("page_id")
    shards = [p.withColumn("value", F.lit("first")), p.filter("page_id % 3 = 0").withColumn("value", F.lit("old")), p.filter("page_id % 2 = 0").withColumn("value", F.lit("new"))]
    return sinks.merge_shards(shards, "page_id")


@query("SELECT vec_id // 64 AS batch, count(*) AS n, min(vec_id) AS first, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS x1 FROM embeddings GROUP BY 1")
def feature_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 64 rows in order, as one array each."""
    e = v.table(spark, d, "embeddings")
    batches = e.groupBy(F.floor(F.col("vec_id") / 64).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    total = F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["embedding"][0].cast("double"))
    return batches.select("batch", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["vec_id"].alias("first"), F.round(total, 4).alias("x1"))


@query("SELECT vec_id, 8 + vec_id % 20 AS size, round(list_sum(list_transform(range(1, 9 + vec_id % 20), lambda i: CAST(embedding[i] AS DOUBLE) * i)), 4) AS mix FROM embeddings")
def features_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Arrays by id, the first of two, cut to each row's number of elements."""
    e = v.table(spark, d, "embeddings")
    size = (8 + F.col("vec_id") % 20).cast("int").alias("size")
    doubled = e.select("vec_id", F.lit(0).alias("at"), "embedding").unionByName(e.select("vec_id", F.lit(1).alias("at"), F.transform("embedding", lambda x: -x).alias("embedding")))
    out = ingest.align_arrays(e.select("vec_id", size), doubled, "vec_id", "at", "embedding", "size")
    return out.select("vec_id", F.col("size").cast("long"), _mix("embedding").alias("mix"))


@query("SELECT o_orderkey, [1 + o_custkey % 7, 513 + CAST(len(o_orderpriority) AS BIGINT), 1025 + o_orderkey % 3][1] AS a, 513 + CAST(len(o_orderpriority) AS BIGINT) AS b, 1025 + o_orderkey % 3 AS c FROM orders")
def category_offsets(spark: SparkSession, d: str) -> DataFrame:
    codes = vector.offset_codes(F.array(F.col("o_custkey") % 7, F.length("o_orderpriority").cast("long"), F.col("o_orderkey") % 3))
    return v.table(spark, d, "orders").withColumn("k", codes).select("o_orderkey", *[F.col("k")[i].alias(n) for i, n in enumerate("abc")])


@query("""WITH p AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY md5(vec_id::VARCHAR || '/' || i::VARCHAR || '/0')[:13], i) AS k FROM p),
c AS (SELECT vec_id, i, CAST(x AS DOUBLE) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS place, avg(CAST(x AS DOUBLE)) OVER (PARTITION BY vec_id) AS m FROM r WHERE k <= 20)
SELECT vec_id, CAST(count(*) AS BIGINT) AS n, round(sum((x - m) * place), 4) AS mix FROM c GROUP BY vec_id""")
def crop_and_centre(spark: SparkSession, d: str) -> DataFrame:
    """Twenty drawn elements of each vector, in order, less their mean."""
    cropped = vector.crop(F.transform("embedding", lambda x: x.cast("double")), 20, F.col("vec_id"))
    out = v.table(spark, d, "embeddings").select("vec_id", vector.centred(cropped).alias("c"))
    return out.select("vec_id", F.size("c").cast("long").alias("n"), _mix("c").alias("mix"))


@query("SELECT vec_id, 7 AS rows, round(list_sum(list_transform(range(1, 6), lambda i: list_sum(list_transform(range(1, 6), lambda j: CAST(embedding[(i - 1) * 5 + j] AS DOUBLE) * ((i - 1) * 7 + j))))), 4) AS mix FROM embeddings")
def pad_square(spark: SparkSession, d: str) -> DataFrame:
    """A matrix of five rows in one of seven."""
    square = F.array(*[F.transform(F.slice("embedding", 5 * i + 1, 5), lambda x: x.cast("double")) for i in range(5)])
    out = v.table(spark, d, "embeddings").select("vec_id", vector.pad_2d(square, 7).alias("m"))
    return out.withColumn("f", F.flatten("m")).select("vec_id", F.size("m").alias("rows"), _mix("f").alias("mix"))


@query(f"WITH {_EDGES}, n AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) - 1 AS arc FROM g) SELECT a.graph_id, a.src, a.dst, a.arc, b.arc AS reverse FROM n a JOIN n b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src")
def graph_reverse_arcs(spark: SparkSession, d: str) -> DataFrame:
    return graph.reverse_arcs(_graph(spark, d)[0]).withColumns({c: F.col(c).cast("long") for c in ("arc", "reverse")})


@query(f"WITH {_EDGES} SELECT a.graph_id, a.v AS src, b.v AS dst, (a.v % 4) * 4 + b.v % 4 AS pair_type, CASE WHEN a.v = b.v OR g.src IS NOT NULL THEN 0.0 ELSE -1.0 END::DOUBLE AS bias FROM x a JOIN x b USING (graph_id) LEFT JOIN g ON g.graph_id = a.graph_id AND g.src = a.v AND g.dst = b.v")
def graph_pair_types(spark: SparkSession, d: str) -> DataFrame:
    edges, vertices = _graph(spark, d)
    return graph.pair_types(vertices.withColumn("kind", F.col("v") % 4), edges, "kind", 4)


@query("SELECT l_orderkey AS graph_id, round(avg(l_quantity), 6) AS mean, round(sum(l_quantity), 4) AS sum, round(sum(l_quantity) / 100, 6) AS norm FROM lineitem GROUP BY l_orderkey")
def graph_readout(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines stand for a graph's vertices."""
    out = graph.readout(v.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "graph_id"), "l_quantity")
    return out.select("graph_id", F.round("mean", 6).alias("mean"), F.round("sum", 4).alias("sum"), F.round("norm", 6).alias("norm"))
