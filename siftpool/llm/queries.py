"""The ten operators over their whole tables, with production parameters, and the SQL that checks them where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotrain, decontam, exact, htmlcut, langid, neardup, secrets, sharding, spans

#: Place of the public tokenizer's model; SIFTPOOL_BPE_MODEL names another.
MODEL_FILE = "piece_bpe_32k.model"


def model_path() -> str:
    if path := os.environ.get("SIFTPOOL_BPE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL_FILE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"))
    placed = sharding.assign_shards(rows, "group", shards=8, vnodes=64, load=1.0, digest="doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.dedup_spans(docs)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), model_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    models = langid.train(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), models).drop("text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    scored = cotrain.score(docs, model)
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_groups(table(spark, sf_dir, "documents"), percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_substring_dedup, op3_secrets, op4_html_text, op5_exact_dedup, op6_decontamination, op7_sentencepiece, op8_language_id, op9_quality, op10_minhash, pipeline)
    return {f.__name__: f for f in own}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = "[array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]"


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express on whole tables; the others are held against brute force in tests/llm."""
    return {
        "op5_exact_dedup": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
            FROM t""",
        "op6_decontamination": rf"""
            WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
            items AS (SELECT item_id, row_number() OVER () AS nth, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
            parts AS (SELECT DISTINCT nth, item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_RUNS} END) AS s FROM items WHERE len(w) > 0),
            sizes AS (SELECT nth, count(*) AS n_shingles FROM parts GROUP BY nth),
            held AS (SELECT row_number() OVER () AS row, doc_id, w FROM words WHERE len(w) > 0),
            shingles AS (SELECT row, doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_RUNS} END) AS s FROM held),
            found AS (SELECT row, doc_id, nth, item_id, count(DISTINCT s) AS n_found FROM shingles JOIN parts USING (s) GROUP BY ALL)
            SELECT doc_id, item_id, n_found, n_shingles, n_found / n_shingles AS containment FROM found JOIN sizes USING (nth) WHERE n_found >= 0.8 * n_shingles - 1e-9""",
        "op10_minhash": rf"""
            WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
            sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct({_RUNS})) END AS s FROM words),
            classes AS MATERIALIZED (SELECT md5(array_to_string(s, chr(10))) AS c, any_value(s) AS s, len(any_value(s)) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY 1),
            shingles AS MATERIALIZED (SELECT least AS id, n, unnest(s) AS s FROM classes),
            links AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.id <> b.id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
              GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
            reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
            roots AS (SELECT u AS least, least(u, min(v)) AS root FROM reach GROUP BY u)
            SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, c.least, d.doc_id) AS component_id, coalesce(r.root, c.least, d.doc_id) = d.doc_id AS kept
            FROM sets d LEFT JOIN classes c ON len(d.s) > 0 AND c.c = md5(array_to_string(d.s, chr(10))) LEFT JOIN roots r ON r.least = c.least""",
    }
