"""A corpus pipeline of five stages: quality filter, exact dedup, near-dedup, decontamination, tokens.

Each stage takes what the one before it kept, as a Parquet table, and all but
the last return the columns of `documents`. The quality classifier is fitted on
a bounded sample of labelled rows and rejects what scores below KEEP. Null
texts are empty texts throughout: near-dedup links them with nothing, exact
dedup keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siftpool.llm import bpe, cotrain, decontam, exact, neardup
from siftpool.llm.queries import model_path, table
from siftpool.sources.state import materialize

#: Documents stay if their probability of good quality is as much.
KEEP = 0.5
#: The columns that the operators read; all others are out of their sight.
READ = ("doc_id", "text", "source", "lang", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_columns(stage: Stage) -> Stage:
    """The stage with docs' own columns, and no others, in its result."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in READ else f"_own{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@own_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model, keep=KEEP)


@own_columns
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(docs)


@own_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(docs)


@own_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, model_path())


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The stages use a trained classifier, a graph iteration and a tokenizer, which SQL has no form for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
