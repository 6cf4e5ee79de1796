"""Pools, scores and multi-task targets from text files, as typed DataFrames.

The row number is a column, assigned before any row is dropped. The three ways
to treat values that are no number are separate functions.
"""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from siftpool.functions.text import normal_header, pick, strip_suffix
from siftpool.sources import state


def number(c: Column) -> Column:
    """The value as a double; null where it is no number, or NaN."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def with_row_idx(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Dense row numbers in file order; order by them, never by arrival.

    Rows are written with their part and place; the parts before a row's own, a
    table with a row for each part, are added up.
    """
    held = state.materialize(df.withColumn("_seq", F.monotonically_increasing_id()), "numbered")
    sizes = held.groupBy(F.shiftright("_seq", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("a._part") > F.col("b._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    out = held.withColumn("_part", F.shiftright("_seq", 33)).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_seq").bitwiseAND((1 << 33) - 1)).drop("_part", "_seq", "_before")


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV file (gzip too) with a header, all columns text, names normalised."""
    return normal_header(spark.read.csv(path, header=True, sep=sep, multiLine=False))


def read_pool(spark: SparkSession, *paths: str, sep: str = ",", id_part: str = "smiles", limit: int | None = None, title: bool = True, ordinal: int | None = None, invalid: DataFrame | None = None) -> DataFrame:
    """(row_idx, id) of one or several libraries: .txt has an id in each line, others columns; null ids are dropped after numbering.

    title: whether the first line has names; ordinal: the id's column by place
    and not by name, needed without a title line. invalid: a table (row_idx) of
    rows to leave out, by their number before anything was dropped.
    """
    frames = []
    for path in paths:
        if path.split(".gz")[0].endswith(".txt"):
            frames.append(spark.read.text(path).select(F.trim("value").alias("id")))
        else:
            df = read_table(spark, path, sep) if title else spark.read.csv(path, header=False, sep=sep)
            frames.append(df.select(F.col(pick(df, id_part) if ordinal is None else df.columns[ordinal]).alias("id")))
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    pool = with_row_idx(whole).select("row_idx", F.nullif(strip_suffix(F.col("id")), F.lit("")).alias("id"))
    if limit is not None:
        pool = pool.filter(F.col("row_idx") < limit)
    if invalid is not None:
        pool = pool.join(invalid.select("row_idx"), "row_idx", "left_anti")
    return pool.filter(F.col("id").isNotNull())


def count_rows(spark: SparkSession, path: str, sep: str = ",", id_part: str = "smiles") -> int:
    """Lines of a .txt library; rows with an id of any other."""
    if path.split(".gz")[0].endswith(".txt"):
        return spark.read.text(path).count()
    df = read_table(spark, path, sep)
    return df.filter(F.col(pick(df, id_part)).isNotNull()).count()


def from_ids(spark: SparkSession, ids: list[str | None]) -> DataFrame:
    """(row_idx, id) of a list; nulls are dropped after numbering."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "row_idx long, id string").filter("id IS NOT NULL")


def read_vectors(spark: SparkSession, path: str, member: str = "embeddings") -> DataFrame:
    """(file, place, vector array<float>) of .npy files, or of one member of .npz files; path may be a pattern or a folder.

    A file is one task's, as the writers of chunked matrices make them; Spark
    reads files of up to 2 GB so. place is the row in the file.
    """

    def rows(frames):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                held = np.load(io.BytesIO(content), allow_pickle=False)
                values = (held[member] if hasattr(held, "files") else held).astype(np.float32, copy=False)
                for low in range(0, len(values), 4096):
                    part = values[low : low + 4096]
                    yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "place": np.arange(low, low + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, place long, vector array<float>")


def align_arrays(ids: DataFrame, features: DataFrame, key: str, order: str, vector: str, size: str) -> DataFrame:
    """ids (key, size) with the first array that features (key, order, vector) has for the key, cut to `size` elements.

    ValueError if a key has no array, or one with a missing value.
    """
    first = features.groupBy(key).agg(F.min_by(vector, order).alias(vector))
    out = ids.join(first, key, "left")
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    if not out.filter(bad).isEmpty():
        raise ValueError("some rows have no array, or one with a missing value")
    return out.withColumn(vector, F.slice(vector, 1, F.col(size)))


def must_have(df: DataFrame, required: list[str], allowed: tuple[str, ...] = ()) -> None:
    """ValueError if a required column is missing, or another one has none of the allowed prefixes."""
    missing = [c for c in required if c not in df.columns]
    other = [c for c in df.columns if c not in required and not c.startswith(tuple(allowed))]
    if missing or other:
        raise ValueError(f"missing columns: {missing}; unexpected ones: {other}")


def clean_scores(df: DataFrame, id_col: str, score_col: str, order_col: str) -> DataFrame:
    """(id, score, first_idx): rows whose score is no number are dropped; the last of an id's values holds, its first place is kept."""
    rows = df.select(F.col(id_col).alias("id"), number(F.col(score_col)).alias("score"), F.col(order_col).alias("o")).filter("id IS NOT NULL AND score IS NOT NULL")
    return rows.groupBy("id").agg(F.max_by("score", "o").alias("score"), F.min("o").alias("first_idx"))


def keep_failed_scores(df: DataFrame, id_col: str, score_col: str, order_col: str) -> DataFrame:
    """As clean_scores, but a value that is no number stays as a null score, that is, as a failed evaluation."""
    rows = df.select(F.col(id_col).alias("id"), number(F.col(score_col)).alias("score"), F.col(order_col).alias("o")).filter("id IS NOT NULL")
    return rows.groupBy("id").agg(F.max_by("score", "o").alias("score"), F.min("o").alias("first_idx"))


def read_scores(spark: SparkSession, path: str, keep_failed: bool = False, sep: str = ",", ordinals: tuple[int, int] | None = None) -> DataFrame:
    """(id, score, first_idx) from a CSV with a header; columns by name part or by ordinals."""
    df = read_table(spark, path, sep)
    names = [df.columns[i] for i in ordinals] if ordinals else [pick(df, "smiles"), pick(df, "score")]
    rows = with_row_idx(df)
    return (keep_failed_scores if keep_failed else clean_scores)(rows, *names, "row_idx")


def read_targets(spark: SparkSession, path: str, id_cols: list[str], ignore: list[str] | None = None, skip_empty: bool = False, limit: int | None = None) -> DataFrame:
    """(row_idx, ids array, targets array<double>): targets are the remaining columns, blanks are null elements."""
    df = spark.read.csv(path, header=True)
    tasks = [c for c in df.columns if c not in id_cols and c not in (ignore or [])]
    rows = with_row_idx(df)
    if limit is not None:
        rows = rows.filter(F.col("row_idx") < limit)
    out = rows.select("row_idx", F.array(*id_cols).alias("ids"), F.array(*[F.nullif(F.trim(c), F.lit("")).cast("double") for c in tasks]).alias("targets"))
    return out.filter(F.exists("targets", lambda x: x.isNotNull())) if skip_empty else out


def distinct_values(spark: SparkSession, pattern: str, column: str) -> DataFrame:
    """Distinct values of one column over all CSV files of a pattern."""
    return spark.read.csv(pattern, header=True).select(column).distinct()


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """Round records of all runs below root (one folder for each run); runs without a history are left out."""
    found = [f"{root}/{run}/history.json" for run in state.children(spark, root)]
    found = [p for p in found if state.exists(spark, p)]
    schema = "round int, n_labeled int, best_score double, topk_recall double, elapsed double"
    if not found:
        return spark.createDataFrame([], f"{schema}, run string")
    df = spark.read.schema(schema).json(found, multiLine=True)
    return df.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def last_complete_round(root: str) -> int:
    """The highest N of folders round=N that hold a _SUCCESS mark, in any store that Spark reads; 0 if there is none."""
    spark = SparkSession.getActiveSession()
    numbers = [int(n[6:]) for n in state.children(spark, root) if n.startswith("round=") and n[6:].isdigit()]
    return next((n for n in sorted(numbers, reverse=True) if state.exists(spark, f"{root}/round={n}/_SUCCESS")), 0)
