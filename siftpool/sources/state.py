"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage and outlives its writers, so a lost executor costs
a re-read and never a restart of the whole job. Paths go through Hadoop's file
systems, so the folder may lie in any store that Spark reads.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only in local mode where that is unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="siftpool-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


def own_root(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's tables."""
    return f"{shared_root(spark)}/siftpool/{spark.sparkContext.applicationId}"


def _located(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _located(spark, path)
    return bool(fs.exists(place))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no such folder."""
    fs, place = _located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; what stands at the target goes first."""
    fs, place = _located(spark, source)
    _, aim = _located(spark, target)
    fs.delete(aim, True)
    if not fs.rename(place, aim):
        raise OSError(f"{source} could not be renamed to {target}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and return a frame that reads it; discard() removes the table."""
    spark = df.sparkSession
    path = f"{own_root(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.siftpool_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables of materialize() that nothing will read any more; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "siftpool_path", None):
            fs, place = _located(df.sparkSession, path)
            fs.delete(place.getParent(), True)


def release(spark: SparkSession) -> None:
    """Remove all tables that this application has written here. Frames returned earlier cannot be read afterwards."""
    fs, place = _located(spark, own_root(spark))
    fs.delete(place, True)
