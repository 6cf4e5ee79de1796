import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "siftpool-warehouse"))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows and clashing names."""
    long = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
    rows = [
        (1, "", "x"),
        (2, None, None),
        (None, "alpha beta gamma delta epsilon zeta", "x"),
        (3, "alpha beta gamma delta epsilon zeta", None),
        (3, "alpha beta gamma delta epsilon zeta", None),
        (3, "alpha beta gamma delta epsilon zeta eta", "y"),
        (4, " \n\t ", "y"),
        (5, long, "z"),
        (6, long, "z"),
        (7, "one two", "z"),
        (8, "One TWO", "z"),
        (None, None, None),
    ]
    wide = [(*r, "clash", 1.5, r[0]) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, score double, id long")
