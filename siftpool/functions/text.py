"""String expressions for identifiers and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what separates an identifier from its extension.
SUFFIX = r"\s\|.*\|"
# Fixed value: tokens of a line notation, used as a stand-in sequence tokenizer.
TOKEN = r"\[[^\]]+\]|[A-Za-z][a-z]?|[0-9]|[^A-Za-z0-9\s]"


def strip_suffix(c: Column, pattern: str = SUFFIX) -> Column:
    """The text before the first match of pattern."""
    return F.element_at(F.split(c, pattern), 1)


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    """All matches, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def normal_header(df: DataFrame) -> DataFrame:
    """Column names trimmed and lower-cased."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def pick(df: DataFrame, part: str) -> str:
    """The first column whose name contains part; ValueError if there is none."""
    for c in df.columns:
        if part in c:
            return c
    raise ValueError(f"no column name contains {part!r}")
