"""Assertions on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_rows(df: DataFrame, keys: Sequence[str]):
    """Rows, all of them, whose key occurs more than once, as a one-row table `duplicates`."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))


def assert_unique(df: DataFrame, keys: Sequence[str], table: str) -> None:
    """An action."""
    n = duplicate_rows(df, keys).first().duplicates
    if n:
        raise ValueError(f"{table}: {n} rows share a key ({', '.join(keys)})")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each key, the last one in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*(c.desc() if hasattr(c, "desc") else F.desc(c) for c in order)))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")
