"""Ranks and buckets over windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def average_rank(group: Sequence[str], value: Column) -> Column:
    """1-based, ties get the mean of their ranks."""
    by_value = Window.partitionBy(*group).orderBy(value)
    ties = Window.partitionBy(*group, value)
    return F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def quantile_bucket(group: Sequence[str], value: Column, tie: str, buckets: int) -> Column:
    """Bucket 1 to `buckets` of right-closed equal-width cuts of the ranks 1 to n, equal values ranked in order of `tie`.

    Not ntile: edges are interpolated between the first and the last rank. A single row is in bucket 1.
    """
    if buckets < 2:
        raise ValueError("at least two buckets")
    r = F.row_number().over(Window.partitionBy(*group).orderBy(value, tie)).cast("long")
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    # ceil((r - 1) * buckets / (n - 1)) in integers
    return F.when(n > 1, F.greatest(F.lit(1).cast("long"), F.floor(((r - 1) * buckets + n - 2) / F.greatest(n - 1, F.lit(1))))).otherwise(F.lit(1).cast("long"))
