"""Positions in the order of large groups, and what follows from them: ranks, buckets, exact quantiles and windows over rows.

A window partitioned by group sorts each group in one task. Here rows are dealt out by ranges of (group, value), so that a group may fill all tasks; a row's number is its place in its range
plus the rows of the group in the ranges before, which are summed over one row for each group and range. The dealt rows are written once, since their ranges must not change
between counting and numbering. For groups that fit a task windows are cheaper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import shared_folder

#: What monotonically_increasing_id leaves for rows of a partition.
_WITHIN = 33


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equal in all columns, NULL to NULL."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with row_number (from 1, along `order`, NULLs first) and group_size. Rows that are equal in all columns of `order` may be numbered either way, so `order` should end with a key.

    An empty group is all rows.
    """
    spark, group, order = rows.sparkSession, list(group), list(order)
    path = shared_folder(spark)
    keys = [*group, *order]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__pos", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("__part", F.shiftright("__pos", _WITHIN))
    parts = placed.groupBy(*group, "__part").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    by_part = Window.partitionBy(*group).orderBy("__part")
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "group_size": F.sum("__n").over(Window.partitionBy(*group))})
    met = placed.alias("l").join(parts.alias("r"), _same("l", "r", [*group, "__part"]))
    number = F.col("r.__before") + F.col("l.__pos") - F.col("r.__first") + 1
    return met.select(*(F.col(f"l.{c}") for c in rows.columns), number.alias("row_number"), F.col("r.group_size"))


def ranked(rows: DataFrame, group: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """rows with a value, with row_number (by value, then tie), group_size and average_rank: equal values get the mean of their numbers.

    Values that occur once keep their number; those that occur more often are counted by Spark's partial aggregation and joined back.
    """
    group = list(group)
    path = shared_folder(rows.sparkSession)
    numbered(rows.where(F.col(value).isNotNull()), group, [value, *tie]).write.parquet(path)
    found = rows.sparkSession.read.parquet(path)
    ties = found.groupBy(*group, value).agg(F.min("row_number").alias("__low"), F.count(F.lit(1)).alias("__ties")).where("__ties > 1")
    met = found.alias("l").join(ties.alias("r"), _same("l", "r", [*group, value]), "left")
    rank = F.coalesce(F.col("r.__low") + (F.col("r.__ties") - 1) / F.lit(2.0), F.col("l.row_number").cast("double"))
    return met.select("l.*", rank.alias("average_rank"))


def bucket_of(row_number: Column, group_size: Column, buckets: int) -> Column:
    """1 to `buckets`, as right-closed cuts of equal width of the numbers 1 to n; a single row is in bucket 1."""
    return F.when(group_size > 1, F.greatest(F.lit(1).cast("long"), F.floor(((row_number - 1) * buckets + group_size - 2) / F.greatest(group_size - 1, F.lit(1))))).otherwise(F.lit(1).cast("long"))


def exact_quantiles(rows: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """group, q0, q1, ...: quantiles by linear interpolation between the two rows around (n - 1) p. Missing values and NaN are left out; a group without others is absent."""
    group = list(group)
    found = numbered(rows.select(*group, value).where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), group, [value])
    at = lambda p: (F.col("group_size") - 1) * F.lit(float(p)) + 1
    near = F.lit(False)
    for p in probabilities:
        near = near | (F.abs(F.col("row_number") - at(p)) < 1)
    x, n = F.col(value).cast("double"), F.col("row_number")

    def quantile(p: float) -> Column:
        low = F.max(F.when(n == F.floor(at(p)), x))
        high = F.max(F.when(n == F.ceil(at(p)), x))
        return low + (high - low) * F.max(at(p) - F.floor(at(p)))

    return found.where(near).groupBy(*group).agg(*(quantile(p).alias(f"q{k}") for k, p in enumerate(probabilities)))


def in_stretches(rows: DataFrame, group: Sequence[str], order: Sequence[str], *, halo: int, size: int = 1 << 16) -> DataFrame:
    """rows with row_number, group_size, stretch and own: consecutive stretches of at most `size` rows of a group, each with the last `halo` rows before it (own is false there).

    A window over up to halo + 1 rows that is partitioned by group and stretch and keeps own rows has the result of one partitioned by group, and no task holds a whole group.
    """
    size = max(size, halo + 1)
    found = numbered(rows, group, order)
    here, place = F.floor((F.col("row_number") - 1) / size), (F.col("row_number") - 1) % size
    also = (place >= size - halo) & (F.col("row_number") + (size - place) <= F.col("group_size"))
    stretches = F.when(also, F.array(here, here + 1)).otherwise(F.array(here))
    return found.withColumn("__here", here).withColumn("stretch", F.explode(stretches)).withColumn("own", F.col("stretch") == F.col("__here")).drop("__here")
