"""Backward as-of join: for each left row the last right row of the same key at or before its time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calendar_map import map_dates


@dataclass(frozen=True)
class AsofSource:
    """A right side: its time column, the columns to bring, and what settles equal times.

    Of rows with equal key and time the one with the greatest ties wins, compared in order; NULL counts as greatest.
    """

    table: DataFrame
    time: str
    values: Sequence[str]
    ties: Sequence[str] = field(default_factory=tuple)


def asof_join(left: DataFrame, sources: Sequence[AsofSource], *, key: str, left_time: str, bucket: str | None = None) -> DataFrame:
    """left with the sources' value columns (their names must differ). A NULL left time or key finds nothing.

    All sources share one shuffle and one sort, by key, time and ties: markers for left rows and rows of each source
    are stacked, and the last non-null row of each source is carried forward. No pair is ever built.

    A key's rows meet in one task. With a bucket ("month", "year", ... as in date_trunc) those of one key and bucket do: each source's last row of a bucket is carried over to the buckets after
    it, along one row for each key and bucket.
    """
    kinds = [f"struct<{','.join(f'`{v}`:{s.table.schema[v].dataType.simpleString()}' for v in s.values)}>" for s in sources]
    payload = f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in left.schema.fields)}>"
    tie_of = {(k, t): (f"__tie{k}_{i}", s.table.schema[t].dataType) for k, s in enumerate(sources) for i, t in enumerate(s.ties)}

    def stacked(df: DataFrame, time: str, side: int, which: int) -> DataFrame:
        rows = F.struct(*(F.col(f"`{c}`") for c in (left.columns if which < 0 else sources[which].values)))
        columns = [F.col(key).alias("__key"), F.col(time).cast("date").alias("__time"), F.lit(side).alias("__side"), (rows if which < 0 else F.lit(None).cast(payload)).alias("__left")]
        columns += [(F.col(t) if k == which else F.lit(None).cast(kind)).alias(name) for (k, t), (name, kind) in tie_of.items()]
        return df.select(*columns, *((rows if k == which else F.lit(None).cast(kinds[k])).alias(f"__right{k}") for k in range(len(sources))))

    union = stacked(left, left_time, 1, -1)
    for k, s in enumerate(sources):
        union = union.unionByName(stacked(s.table.where(F.col(key).isNotNull() & F.col(s.time).isNotNull()), s.time, 0, k))
    # among equal times of one source the greatest ties come last; those of other sources are NULL there
    order = [F.asc_nulls_first("__time"), F.asc("__side"), *(F.asc_nulls_last(name) for name, _ in tie_of.values())]
    part = ["__key"]
    if bucket:
        union, part = union.withColumn("__bucket", F.date_trunc(bucket, "__time")), ["__key", "__bucket"]
    past = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = union.withColumns({f"__found{k}": F.last(f"__right{k}", ignorenulls=True).over(past) for k in range(len(sources))}).where("__side = 1")
    if bucket:
        found = _carried(found, union, sources, tie_of)
    values = [F.when(F.col("__key").isNotNull() & F.col("__time").isNotNull(), F.col(f"__found{k}.`{v}`")).alias(v) for k, s in enumerate(sources) for v in s.values]
    return found.select(*(F.col(f"__left.`{c}`").alias(c) for c in left.columns), *values)


def last_by_mark(source: AsofSource, marks: DataFrame, *, key: str) -> AsofSource:
    """The source with the last row of a key up to each mark since the mark before, which is all that an as-of join with left times among the marks can find. marks: dates in a column `mark`,
    as few as in a calendar.

    Where the tasks that make the source have a key's rows together, nothing is shuffled for it.
    """
    rows = source.table.where(F.col(key).isNotNull() & F.col(source.time).isNotNull())
    at = map_dates(rows, marks.select(F.col("mark").alias("trade_date")), source.time, __mark="on_or_after").where("__mark is not null")
    # NULL ties are greatest
    rank = F.struct(F.col(source.time).cast("date"), *(c for t in source.ties for c in (F.col(t).isNull(), F.col(t))))
    held = [c for c in dict.fromkeys([source.time, *source.values, *source.ties]) if c != key]
    last = at.groupBy(key, "__mark").agg(F.max_by(F.struct(*held), rank).alias("__row"))
    return replace(source, table=last.select(key, "__row.*"))


def _carried(found: DataFrame, union: DataFrame, sources: Sequence[AsofSource], tie_of: dict) -> DataFrame:
    """Left rows whose bucket has nothing before them get each source's last row of the buckets before."""
    n = range(len(sources))
    # NULL ties are greatest
    rank = lambda k: F.struct("__time", *(c for (j, _), (name, _) in tie_of.items() if j == k for c in (F.col(name).isNull(), F.col(name))))
    last = [F.max_by(f"__right{k}", F.when(F.col(f"__right{k}").isNotNull(), rank(k))).alias(f"__last{k}") for k in n]
    ends = union.where("__bucket is not null and __key is not null").groupBy("__key", "__bucket").agg(*last)
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("__key", "__bucket", *(F.last(f"__last{k}", ignorenulls=True).over(before).alias(f"__carry{k}") for k in n))
    met = found.join(carry, ["__key", "__bucket"], "left")
    return met.withColumns({f"__found{k}": F.coalesce(f"__found{k}", f"__carry{k}") for k in n})
