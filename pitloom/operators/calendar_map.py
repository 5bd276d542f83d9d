"""Mapping dates to trading days through a dense map of days, so that the lookup is an equality join with a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def date_map(calendar: DataFrame) -> DataFrame:
    """day, next_day (first trade date after it), on_or_after, trade_idx (0-based, of on_or_after), first_day, last_day.

    Covers the day before the first trade date to the last one; its size is that of the calendar, so one
    task can order it.
    """
    numbered = calendar.select("trade_date").distinct().withColumn("trade_idx", (F.row_number().over(Window.orderBy("trade_date")) - 1).cast("long"))
    span = numbered.agg(F.date_sub(F.min("trade_date"), 1).alias("low"), F.max("trade_date").alias("high")).where("low is not null")
    days = span.select(F.explode(F.sequence("low", "high")).alias("day"), F.col("low").alias("first_day"), F.col("high").alias("last_day"))
    dense = days.join(numbered, days.day == numbered.trade_date, "left")
    later = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    now = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    return dense.select("day", "first_day", "last_day", F.min("trade_date").over(later).alias("next_day"), F.min("trade_date").over(now).alias("on_or_after"), F.min("trade_idx").over(now).alias("trade_idx"))


def map_dates(df: DataFrame, calendar: DataFrame, source: str, **wanted: str) -> DataFrame:
    """df with columns named by the keywords, each one of date_map's: map_dates(df, cal, "d", tradable="next_day").

    Dates before the calendar map like the day before its first; those after it and NULLs map to NULL.
    """
    days = date_map(calendar)
    low = days.agg(F.min("day").alias("__low"))  # one row
    probe = df.crossJoin(F.broadcast(low)).withColumn("__day", F.greatest(F.col(source), F.when(F.col(source).isNotNull(), F.col("__low"))))
    wide = days.select(F.col("day").alias("__day"), *(F.col(of).alias(name) for name, of in wanted.items()))
    return probe.join(F.broadcast(wide), "__day", "left").select(*df.columns, *wanted)
