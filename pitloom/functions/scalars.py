"""Scalar expressions. A missing number is NULL, never NaN; nothing here throws under ANSI."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """As a double; what isn't a number, or is NaN, is missing."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def parsed_date(c: Column) -> Column:
    """yyyyMMdd or an ISO date (or a date or timestamp already); else NULL."""
    text = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def with_dates(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: parsed_date(F.col(n)) for n in names if n in df.columns})


def safe_log(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def safe_inverse(c: Column) -> Column:
    return F.try_divide(F.lit(1.0), c)


def safe_divide(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def at_least(c: Column, low: float) -> Column:
    """Clipped from below; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clipped(c: Column, low: Column, high: Column) -> Column:
    """Into [low, high]; NULL stays NULL, a NULL bound doesn't clip."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def correlation(x: Column, y: Column) -> Column:
    """Pearson as an aggregate over rows where both are present; NULL without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ratio_of(condition: Column) -> Column:
    """Share of rows where it is true, among those where it isn't NULL, as an aggregate."""
    return F.avg(condition.cast("double"))


def require_columns(df: DataFrame, names: Sequence[str], table: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"{table} lacks {', '.join(missing)}")


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or NULLs if the table hasn't got it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
