"""Per-date cross-section steps on a long panel (one row for each date, security and factor).

Every statistic is taken over eligible rows with a finite value and applied to all rows. All factors go
through a step together, so that a step costs one shuffle for the panel, not one for each factor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clipped, finite
from .order import exact_quantiles

STEPS = ("winsorize", "industry_neutralize", "size_neutralize", "zscore")
DEFAULT_STEPS = STEPS
_TINY = 1e-12


def _sample(eligible: str, value: str) -> Column:
    return F.coalesce(F.col(eligible), F.lit(False)) & finite(F.col(value))


def winsorize(df: DataFrame, *, value: str, group: Sequence[str], eligible: str, lower: float, upper: float) -> DataFrame:
    """Clips to the exact quantiles (linearly interpolated); a date without a sample stays as it is."""
    q = F.percentile(F.when(_sample(eligible, value), F.col(value)), F.array(F.lit(lower), F.lit(upper))).over(Window.partitionBy(*group))
    df = df.withColumn("__q", q)
    return df.withColumn(value, clipped(F.col(value), F.coalesce(F.col("__q")[0], F.col(value)), F.coalesce(F.col("__q")[1], F.col(value)))).drop("__q")


def winsorize_by_order(df: DataFrame, *, value: str, group: Sequence[str], eligible: str, lower: float, upper: float) -> DataFrame:
    """As winsorize, for cross-sections that no task can hold: the quantiles come from positions in the order (operators/order.py) and are joined back."""
    found = exact_quantiles(df.where(_sample(eligible, value)), group, value, (lower, upper))
    met = df.join(found, list(group), "left")
    return met.withColumn(value, clipped(F.col(value), F.coalesce("q0", value), F.coalesce("q1", value))).drop("q0", "q1")


def industry_neutralize(df: DataFrame, *, value: str, group: Sequence[str], eligible: str, exposures: Sequence[str] = ("industry", "market")) -> DataFrame:
    """Subtracts the group mean. On each date the first of the exposures with any value is the grouping; rows
    without a group, groups without a sample and values that aren't finite stay as they are."""
    have = [c for c in exposures if c in df.columns]
    if not have:
        return df
    date = Window.partitionBy(*group)
    chosen = F.coalesce(*(F.when(F.max(F.col(c).isNotNull()).over(date), F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("g"))) for k, c in enumerate(have)))
    df = df.withColumn("__g", chosen)
    df = df.withColumn("__group", F.col("__g.g"))
    mean = F.avg(F.when(_sample(eligible, value), F.col(value))).over(Window.partitionBy(*group, "__group"))
    new = F.when(F.col("__group").isNotNull() & finite(F.col(value)), F.col(value) - F.coalesce(mean, F.lit(0.0))).otherwise(F.col(value))
    return df.withColumn(value, new).drop("__g", "__group")


def size_neutralize(df: DataFrame, *, value: str, group: Sequence[str], eligible: str, size: str = "total_mv") -> DataFrame:
    """Residual of the least-squares line on ln(size). Fewer than two samples: unchanged; no spread in size: the
    mean is subtracted. Rows without a positive size or a finite value stay as they are."""
    if size not in df.columns:
        return df
    date = Window.partitionBy(*group)
    x = F.when(F.col(size) > 0, F.ln(F.col(size)))
    df = df.withColumn("__x", F.when(finite(x), x))
    used = _sample(eligible, value) & F.col("__x").isNotNull()
    df = df.withColumns({"__n": F.sum(used.cast("long")).over(date), "__mx": F.avg(F.when(used, F.col("__x"))).over(date), "__my": F.avg(F.when(used, F.col(value))).over(date)})
    dx, dy = F.col("__x") - F.col("__mx"), F.col(value) - F.col("__my")
    df = df.withColumns({"__sxx": F.sum(F.when(used, dx * dx)).over(date), "__sxy": F.sum(F.when(used, dx * dy)).over(date)})
    slope = F.when(F.col("__sxx") > _TINY, F.try_divide(F.col("__sxy"), F.col("__sxx"))).otherwise(F.lit(0.0))
    fitted = F.col("__my") + slope * dx
    new = F.when((F.col("__n") >= 2) & F.col("__x").isNotNull() & finite(F.col(value)), F.col(value) - fitted).otherwise(F.col(value))
    return df.withColumn(value, new).drop("__x", "__n", "__mx", "__my", "__sxx", "__sxy")


def zscore(df: DataFrame, *, value: str, group: Sequence[str], eligible: str) -> DataFrame:
    """By the sample's mean and population deviation. Without a sample, or with one that has no spread to speak of, all NULL."""
    date = Window.partitionBy(*group)
    x = F.when(_sample(eligible, value), F.col(value))
    df = df.withColumns({"__m": F.avg(x).over(date), "__s": F.stddev_pop(x).over(date)})
    new = F.when(F.col("__s") > _TINY, F.try_divide(F.col(value) - F.col("__m"), F.col("__s")))
    return df.withColumn(value, new).drop("__m", "__s")


def preprocess(df: DataFrame, *, value: str, group: Sequence[str], steps: Sequence[str] = DEFAULT_STEPS, eligible: str = "is_eligible", lower: float = 0.01, upper: float = 0.99, exposures: Sequence[str] = ("industry", "market"), size: str = "total_mv") -> DataFrame:
    """The steps in order, on the column `value`."""
    common = {"value": value, "group": list(group), "eligible": eligible}
    for step in steps:
        if step == "winsorize":
            df = winsorize(df, **common, lower=lower, upper=upper)
        elif step == "industry_neutralize":
            df = industry_neutralize(df, **common, exposures=exposures)
        elif step == "size_neutralize":
            df = size_neutralize(df, **common, size=size)
        elif step == "zscore":
            df = zscore(df, **common)
        else:
            raise ValueError(f"no preprocessing step {step!r}; there are {', '.join(STEPS)}")
    return df
