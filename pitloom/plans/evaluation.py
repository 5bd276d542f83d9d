"""Evaluation of factors against labels: 18 tables.

Ranks and buckets are those of (factor, label) pairs within a date: blocks of a date's columns are shuffled, not a row for each pair. Nothing loops over pairs on the driver. Regressions on several factors are
one least-squares problem for each date (and label): tasks reduce their rows to triangular factors, Spark merges a date's factors, Python solves for the
coefficients from one small factor, and residuals come from a join with the coefficients.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_rank
from ..functions.scalars import correlation, ratio_of
from ..operators.cross_ranks import Section, by_section
from ..operators.least_squares import fit, r_factors
from ..operators.pairwise import pair_correlations
from .factors import stack

DATE = "rebalance_date"
PAIR = ("factor_name", "label_name")


@dataclass(frozen=True)
class EvaluationSettings:
    factors: Sequence[str]
    labels: Sequence[str]
    quantiles: int = 5
    periods: int = 3

    def __post_init__(self) -> None:
        if self.quantiles < 2:
            raise ValueError("at least two quantiles")


def aligned_panel(factors: DataFrame, labels: DataFrame, s: EvaluationSettings) -> DataFrame:
    """Eligible rows that both panels have: date, security, factor and label columns."""
    right = labels.select(DATE, "ts_code", *s.labels)
    eligible = factors.where(F.coalesce("is_eligible", F.lit(False))).select(DATE, "ts_code", *s.factors)
    return eligible.join(right, [DATE, "ts_code"])


# -- rank IC ----------------------------------------------------------------------------------------------------------


def rank_ic_timeseries(aligned: DataFrame, s: EvaluationSettings) -> DataFrame:
    """Spearman for each date, factor and label, to 12 digits, so that what should be zero is; dates without enough rows are there with a NULL."""

    def of(part: Section) -> Iterator[tuple]:
        for name in part.fields:
            for label in s.labels:
                both = part.there(name) & part.there(label)
                yield name, label, part.rank_correlation(name, label, both), int(both.sum())

    return by_section(aligned, DATE, s.factors, s.labels, of, "factor_name string, label_name string, rank_ic double, universe_size long")


def rank_ic_summary(ic: DataFrame) -> DataFrame:
    out = ic.groupBy(*PAIR).agg(F.count("rank_ic").alias("observation_months"), F.avg("rank_ic").alias("ic_mean"), F.stddev_samp("rank_ic").alias("ic_std"), ratio_of(F.col("rank_ic") > 0).alias("ic_hit_rate"), F.avg("universe_size").alias("mean_universe_size"))
    return out.withColumn("icir", F.try_divide("ic_mean", F.when(F.col("ic_std") != 0, F.col("ic_std"))))


# -- quantile portfolios ----------------------------------------------------------------------------------------------


def quantile_returns(aligned: DataFrame, s: EvaluationSettings) -> DataFrame:
    """Mean return of each bucket of a date, factor and label with at least as many complete rows as buckets."""

    def of(part: Section) -> Iterator[tuple]:
        for name in part.fields:
            for label in s.labels:
                both = part.there(name) & part.there(label)
                if (n := int(both.sum())) >= s.quantiles:
                    yield from ((name, label, q, mean, n) for q, mean in part.bucket_means(name, label, both, s.quantiles))

    return by_section(aligned, DATE, s.factors, s.labels, of, "factor_name string, label_name string, quantile long, mean_return double, universe_size long", tie="ts_code")


def quantile_summary(returns: DataFrame) -> DataFrame:
    return returns.groupBy(*PAIR, "quantile").agg(F.count("mean_return").alias("observation_months"), F.avg("mean_return").alias("mean_return"), F.stddev_samp("mean_return").alias("return_std"), ratio_of(F.col("mean_return") > 0).alias("hit_rate"), F.avg("universe_size").alias("mean_universe_size"))


def spread_timeseries(returns: DataFrame, quantiles: int = 5) -> DataFrame:
    top, bottom = (F.max(F.when(F.col("quantile") == q, F.col("mean_return"))) for q in (quantiles, 1))
    out = returns.groupBy(DATE, *PAIR).agg(top.alias("top_return"), bottom.alias("bottom_return"), F.max("universe_size").alias("universe_size"))
    return out.withColumn("top_bottom_spread", F.col("top_return") - F.col("bottom_return"))


def spread_summary(spreads: DataFrame) -> DataFrame:
    x = F.col("top_bottom_spread")
    out = spreads.groupBy(*PAIR).agg(F.count(x).alias("observation_months"), F.avg(x).alias("spread_mean"), F.stddev_samp(x).alias("spread_std"), ratio_of(x > 0).alias("spread_hit_rate"))
    return out.withColumn("spread_ir", F.try_divide("spread_mean", F.when(F.col("spread_std") != 0, F.col("spread_std"))))


def monotonicity_summary(returns: DataFrame, summary: DataFrame, quantiles: int = 5) -> DataFrame:
    """For pairs with all buckets: which way the mean returns run, how closely they follow the buckets, whether every step goes
    that way, and how often that holds within a month."""
    by_bucket = Window.partitionBy(*PAIR).orderBy("quantile")
    means = summary.withColumns({"step": F.col("mean_return") - F.lag("mean_return").over(by_bucket), "rank": average_rank(PAIR, F.col("mean_return"))})
    at = lambda q: F.max(F.when(F.col("quantile") == q, F.col("mean_return")))
    whole = means.groupBy(*PAIR).agg(F.count("mean_return").alias("buckets"), at(quantiles).alias("top"), at(1).alias("bottom"), F.min("step").alias("least"), F.max("step").alias("most"), F.avg("step").alias("step"), correlation(F.col("quantile").cast("double"), F.col("rank")).alias("rank_correlation")).where(F.col("buckets") == quantiles)
    up = F.col("top") >= F.col("bottom")
    whole = whole.select(*PAIR, up.alias("up"), F.when(up, F.lit("high_minus_low")).otherwise(F.lit("low_minus_high")).alias("direction"), "rank_correlation", F.when(up, F.col("least") >= -1e-12).otherwise(F.col("most") <= 1e-12).alias("is_monotonic"), F.when(up, F.col("step")).otherwise(-F.col("step")).alias("mean_signed_step"))
    in_month = Window.partitionBy(DATE, *PAIR).orderBy("quantile")
    steps = returns.withColumn("step", F.col("mean_return") - F.lag("mean_return").over(in_month))
    months = steps.groupBy(DATE, *PAIR).agg(F.count("mean_return").alias("buckets"), F.min("step").alias("least"), F.max("step").alias("most")).where(F.col("buckets") == quantiles)
    hits = months.join(whole.select(*PAIR, "up"), list(PAIR)).groupBy(*PAIR).agg(F.avg(F.when(F.col("up"), F.col("least") >= -1e-12).otherwise(F.col("most") <= 1e-12).cast("double")).alias("monthly_monotonic_rate"), F.count(F.lit(1)).alias("observation_months"))
    return whole.drop("up").join(hits, list(PAIR), "left")


def evaluation_summary(ic: DataFrame, spread: DataFrame, monotonicity: DataFrame) -> DataFrame:
    """The three summaries side by side; observation_months is the greatest of theirs."""
    out = ic.withColumnRenamed("observation_months", "ic_months").join(spread.withColumnRenamed("observation_months", "spread_months"), list(PAIR), "left").join(monotonicity.withColumnRenamed("observation_months", "monotonic_months"), list(PAIR), "left")
    return out.withColumn("observation_months", F.greatest("ic_months", "spread_months", "monotonic_months")).drop("ic_months", "spread_months", "monotonic_months")


# -- correlation between factors --------------------------------------------------------------------------------------


def correlation_timeseries(factors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson of every unordered pair of factors (each with itself too) for each date, over eligible rows that have both."""
    eligible = factors.where(F.coalesce("is_eligible", F.lit(False)))
    return pair_correlations(eligible, [DATE], names).withColumnsRenamed({"a": "factor_a", "b": "factor_b"})


def correlation_summary(series: DataFrame) -> DataFrame:
    x = F.col("correlation")
    return series.groupBy("factor_a", "factor_b").agg(F.count(x).alias("observation_months"), F.avg(x).alias("mean_corr"), F.stddev_samp(x).alias("corr_std"), F.avg(F.abs(x)).alias("mean_abs_corr"), F.max(F.abs(x)).alias("max_abs_corr"), F.avg("pair_size").alias("mean_pair_size"))


def correlation_matrix(summary: DataFrame, names: Sequence[str]) -> DataFrame:
    """factor_name, then a column for each factor."""
    mirrored = summary.select("factor_a", "factor_b", "mean_corr").unionByName(summary.where("factor_a <> factor_b").select(F.col("factor_b").alias("factor_a"), F.col("factor_a").alias("factor_b"), "mean_corr"))
    return mirrored.groupBy(F.col("factor_a").alias("factor_name")).pivot("factor_b", list(names)).agg(F.max("mean_corr"))


# -- redundancy -------------------------------------------------------------------------------------------------------


def redundancy_coefficients(aligned: DataFrame, names: Sequence[str]) -> DataFrame:
    """date, n_obs, means, fits (for each factor: weights of all factors in its residual, r2, and the unit of its residuals), for dates with as many rows as coefficients."""
    k = len(names)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            means, fits = [], []
            for n, flat in zip(batch["n_obs"], batch["r"], strict=True):
                r = np.asarray(flat, float).reshape(-1, k + 1)
                means.append(r[0, 1:] / r[0, 0])
                one = []
                for target in range(1, k + 1):
                    found = fit(r, n, target, others := [j for j in range(1, k + 1) if j != target], least_norm=False)
                    weights = np.zeros(k)
                    weights[target - 1], weights[np.array(others) - 1] = 1, -found.slopes
                    digits = 9 if found.residual > 1e-4 * found.deviation else 13
                    one.append({"factor_name": names[target - 1], "weights": weights.tolist(), "r2": found.r2, "unit": (found.deviation or 1.0) / 10**digits})
                fits.append(one)
            yield batch[[DATE, "n_obs"]].assign(means=means, fits=fits)

    found = r_factors(aligned, [DATE], names).where(F.col("n_obs") >= k)
    return found.mapInPandas(of, f"{DATE} date, n_obs long, means array<double>, fits array<struct<factor_name: string, weights: array<double>, r2: double, unit: double>>")


def _complete(aligned: DataFrame, names: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    if len(names) < 2:
        raise ValueError("redundancy needs two factors")
    return aligned.select(DATE, "ts_code", *names, *more).dropna(subset=list(names))


def _wide_residuals(complete: DataFrame, coefficients: DataFrame, names: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """date, ts_code, more, n_obs, fits and an array of the residuals of all factors, in their order."""
    met = complete.join(F.broadcast(coefficients), DATE)  # a row for each month
    centred = F.zip_with(F.array(*(F.col(n).cast("double") for n in names)), "means", lambda x, m: x - m)

    def residual(f):
        rest = F.aggregate(F.zip_with("x", f["weights"], lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
        return F.when(f["r2"] == 1, F.lit(0.0)).otherwise(F.round(rest / f["unit"], 0) * f["unit"])

    return met.select(DATE, "ts_code", *more, "n_obs", "fits", centred.alias("x")).withColumn("residuals", F.transform("fits", residual)).drop("x")


def redundancy_residuals(aligned: DataFrame, names: Sequence[str]) -> DataFrame:
    """date, ts_code, factor_name, residual, r2, n_obs of each factor's least squares on all others and a constant, over rows that have all factors.

    Dates with fewer rows than coefficients are left out; r2 is NULL where the factor is constant, 1 (and the residual 0) where the others explain it.
    Residuals are rounded to 9 digits of the factor's deviation (13 where little is left), so that ranks don't order rounding errors.
    """
    complete = _complete(aligned, names)
    each = _wide_residuals(complete, redundancy_coefficients(complete, names), names).select(DATE, "ts_code", "n_obs", F.explode(F.arrays_zip("fits", "residuals")).alias("f"))
    return each.select(DATE, "ts_code", "f.fits.factor_name", "f.residuals", "f.fits.r2", "n_obs").withColumnRenamed("residuals", "residual")


def _residual_measures(rows: DataFrame, names: Sequence[str], s: EvaluationSettings) -> DataFrame:
    """date, factor, label, and over the rows that have the residual and the label: their number, the rank IC and the top-bottom spread."""

    def of(part: Section) -> Iterator[tuple]:
        for name in part.fields:
            for label in s.labels:
                both = part.there(name) & part.there(label)
                if n := int(both.sum()):
                    varies = part.deviation(name, both) > 1e-12
                    mean = dict(part.bucket_means(name, label, both, s.quantiles)) if varies and n >= s.quantiles else {}
                    spread = mean[s.quantiles] - mean[1] if mean else None
                    yield name, label, n, part.rank_correlation(name, label, both) if varies else None, spread

    return by_section(rows, DATE, names, s.labels, of, "factor_name string, label_name string, residual_universe_size long, residual_rank_ic double, residual_spread double", tie="ts_code")


def _with_measures(fits: DataFrame, measures: DataFrame, s: EvaluationSettings) -> DataFrame:
    base = fits.withColumn("label_name", F.explode(F.array(*map(F.lit, s.labels))))
    return base.join(measures, [DATE, *PAIR], "left").withColumn("residual_universe_size", F.coalesce("residual_universe_size", F.lit(0).cast("long")))


def redundancy_timeseries(residuals: DataFrame, aligned: DataFrame, s: EvaluationSettings) -> DataFrame:
    """date, factor, label: r2, n_obs of the regression, and over the rows that have the label: their number, the residual's rank IC and its top-bottom spread (NULL where it has no
    deviation). From residuals in long form; redundancy() makes the same of the panel without them."""
    fits = residuals.groupBy(DATE, "factor_name").agg(F.max("r2").alias("r2"), F.max("n_obs").alias("n_obs"))
    wide = residuals.groupBy(DATE, "ts_code").agg(*(F.max(F.when(F.col("factor_name") == f, F.col("residual"))).alias(f) for f in s.factors))
    return _with_measures(fits, _residual_measures(wide.join(aligned.select(DATE, "ts_code", *s.labels), [DATE, "ts_code"]), s.factors, s), s)


def redundancy(aligned: DataFrame, s: EvaluationSettings) -> DataFrame:
    """redundancy_timeseries of the panel's residuals, which stand beside its labels all the way: rows are neither stacked nor joined with themselves."""
    complete = _complete(aligned, s.factors, s.labels)
    coefficients = redundancy_coefficients(complete, s.factors)
    fits = coefficients.where(F.col(DATE).isNotNull()).select(DATE, "n_obs", F.explode("fits").alias("f")).select(DATE, "f.factor_name", "f.r2", "n_obs")
    rows = _wide_residuals(complete, coefficients, s.factors, s.labels).select(DATE, "ts_code", *s.labels, *(F.col("residuals")[k].alias(f) for k, f in enumerate(s.factors)))
    return _with_measures(fits, _residual_measures(rows, s.factors, s), s)


def redundancy_summary(series: DataFrame, evaluation: DataFrame) -> DataFrame:
    """What is left of a factor beside the others: means, deviations, ratios and hit rates of the residual's rank IC and spread, and their share of the factor's own."""
    ic, spread = F.col("residual_rank_ic"), F.col("residual_spread")
    out = series.groupBy(*PAIR).agg(
        F.count_distinct(DATE).alias("observation_months"), F.avg("r2").alias("mean_r2"), F.avg(ic).alias("residual_ic_mean"), F.stddev_samp(ic).alias("residual_ic_std"), ratio_of(ic > 0).alias("residual_ic_hit_rate"),
        F.avg(spread).alias("residual_spread_mean"), F.stddev_samp(spread).alias("residual_spread_std"), ratio_of(spread > 0).alias("residual_spread_hit_rate"), F.avg("residual_universe_size").alias("mean_residual_universe_size"),
    )
    out = out.join(evaluation.select(*PAIR, "ic_mean", "spread_mean"), list(PAIR), "left")
    over = lambda a, b: F.try_divide(F.col(a), F.when(F.col(b) != 0, F.col(b)))
    return out.withColumns({
        "residual_icir": over("residual_ic_mean", "residual_ic_std"), "residual_spread_ir": over("residual_spread_mean", "residual_spread_std"),
        "residual_ic_retention": over("residual_ic_mean", "ic_mean"), "residual_spread_retention": over("residual_spread_mean", "spread_mean"),
    })


# -- robustness -------------------------------------------------------------------------------------------------------


def robustness_periods(dates: DataFrame, periods: int = 3) -> DataFrame:
    """date, period (from 1): distinct dates in consecutive parts, the first ones larger by one. One row a month."""
    days = dates.select(DATE).distinct()
    count = days.agg(F.least(F.count(F.lit(1)), F.lit(periods)).alias("k"))
    n = F.row_number().over(Window.orderBy(DATE)) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy())
    numbered = days.crossJoin(F.broadcast(count)).withColumns({"n": n.cast("long"), "total": total})
    size, more = F.floor(F.col("total") / F.col("k")), F.col("total") % F.col("k")
    long = more * (size + 1)
    return numbered.select(DATE, (F.when(F.col("n") < long, F.floor(F.col("n") / (size + 1))).otherwise(more + F.floor((F.col("n") - long) / F.greatest(size, F.lit(1)))) + 1).cast("long").alias("period"))


def period_bounds(periods: DataFrame) -> DataFrame:
    return periods.groupBy("period").agg(F.min(DATE).alias("start_date"), F.max(DATE).alias("end_date"), F.count(F.lit(1)).alias("months"))


def subperiod_summary(ic: DataFrame, spreads: DataFrame, periods: DataFrame) -> DataFrame:
    """The rank IC and the spread of each factor and label within each period, with the period's name and bounds. Months without a spread count in its hit rate, as misses."""
    group = ["period", *PAIR]
    small = F.broadcast(periods)
    x = F.col("top_bottom_spread")
    a = ic.join(small, DATE).groupBy(*group).agg(F.count("rank_ic").alias("ic_months"), F.avg("rank_ic").alias("ic_mean"), F.stddev_samp("rank_ic").alias("ic_std"), ratio_of(F.col("rank_ic") > 0).alias("ic_hit_rate"))
    b = spreads.join(small, DATE).groupBy(*group).agg(F.avg(x).alias("spread_mean"), F.stddev_samp(x).alias("spread_std"), F.avg(F.coalesce(x > 0, F.lit(False)).cast("double")).alias("spread_hit_rate"))
    bounds = period_bounds(periods).select("period", F.col("start_date").alias("period_start"), F.col("end_date").alias("period_end"))
    out = a.join(b, group, "left").join(F.broadcast(bounds), "period")  # a row for each period
    ratio = lambda m, s: F.try_divide(F.col(m), F.when(F.col(s) != 0, F.col(s)))
    return out.withColumns({"icir": ratio("ic_mean", "ic_std"), "spread_ir": ratio("spread_mean", "spread_std"), "period_label": F.concat(F.lit("period_"), F.col("period").cast("string"))})


def robustness_summary(subperiods: DataFrame, evaluation: DataFrame) -> DataFrame:
    """How far the sub-periods agree in sign with the whole; a sub-period without a mean doesn't. NULL where the whole has no sign."""
    joined = subperiods.select("period", *PAIR, F.col("ic_mean").alias("part_ic"), F.col("spread_mean").alias("part_spread")).join(evaluation.select(*PAIR, "ic_mean", "spread_mean"), list(PAIR), "left")
    same = lambda a, b: F.when(F.max(b) != 0, F.avg(F.coalesce(F.signum(a) == F.signum(b), F.lit(False)).cast("double")))
    return joined.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("periods"), F.max("ic_mean").alias("ic_mean"), F.min("part_ic").alias("min_period_ic"), F.max("part_ic").alias("max_period_ic"), same("part_ic", "ic_mean").alias("ic_sign_consistency"), F.max("spread_mean").alias("spread_mean"), F.min("part_spread").alias("min_period_spread"), F.max("part_spread").alias("max_period_spread"), same("part_spread", "spread_mean").alias("spread_sign_consistency"))


# -- Fama-MacBeth -----------------------------------------------------------------------------------------------------


def fama_macbeth_timeseries(aligned: DataFrame, s: EvaluationSettings) -> DataFrame:
    """date, label_name, term (intercept or factor), coefficient, n_obs, regressor_count, design_rank, full_rank: least squares of least norm of the label on all factors
    and a constant, over complete rows, for dates with at least as many rows as coefficients."""
    fields, k = list(s.factors), len(s.factors) + 1
    terms = ["intercept", *fields]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for day, label, n, flat in zip(batch[DATE], batch["response"], batch["n_obs"], batch["r"], strict=True):
                found = fit(np.asarray(flat, float).reshape(-1, k + 1), n, k, range(1, k))
                out += [(day, label, t, c, n, k - 1, found.rank, found.rank == k) for t, c in zip(terms, [found.intercept, *found.slopes.tolist()], strict=True)]
            yield pd.DataFrame(out, columns=[DATE, "label_name", "term", "coefficient", "n_obs", "regressor_count", "design_rank", "full_rank"])

    found = r_factors(aligned, [DATE], fields, s.labels).where(F.col("n_obs") >= k)
    return found.mapInPandas(of, f"{DATE} date, label_name string, term string, coefficient double, n_obs long, regressor_count long, design_rank long, full_rank boolean")


def fama_macbeth_summary(series: DataFrame) -> DataFrame:
    x = F.col("coefficient")
    out = series.groupBy("label_name", "term").agg(F.count(x).alias("observation_months"), F.avg(x).alias("mean_coefficient"), F.stddev_samp(x).alias("coefficient_std"), ratio_of(x > 0).alias("positive_ratio"), F.avg("n_obs").alias("mean_n_obs"), F.avg(F.col("full_rank").cast("double")).alias("full_rank_ratio"))
    error = F.col("coefficient_std") / F.sqrt("observation_months")
    return out.withColumn("t_stat", F.try_divide("mean_coefficient", F.when(error != 0, error)))


# -- all tables -------------------------------------------------------------------------------------------------------


def evaluate(factors: DataFrame, labels: DataFrame, s: EvaluationSettings, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    """The 18 tables by name. keep(name, table) is called for the tables that others are made from, in order, and gives what they read: a caller that
    writes them and reads them back has each computed once. Without it all tables are lazy."""
    aligned = keep("aligned_panel", aligned_panel(factors, labels, s))
    out: dict[str, DataFrame] = {}

    def kept(name: str, df: DataFrame) -> DataFrame:
        out[name] = keep(name, df)
        return out[name]

    ic = kept("rank_ic_timeseries", rank_ic_timeseries(aligned, s))
    out["rank_ic_summary"] = rank_ic_summary(ic)
    returns = kept("quantile_returns", quantile_returns(aligned, s))
    out["quantile_summary"] = quantile_summary(returns)
    spreads = kept("top_bottom_spread_timeseries", spread_timeseries(returns, s.quantiles))
    out["top_bottom_spread_summary"] = spread_summary(spreads)
    out["monotonicity_summary"] = monotonicity_summary(returns, out["quantile_summary"], s.quantiles)
    summary = kept("evaluation_summary", evaluation_summary(out["rank_ic_summary"], out["top_bottom_spread_summary"], out["monotonicity_summary"]))
    correlations = kept("factor_correlation_timeseries", correlation_timeseries(factors, s.factors))
    out["factor_correlation_summary"] = correlation_summary(correlations)
    out["factor_correlation_matrix"] = correlation_matrix(out["factor_correlation_summary"], s.factors)
    if len(s.factors) > 1:
        out["redundancy_summary"] = redundancy_summary(kept("redundancy_timeseries", redundancy(aligned, s)), summary)
    periods = robustness_periods(aligned, s.periods)
    out["robustness_periods"] = period_bounds(periods)
    out["robustness_summary"] = robustness_summary(kept("subperiod_summary", subperiod_summary(ic, spreads, periods)), summary)
    out["fama_macbeth_summary"] = fama_macbeth_summary(kept("fama_macbeth_timeseries", fama_macbeth_timeseries(aligned, s)))
    return out
