"""Ranks by blocks of columns against ranks by windows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitloom.functions.ranks import average_rank, quantile_bucket
from pitloom.functions.scalars import correlation
from pitloom.operators import cross_ranks
from pitloom.plans import evaluation as ev
from pitloom.plans.factors import stack

NAMES = [f"factor_{c}" for c in "abcdefgh"]
S = ev.EvaluationSettings(NAMES, ["label_x", "label_y"])
KEYS = ["rebalance_date", "factor_name", "label_name"]


@pytest.fixture(scope="module")
def panel(spark):
    """Ties, missing values, NaN, negative zeros, a constant, a date with three rows, one without a label, and one that is NULL; more factors than a block has."""
    rng = np.random.default_rng(3)
    n = 160
    f = pd.DataFrame(rng.integers(-3, 4, size=(n, len(NAMES))).astype(float), columns=NAMES)
    f["factor_b"] = rng.normal(size=n)
    f["factor_c"] = 2.5
    f["factor_d"] = np.where(f["factor_d"] == 0, -0.0, f["factor_d"])
    f["label_x"], f["label_y"] = rng.normal(size=n), rng.integers(0, 3, size=n) / 7.0
    f = f.astype(object)
    f.loc[f.index % 7 == 0, "factor_a"] = None
    f.loc[f.index % 5 == 0, "label_y"] = None
    f.loc[90:, "label_y"] = None
    days = [dt.date(2024, 1, 31)] * 50 + [dt.date(2024, 2, 29)] * 40 + [dt.date(2024, 3, 29)] * 40 + [dt.date(2024, 4, 30)] * 3 + [None] * 27
    data = [(day, f"s{i * 37 % n:03d}", *row) for i, (day, row) in enumerate(zip(days, f.itertuples(index=False, name=None), strict=True))]
    df = spark.createDataFrame(data, "rebalance_date date, ts_code string, " + ", ".join(f"{c} double" for c in f.columns))
    return df.withColumn("factor_e", F.when(F.col("factor_e") == 3, F.lit(float("nan"))).otherwise(F.col("factor_e"))).persist()


def long_of(panel):
    long = stack(stack(panel, NAMES, ["rebalance_date", "ts_code", *S.labels]), S.labels, ["rebalance_date", "ts_code", "factor_name", "factor_value"], "label_name", "label_value")
    return long.withColumn("both", F.col("factor_value").isNotNull() & F.col("label_value").isNotNull())


def by_key(df, *more):
    return {tuple(r[k] for k in (*KEYS, *more)): r for r in df.collect()}


def test_rank_ic_equals_ranks_by_windows(panel):
    group = [*KEYS, "both"]
    ranked = long_of(panel).select(*group, F.when(F.col("both"), average_rank(group, F.col("factor_value"))).alias("x"), F.when(F.col("both"), average_rank(group, F.col("label_value"))).alias("y"))
    want = by_key(ranked.groupBy(*KEYS).agg(F.round(correlation(F.col("x"), F.col("y")), 12).alias("rank_ic"), F.sum(F.col("both").cast("long")).alias("universe_size")))
    got = by_key(ev.rank_ic_timeseries(panel, S))
    assert got.keys() == want.keys() and len(got) == 5 * 16
    for k, w in want.items():
        assert got[k].universe_size == w.universe_size
        assert got[k].rank_ic is None if w.rank_ic is None else got[k].rank_ic == pytest.approx(w.rank_ic, abs=1e-11), k


def test_buckets_equal_those_by_windows(panel):
    long = long_of(panel).where("both").withColumn("universe_size", F.count("*").over(Window.partitionBy(*KEYS)))
    done = long.where("universe_size >= 5").withColumn("quantile", quantile_bucket(KEYS, F.col("factor_value"), "ts_code", 5))
    want = by_key(done.groupBy(*KEYS, "quantile").agg(F.avg("label_value").alias("mean_return"), F.max("universe_size").alias("universe_size")), "quantile")
    got = by_key(ev.quantile_returns(panel, S), "quantile")
    assert got.keys() == want.keys() and got
    for k, w in want.items():
        assert (got[k].mean_return, got[k].universe_size) == (pytest.approx(w.mean_return, abs=1e-12), w.universe_size), k


def test_no_pair_of_a_factor_and_a_label_is_a_row(panel):
    """One shuffle, of a row for each block of factors: the plan has no other explosion, nor sorts of pairs."""
    rows = panel.count()
    for df in (ev.rank_ic_timeseries(panel, S), ev.quantile_returns(panel, S), ev._residual_measures(panel, NAMES, S)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and plan.count("Generate explode") == 1
    made = panel.sparkSession.sparkContext.accumulator(0)

    def counted(part):
        made.add(len(part.there(part.fields[0])))
        return ()

    assert cross_ranks.by_section(panel, "rebalance_date", NAMES, S.labels, counted, "n long").count() == 0
    assert made.value == rows * -(-len(NAMES) // cross_ranks.BLOCK) < rows * len(NAMES)


def test_redundancy_of_the_panel_equals_that_of_long_residuals(panel):
    s = ev.EvaluationSettings(["factor_b", "factor_f", "factor_g"], S.labels)
    want = by_key(ev.redundancy_timeseries(ev.redundancy_residuals(panel, s.factors), panel, s))
    made = ev.redundancy(panel, s)
    got = by_key(made)
    assert got.keys() == want.keys() and len(got) == 3 * 2 * 4
    for k, w in want.items():
        assert (got[k].n_obs, got[k].residual_universe_size) == (w.n_obs, w.residual_universe_size)
        for c in ("r2", "residual_rank_ic", "residual_spread"):
            assert got[k][c] is None if w[c] is None else got[k][c] == pytest.approx(w[c], abs=1e-9), (k, c)
    assert "ts_code#" not in "".join(x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)  # no join of rows with themselves
