"""Facts about the engine on tiny tables."""

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitloom.config import Config
from pitloom.functions.ranks import average_rank, quantile_bucket
from pitloom.functions.scalars import parsed_date
from pitloom.operators import cross_section as cs
from pitloom.operators.asof import AsofSource, asof_join
from pitloom.operators.calendar_map import map_dates
from pitloom.operators.least_squares import fit, r_factors, triangular
from pitloom.operators.pairwise import pair_correlations
from pitloom.plans import evaluation as ev
from pitloom.plans import lake, quality
from pitloom.plans.factors import FACTORS, FactorRegistry, factor_panel, raw_factors
from pitloom.plans.labels import LABELS, LabelSpec, label_panel
from pitloom.research.experiment import Experiment, slugify
from pitloom.research.report import bar_chart, render
from pitloom.sources.market import FrameSource, Retrying
from pitloom.sources.state import IngestionState
from pitloom.sources.store import CheckFailed, Store
from pitloom.streaming.ingest import Ingestor, announcement_start, trade_date_start


def d(s):
    return dt.date.fromisoformat(s)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def calendar(spark):
    raw = spark.createDataFrame([("X", "20240130", 1, "20240129"), ("X", "20240131", 1, "20240130"), ("X", "20240201", 1, "20240131"), ("X", "20240202", 1, "20240201"), ("X", "20240203", 0, "20240202")], "exchange string, cal_date string, is_open int, pretrade_date string")
    return lake.calendar_table(raw).persist()


def test_calendar(calendar):
    assert [(str(r.trade_date), r.is_month_end) for r in calendar.orderBy("trade_date").collect()] == [("2024-01-30", False), ("2024-01-31", True), ("2024-02-01", False), ("2024-02-02", True)]
    assert calendar.orderBy("trade_date").collect()[-1].next_trade_date is None


def test_adjusted_prices(spark):
    daily = spark.createDataFrame([("A", "20240131", 10.0, 11.0, 9.0, 10.5, 10.0, 0.5, 5.0, 1.0, 1.0)], "ts_code string, trade_date string, open double, high double, low double, close double, pre_close double, change double, pct_chg double, vol double, amount double")
    factor = spark.createDataFrame([("A", "20240131", 2.0)], "ts_code string, trade_date string, adj_factor double")
    r = lake.adjusted_price_panel(daily, factor).first()
    assert (r.adj_open, r.adj_high, r.adj_low, r.adj_close) == (20, 22, 18, 21)
    assert lake.adjusted_price_panel(daily, factor.limit(0)).first().adj_open is None


def test_date_map_edges(spark, calendar):
    days = spark.createDataFrame([(d(x),) for x in ("2020-01-01", "2024-01-30", "2024-02-02", "2024-05-01")] + [(None,)], "day0 date")
    got = {r.day0: (r.after, r.at) for r in map_dates(days, calendar, "day0", after="next_day", at="on_or_after").collect()}
    assert got[d("2020-01-01")] == (d("2024-01-30"), d("2024-01-30"))
    assert got[d("2024-01-30")] == (d("2024-01-31"), d("2024-01-30"))
    assert got[d("2024-02-02")] == (None, d("2024-02-02"))
    assert got[d("2024-05-01")] == got[None] == (None, None)


def test_asof_against_pandas(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.integers(0, 4, 60).astype(str), "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, 60), "D"), "i": range(60)})
    right = pd.DataFrame({"k": rng.integers(0, 5, 80).astype(str), "u": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, 80), "D"), "tie": rng.permutation(80), "v": rng.normal(size=80)})
    best = right.sort_values(["u", "tie"]).drop_duplicates(["k", "u"], keep="last")
    want = pd.merge_asof(left.sort_values("t"), best.sort_values("u"), left_on="t", right_on="u", by="k").set_index("i")["v"]
    to = lambda f, *c: spark.createDataFrame(f).withColumns({x: F.to_date(x) for x in c})
    got = asof_join(to(left, "t"), [AsofSource(to(right, "u"), "u", ["v"], ["tie"])], key="k", left_time="t").collect()
    for r in got:
        assert (r.v is None and math.isnan(want[r.i])) or r.v == want[r.i]


def test_asof_null_tie_wins_and_null_time_finds_nothing(spark):
    left = spark.createDataFrame([("A", d("2024-01-05")), ("A", None), (None, d("2024-01-05"))], "k string, t date")
    right = spark.createDataFrame([("A", d("2024-01-05"), 1, "one"), ("A", d("2024-01-05"), None, "null"), ("A", None, 2, "no")], "k string, u date, tie int, v string")
    got = {(r.k, r.t): r.v for r in asof_join(left, [AsofSource(right, "u", ["v"], ["tie"])], key="k", left_time="t").collect()}
    assert got == {("A", d("2024-01-05")): "null", ("A", None): None, (None, d("2024-01-05")): None}


def test_statement_is_tradable_on_the_next_trade_day(spark, calendar):
    raw = spark.createDataFrame([("A", "20240130", "20240131", "20231231", 5.0), ("B", "20240131", None, "20231231", 6.0), ("C", None, None, "20231231", 1.0)], "ts_code string, ann_date string, f_ann_date string, end_date string, revenue double")
    got = {r.ts_code: r.inc_tradable_date for r in lake.statement_pit_table(raw, calendar, lake.STATEMENTS["inc"]).collect()}
    assert got == {"A": d("2024-02-01"), "B": d("2024-02-01")}


def test_universe_reasons(spark, calendar):
    stocks = spark.createDataFrame([("A.SH", "S", "M", "20240130", None), ("B.XX", "S", "M", "20240201", "20240131")], "ts_code string, exchange string, market string, list_date string, delist_date string")
    prices = spark.createDataFrame([("A.SH", d("2024-01-30"), 50.0, 1.0, 1.0), ("A.SH", d("2024-01-31"), 30.0, 1.0, 1.0), ("B.XX", d("2024-02-02"), 1.0, None, None)], "ts_code string, trade_date date, amount double, adj_factor double, adj_close double")
    rules = lake.UniverseRules(2, 20, 1, 40.0, ("M",))
    got = {(str(r.rebalance_date), r.ts_code): (r.exclude_reason, r.days_since_list) for r in lake.monthly_universe(calendar, stocks, prices, rules).collect()}
    assert got["2024-01-31", "A.SH"] == ("", 2)
    assert got["2024-01-31", "B.XX"][0] == "NOT_COMMON_A|NOT_LISTED_YET|DELISTED"
    assert got["2024-02-02", "A.SH"] == ("NO_PRICE_HISTORY", 4)
    assert "DELISTED" in got["2024-02-02", "B.XX"][0]
    with pytest.raises(ValueError):
        lake.monthly_universe(calendar, stocks, prices, lake.UniverseRules(120, markets=("M",)))


def test_ranks_and_buckets_against_pandas(spark):
    rng = np.random.default_rng(2)
    f = pd.DataFrame({"g": np.repeat(["a", "b", "c"], [5, 23, 40]), "v": rng.integers(0, 9, 68).astype(float), "ts_code": [f"{i:03d}" for i in range(68)]})
    f["rank"] = f.groupby("g")["v"].rank()
    f["bucket"] = f.groupby("g")["v"].transform(lambda v: pd.qcut(v.rank(method="first"), 5, labels=False) + 1)
    for r in spark.createDataFrame(f).withColumns({"r": average_rank(["g"], F.col("v")), "q": quantile_bucket(["g"], F.col("v"), "ts_code", 5)}).collect():
        assert r.r == r["rank"] and r.q == r.bucket


def test_preprocessing_against_numpy(spark):
    v = [1.0, 2.0, 4.0, 1000.0, None, float("inf"), 7.0]
    data = [("m", f"s{i}", i != 3, "x" if i % 2 else "y", float(10 + i), x) for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "rebalance_date string, ts_code string, is_eligible boolean, market string, total_mv double, f double")
    common = {"value": "f", "group": ["rebalance_date"]}
    used = np.array([1.0, 2.0, 4.0, 7.0])
    low, high = np.quantile(used, [0.01, 0.99])
    got = {r.ts_code: r.f for r in cs.preprocess(df, **common, steps=["winsorize"]).collect()}
    assert got["s3"] == got["s5"] == pytest.approx(high) and got["s0"] == pytest.approx(low) and got["s4"] is None
    z = {r.ts_code: r.f for r in cs.preprocess(df, **common, steps=["zscore"]).collect()}
    assert z["s1"] == pytest.approx((2 - used.mean()) / used.std())
    line = df.withColumn("f", 1 + 2 * F.ln("total_mv"))
    assert max(abs(r.f) for r in cs.preprocess(line, **common, steps=["size_neutralize"]).collect()) < 1e-12
    means = cs.preprocess(df.where("ts_code < 's3'"), **common, steps=["industry_neutralize"]).groupBy("market").agg(F.avg("f").alias("m")).collect()
    assert all(abs(r.m) < 1e-12 for r in means)
    with pytest.raises(ValueError):
        cs.preprocess(df, **common, steps=["nothing"])
    constant = cs.preprocess(df.withColumn("f", F.lit(3.0)), **common, steps=["zscore"]).collect()
    assert all(r.f is None for r in constant)


def test_factor_registry():
    assert len(FACTORS) == 24 and FACTORS.output_fields()[0] == "factor_book_to_market" and "size" in FACTORS
    with pytest.raises(ValueError):
        FactorRegistry([FACTORS.get("size"), FACTORS.get("size")])
    with pytest.raises(KeyError):
        FACTORS.get("none")
    with pytest.raises(ValueError):
        replace(FACTORS.get("size"), description="")
    assert FACTORS.families()[0] == "size_value" and {s.family for s in FACTORS.list(family="momentum")} == {"momentum"}


@pytest.fixture(scope="module")
def snapshot(spark):
    price = {"A": [10, 11, 12, 13], "B": [20, 21, 21, 19]}
    data = [(d(f"2024-0{m}-28"), d(f"2024-0{m}-28") + dt.timedelta(2), s, True, "", 2024, m, float(price[s][m - 1]), 100.0 * (1 + (s == "B")), 2.0) for s in "AB" for m in range(1, 5)]
    return spark.createDataFrame(data, "rebalance_date date, trade_execution_date date, ts_code string, is_eligible boolean, exclude_reason string, year int, month int, adj_close double, total_mv double, pb double")


def test_lagged_factors_and_panel(snapshot):
    specs = FACTORS.list(names=["reversal_1m", "momentum_3_1", "size"])
    got = {r.ts_code: r for r in raw_factors(snapshot, None, specs).where("month = 4").collect()}
    assert got["A"].factor_reversal_1m_raw == pytest.approx(-1 / 12) and got["B"].factor_reversal_1m_raw == pytest.approx(2 / 21)
    assert got["A"].factor_momentum_3_1_raw == pytest.approx(0.2) and got["B"].factor_momentum_3_1_raw == pytest.approx(0.05)
    panel = factor_panel(snapshot, None, specs, neutralize_exposures=False)
    assert abs(panel.agg(F.avg("factor_size")).first()[0]) < 1e-12
    assert panel.columns[7:9] == [f"{specs[0].field}_raw", specs[0].field]


def test_labels(spark, snapshot):
    universe = snapshot.where("ts_code = 'A'")
    prices = universe.select("ts_code", F.col("trade_execution_date").alias("trade_date"), "adj_close")
    got = label_panel(universe, prices, LABELS.list(["fwd_ret_1m", "fwd_ret_3m"])).orderBy("rebalance_date").collect()
    assert got[0].label_fwd_ret_1m == pytest.approx(0.1) and got[0].label_fwd_ret_3m == pytest.approx(0.3)
    assert got[3].label_fwd_ret_1m is None
    assert [s.months for s in LABELS.list()] == [1, 3, 6]
    with pytest.raises(ValueError):
        LabelSpec("x", 1, "text", window_rule="allow_partial_window")
    for bad in (("X", 1, "text"), ("x", 0, "text"), ("x", 1, " ")):
        with pytest.raises(ValueError):
            LabelSpec(*bad)
    assert LABELS.stages() == ["v1"] and LABELS.list(stage="v2") == [] and len(LABELS.output_fields()) == 3
    with pytest.raises(ValueError):
        LABELS.register(LABELS.get("fwd_ret_1m"))


def test_evaluation_tables(spark):
    data = [(d(f"2024-0{m}-28"), f"s{i}", True, float(i), float(i * i % 7), (0.1 if m == 1 else -0.1) * i) for m in (1, 2) for i in range(12)]
    panel = spark.createDataFrame(data, "rebalance_date date, ts_code string, is_eligible boolean, factor_a double, factor_b double, label_x double").persist()
    s = ev.EvaluationSettings(["factor_a", "factor_b"], ["label_x"])
    t = ev.evaluate(panel.drop("label_x"), panel.select("rebalance_date", "ts_code", "label_x"), s)
    assert len(t) == 18
    ic = {(r.rebalance_date.month, r.factor_name): r.rank_ic for r in t["rank_ic_timeseries"].collect()}
    assert ic[1, "factor_a"] == 1 and ic[2, "factor_a"] == -1
    spread = {(r.rebalance_date.month, r.factor_name): r.top_bottom_spread for r in t["top_bottom_spread_timeseries"].collect()}
    assert spread[1, "factor_a"] == pytest.approx(-spread[2, "factor_a"]) and spread[1, "factor_a"] > 0
    assert t["factor_correlation_timeseries"].count() == 6 and t["factor_correlation_matrix"].count() == 2
    fm = {(r.rebalance_date.month, r.term): r.coefficient for r in t["fama_macbeth_timeseries"].collect()}
    assert fm[1, "factor_a"] == pytest.approx(0.1) and fm[2, "factor_a"] == pytest.approx(-0.1)
    assert "Top ic" in render(t, title="x", factors=s.factors, labels=s.labels)


def test_regressions_against_lstsq(spark):
    """Full rank, a factor that others explain, a constant factor, and too few rows."""
    rng = np.random.default_rng(4)
    f = pd.DataFrame(rng.normal(size=(120, 3)) * [1, 0.01, 100] + [13, 0, 5], columns=["factor_a", "factor_b", "factor_c"])
    f["rebalance_date"] = np.repeat([d("2024-01-31"), d("2024-02-29"), d("2024-03-29"), d("2024-04-30")], [50, 40, 27, 3])
    f.loc[50:89, "factor_c"] = 2 * f["factor_a"] - 3 * f["factor_b"] + 1
    f.loc[90:116, "factor_b"] = 0.25
    f["label_x"] = f["factor_a"] * 0.3 + rng.normal(size=120)
    f["ts_code"] = [f"s{i:03d}" for i in range(120)]
    fields = ["factor_a", "factor_b", "factor_c"]
    panel = spark.createDataFrame(f).persist()
    got = {(r.rebalance_date, r.term): r for r in ev.fama_macbeth_timeseries(panel, ev.EvaluationSettings(fields, ["label_x"])).collect()}
    left = {(r.ts_code, r.factor_name): r for r in ev.redundancy_residuals(panel, fields).collect()}
    for day, g in f.groupby("rebalance_date"):
        x = np.column_stack([np.ones(len(g)), g[fields]])
        beta, _, rank, _ = np.linalg.lstsq(x, g["label_x"], rcond=None)
        if len(g) < 4:
            assert (day, "intercept") not in got
        else:
            assert [got[day, t].coefficient for t in ["intercept", *fields]] == pytest.approx(beta, rel=1e-6, abs=1e-9)
            assert got[day, "intercept"].design_rank == rank and got[day, "intercept"].full_rank == (rank == 4)
        for k, name in enumerate(fields):
            others = np.delete(x, k + 1, 1)
            rest = g[name] - others @ np.linalg.lstsq(others, g[name], rcond=None)[0]
            mine = [left[c, name] for c in g["ts_code"]]
            assert [r.residual for r in mine] == pytest.approx(rest.to_numpy(), abs=1e-6)
            total = ((g[name] - g[name].mean()) ** 2).sum()
            assert mine[0].r2 is None if total < 1e-20 else mine[0].r2 == pytest.approx(1 - (rest**2).sum() / total, abs=1e-6)
    with pytest.raises(ValueError):
        ev.redundancy_residuals(panel, ["factor_a"])


def test_r_factors_have_the_singular_values_of_the_rows(spark):
    """In whatever parts the rows come, with fewer rows than columns, missing values and missing groups."""
    rng = np.random.default_rng(5)
    f = pd.DataFrame(rng.normal(size=(500, 4)), columns=["a", "b", "x", "y"])
    f["day"] = [d("2024-01-31") if k < 490 else d("2024-02-29") if k < 498 else None for k in range(500)]
    f.loc[::7, "b"] = None
    f.loc[::5, "y"] = None
    df = spark.createDataFrame(f.astype(object).where(f.notna(), None), "a double, b double, x double, y double, day date")
    for parts in (1, 9):
        got = {(r.day, r.response): r for r in r_factors(df.repartition(parts), ["day"], ["a", "b"], ["x", "y"]).collect()}
        assert len(got) == 6
        for (day, label), r in got.items():
            mine = f[[x == day for x in f["day"]]].dropna(subset=["a", "b", label])
            whole = np.column_stack([np.ones(len(mine)), mine[["a", "b", label]]])
            s = np.linalg.svd(whole, compute_uv=False)
            assert r.n_obs == len(mine) and np.linalg.svd(np.array(r.r).reshape(-1, 4), compute_uv=False)[: len(s)] == pytest.approx(s)


def test_fits_of_nearly_collinear_columns_equal_lstsq():
    """To 1e-8, where sums of products would have lost all digits: fields that differ from a sum of others by 1e-7 of their deviation, exact sums, tiny and shifted columns."""
    rng = np.random.default_rng(6)
    n = 300
    x = rng.normal(size=(n, 5)) * [1, 50, 1e-4, 1, 1] + [0, 1000, 0, 3, 0]
    y = x @ [1.0, 0.02, 300.0, -1.0, 0.5] + rng.normal(size=n)
    near = x[:, 0] + 0.01 * x[:, 1] + 1e-7 * rng.normal(size=n)
    for more in ([near], [x[:, 0] - 2 * x[:, 3]], [np.full(n, 4.0)], [near, x[:, 0] - 2 * x[:, 3], x[:, 1] + x[:, 4]]):
        design = np.column_stack([np.ones(n), x, *more])
        r = triangular(triangular(np.column_stack([design, y])[:170]), np.column_stack([design, y])[170:])
        found = fit(r, n, design.shape[1], range(1, design.shape[1]))
        want, _, rank, _ = np.linalg.lstsq(design, y, rcond=None)
        assert found.rank == rank
        # the solution itself is as sensitive as the design; what it explains isn't
        centred = design[:, 1:] - design[:, 1:].mean(axis=0)
        assert centred @ found.slopes == pytest.approx(centred @ want[1:], rel=1e-8, abs=1e-8)
        if not any(column is near for column in more):
            assert [found.intercept, *found.slopes] == pytest.approx(want, rel=1e-8, abs=1e-8)
    target = fit(triangular(np.column_stack([np.ones(n), x, near])), n, 6, range(1, 6))
    rest = near - (x @ target.slopes + target.intercept)
    assert 0.5e-7 < target.residual < 2e-7 and target.residual == pytest.approx(rest.std(), rel=1e-6) and target.r2 < 1
    assert fit(triangular(np.column_stack([np.ones(n), x, x[:, 0] + x[:, 1]])), n, 6, range(1, 6)).r2 == 1


def test_redundancy_of_labels_samples_and_measures(spark):
    """A label that is missing for most rows has a sample of its own; a residual that is constant there has no rank IC."""
    rng = np.random.default_rng(7)
    f = pd.DataFrame(rng.normal(size=(60, 4)), columns=["factor_a", "factor_b", "label_x", "label_y"])
    f["rebalance_date"] = np.repeat([d("2024-01-31"), d("2024-02-29"), d("2024-03-29")], 20)
    f["ts_code"] = [f"s{i % 20:02d}" for i in range(60)]
    f.loc[f.index % 20 >= 6, "label_y"] = None
    f.loc[40:, "label_y"] = None
    panel = spark.createDataFrame(f.astype(object).where(f.notna(), None), "factor_a double, factor_b double, label_x double, label_y double, rebalance_date date, ts_code string")
    s = ev.EvaluationSettings(["factor_a", "factor_b"], ["label_x", "label_y"])
    series = ev.redundancy_timeseries(ev.redundancy_residuals(panel, s.factors), panel, s).persist()
    got = {(r.rebalance_date, r.factor_name, r.label_name): r for r in series.collect()}
    assert len(got) == 12 and {r.residual_universe_size for r in got.values()} == {20, 6, 0}
    for (day, name, label), r in got.items():
        g = f[f["rebalance_date"] == day]
        other = "factor_b" if name == "factor_a" else "factor_a"
        e = g[name] - np.polyval(np.polyfit(g[other], g[name], 1), g[other])
        there = g[label].notna()
        if there.sum():
            assert r.residual_rank_ic == pytest.approx(e[there].rank().corr(g[label][there].rank()))
        else:
            assert r.residual_rank_ic is None and r.residual_spread is None
    evaluation = spark.createDataFrame([("factor_a", "label_x", 0.0, 0.5)], "factor_name string, label_name string, ic_mean double, spread_mean double")
    table = {(r.factor_name, r.label_name): r for r in ev.redundancy_summary(series, evaluation).collect()}
    one = table["factor_a", "label_x"]
    ics = pd.Series([r.residual_rank_ic for (_, name, label), r in got.items() if (name, label) == ("factor_a", "label_x")])
    assert (one.residual_ic_std, one.residual_icir, one.residual_ic_hit_rate) == pytest.approx((ics.std(), ics.mean() / ics.std(), (ics > 0).mean()))
    assert one.residual_ic_retention is None and one.residual_spread_retention == pytest.approx(one.residual_spread_mean / 0.5)
    assert table["factor_b", "label_y"].mean_residual_universe_size == pytest.approx(4) and table["factor_b", "label_y"].observation_months == 3


def test_pair_correlations_against_pandas(spark):
    """Missing values, constant fields, fields that are constant where another is there, large means; the rows in any parts."""
    rng = np.random.default_rng(8)
    f = pd.DataFrame(rng.normal(size=(400, 5)) * [1, 1e-6, 1, 5, 1] + [1e6, 0, 0, 3, 0], columns=list("abcde"))
    f["c"] = 7.25
    f.loc[f.index % 3 == 0, "d"] = None
    f.loc[f["d"].notna(), "e"] = 0.1
    f.loc[f.index % 11 == 0, "a"] = None
    f["day"] = [d("2024-01-31") if k < 300 else d("2024-02-29") if k < 399 else None for k in range(400)]
    df = spark.createDataFrame(f.astype(object).where(f.notna(), None), "a double, b double, c double, d double, e double, day date")
    for parts in (1, 7):
        got = {(r.day, r.a, r.b): r for r in pair_correlations(df.repartition(parts), ["day"], list("abcde")).collect()}
        assert len(got) == 3 * 15
        for (day, a, b), r in got.items():
            mine = f[[x == day for x in f["day"]]]
            both = mine[[a, b]].dropna() if a != b else mine[[a, a]].dropna()
            assert (r.pair_size, r.universe_size) == (len(both), len(mine))
            x, y = both.iloc[:, 0], both.iloc[:, 1]
            want = np.corrcoef(x, y)[0, 1] if len(both) > 1 and x.std() > 1e-9 and y.std() > 1e-12 else None
            assert r.correlation is None if want is None else r.correlation == pytest.approx(want, abs=1e-9)
    assert got[d("2024-01-31"), "d", "e"].correlation is None and got[d("2024-01-31"), "c", "c"].correlation is None


def test_no_pair_of_values_is_a_row(spark):
    """Pairs come from products of matrices in tasks, whatever the number of factors."""
    df = spark.range(40_000).selectExpr("date'2024-01-31' as day", *(f"sin(id * {k}) as f{k}" for k in range(1, 7))).repartition(4)
    made = pair_correlations(df, ["day"], [f"f{k}" for k in range(1, 7)])
    assert len(made.collect()) == 21
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_checked_write_computes_its_input_once(spark, tmp_path):
    """It counts what it writes; what fails isn't published, and the table that was there stays."""
    store = Store(spark, str(tmp_path))
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    def panel(closes):
        rows = [(f"s{k}", d(f"2024-0{1 + k % 2}-10"), 1.0, float(c), 2.0, 2.0, 2.0 * c) for k, c in enumerate(closes)]
        return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, close double, adj_factor double, adj_open double, adj_close double").mapInPandas(noted, "ts_code string, trade_date date, open double, close double, adj_factor double, adj_open double, adj_close double")

    flags = quality.write_flags("adjusted_price_panel", [])
    how = {"date": "trade_date", "keys": ["ts_code", "trade_date"], "flags": flags}
    assert store.replace_checked(panel([1, 2, 3]), "prices", **how) == {"rows": 3, "primary_key_unique": 0, **dict.fromkeys(flags, 0)}
    assert read.value == 3
    assert store.read("prices").count() == 3 and store.partitions("prices") == [(2024, 1), (2024, 2)]
    wrong = panel([4, 5]).withColumn("adj_close", F.col("adj_close") + 1)
    for bad, check in ((wrong, "adj_close_formula"), (panel([1]).unionByName(panel([1])), "primary_key_unique")):
        with pytest.raises(CheckFailed, match=f"{check} 2"):
            store.replace_checked(bad, "prices", **how)
        assert store.read("prices").count() == 3
    store.replace_checked(panel([7]), "prices", **how)
    assert [r.close for r in store.read("prices").collect()] == [7.0]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["prices"]


def test_coverage_schemas_and_empty_inputs(spark, calendar):
    """Thresholds of coverage, months that differ in their columns, and tables without rows."""
    config = Config()
    warn, error = config.market_coverage_warn, config.market_coverage_error
    found = quality.coverage_issues({"price_coverage_ratio": (warn + error) / 2, "daily_basic_coverage_ratio": error / 2, "fi_coverage_ratio": 1.0}, config)
    assert [(i.check, i.level) for i in found] == [("price_coverage", "warning"), ("daily_basic_coverage", "error")]
    assert quality.coverage_issues({"price_coverage_ratio": warn}, config) == []
    assert quality.schema_consistency({"2024-01": ["a", "b"], "2024-02": ["a", "b"]}, "t") == []
    assert quality.schema_consistency({"2024-01": ["a", "b"], "2024-02": ["b", "a"]}, "t")[0].check == "partition_schema_consistency"
    for prefix, spec in lake.STATEMENTS.items():
        kinds = ", ".join(f"{c} string" for c in ("ts_code", "ann_date", "f_ann_date", "first_ann_date", "end_date", "update_flag")) + ", metric double"
        table = lake.statement_pit_table(spark.createDataFrame([], kinds), calendar, spec)
        assert table.count() == 0 and {f"{prefix}_tradable_date", f"{prefix}_report_period", f"{prefix}_metric"} <= set(table.columns)
    empty = ev.rank_ic_timeseries(spark.createDataFrame([], "rebalance_date date, ts_code string, factor_a double, label_x double"), ev.EvaluationSettings(["factor_a"], ["label_x"]))
    assert empty.count() == 0 and "rank_ic" in empty.columns


def test_start_after_a_probe_without_open_days(spark):
    """It goes on from the last success, not from the beginning of history."""
    calendar = spark.createDataFrame([("20230102", 1), ("20240110", 0)], "cal_date string, is_open int")
    assert trade_date_start(calendar, d("2024-01-31"), 5, d("1990-01-01")) == d("2024-01-31")
    assert trade_date_start(calendar, None, 5, d("1990-01-01")) == d("1990-01-01")
    assert trade_date_start(calendar, d("2023-01-05"), 5, d("1990-01-01")) == d("2023-01-02")


def exchanges(df):
    """Shuffles by hash or range in the plan, broadcasts aside."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_one_shuffle_for_all_sources_of_an_asof_join(spark):
    left = spark.range(20).selectExpr("cast(id % 3 as string) k", "date_add(date'2024-01-01', cast(id as int)) t")
    right = [left.selectExpr("k", f"t u{i}", f"1 tie{i}", f"2 v{i}") for i in range(3)]
    df = asof_join(left, [AsofSource(r, f"u{i}", [f"v{i}"], [f"tie{i}"]) for i, r in enumerate(right)], key="k", left_time="t")
    assert exchanges(df) == 1


def test_guards(spark, snapshot):
    """Two prices, two factors or two execution dates are errors; of two prices labels take the last."""
    daily = spark.createDataFrame([("A", "20240131", 1.0)] * 2, "ts_code string, trade_date string, open double").selectExpr("ts_code", "trade_date", *(f"open as {c}" for c in ("open", "high", "low", "close", "pre_close", "change", "pct_chg", "vol", "amount")))
    factor = daily.selectExpr("ts_code", "trade_date", "1.0 as adj_factor")
    with pytest.raises(ValueError, match="daily"):
        lake.adjusted_price_panel(daily, factor.limit(1))
    with pytest.raises(ValueError, match="adj_factor"):
        lake.adjusted_price_panel(daily.limit(1), factor)
    universe = snapshot.where("ts_code = 'A'")
    prices = universe.select("ts_code", F.col("trade_execution_date").alias("trade_date"), "adj_close")
    doubled = prices.withColumn("adj_close", F.lit(1.0)).unionByName(prices).coalesce(1)
    spec = LABELS.list(["fwd_ret_1m"])
    assert rows(label_panel(universe, doubled, spec), "rebalance_date") == rows(label_panel(universe, prices, spec), "rebalance_date")
    second = universe.withColumn("trade_execution_date", F.date_add("trade_execution_date", 1))
    with pytest.raises(ValueError, match="two execution dates"):
        label_panel(universe.unionByName(second), prices, spec)


def test_months_stored_with_other_columns_are_read_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = spark.createDataFrame([("A", d("2024-01-05"), 1)], "ts_code string, trade_date date, close int")
    two = spark.createDataFrame([("A", d("2024-02-05"), 2.5, "x")], "ts_code string, trade_date date, close double, more string")
    for df in (one, two):
        store.upsert_by_month(df, "t", date="trade_date", keys=["ts_code", "trade_date"])
    assert rows(store.read_mixed("t", ["ts_code", "close", "more"]), "close") == [("A", 1.0, None), ("A", 2.5, "x")]
    store.write_month(two, "t", 2024, 3)
    assert store.read_mixed("t").count() == 3 and store.partitions("t") == [(2024, 1), (2024, 2), (2024, 3)]
    store.replace_by_month(two, "t", date="trade_date", keys=["ts_code", "trade_date"])
    assert store.partitions("t") == [(2024, 2)]
    store.clear("t")
    assert not store.exists("t") and store.read_optional("t") is None


def test_a_source_is_asked_once(spark, tmp_path):
    asked = []

    class Source(FrameSource):
        def fetch(self, table, start=None, end=None):
            asked.append((table, start, end))
            return super().fetch(table, start, end)

    stocks = spark.createDataFrame([("A", "first"), ("A", "last"), ("B", "only")], "ts_code string, name string").coalesce(1)
    bars = spark.createDataFrame([("A", "20240105", 1.0), ("A", "20240105", 2.0)], "ts_code string, trade_date string, close double").coalesce(1)
    cal = spark.createDataFrame([("X", "20240105", 1)], "exchange string, cal_date string, is_open int")
    store = Store(spark, str(tmp_path / "raw"))
    ingestor = Ingestor(spark, Source({"stock_basic": stocks, "daily": bars, "trade_cal": cal}), store, IngestionState(tmp_path / "s.json"))
    assert [ingestor.run(t).rows for t in ("trade_cal", "stock_basic", "daily")] == [1, 2, 2]
    assert len(asked) == 3 and {r.name for r in store.read("stock_basic").collect()} == {"last", "only"}
    assert [r.close for r in store.read("daily").collect()] == [2.0]


def test_quality(spark, calendar):
    assert not quality.validate({"calendar_table": calendar}).failed
    broken = calendar.withColumn("month", F.lit("2024-01"))
    found = {i.check for i in quality.validate({"calendar_table": broken.unionByName(broken.limit(1))}).issues}
    assert {"month_label_consistency", "primary_key_unique"} <= found
    assert quality.validate({"calendar_table": calendar.drop("month")}).issues[0].check == "required_columns_present"
    assert "passed" in quality.report(quality.validate({"calendar_table": calendar}))


def test_store_and_ingestion(spark, tmp_path):
    store, state = Store(spark, str(tmp_path / "raw")), IngestionState(tmp_path / "state.json")
    cal = spark.createDataFrame([("X", f"202401{i:02d}", 1, None) for i in range(1, 31)], "exchange string, cal_date string, is_open int, pretrade_date string")
    one = spark.createDataFrame([("A", "20240105", 1.0), ("A", "20240205", 2.0)], "ts_code string, trade_date string, close double")
    Ingestor(spark, FrameSource({"trade_cal": cal}), store, state).run("trade_cal")
    assert Ingestor(spark, FrameSource({"daily": one}), store, state).run("daily").months == [(2024, 1), (2024, 2)]
    two = spark.createDataFrame([("A", "20240205", 3.0), ("B", "20240206", 4.0), ("B", None, 9.0)], "ts_code string, trade_date string, close double")
    assert Ingestor(spark, FrameSource({"daily": two}), store, state).run("daily").months == [(2024, 2)]
    assert rows(store.read("daily", ["ts_code", "trade_date", "close"]), "trade_date") == [("A", d("2024-01-05"), 1.0), ("A", d("2024-02-05"), 3.0), ("B", d("2024-02-06"), 4.0)]
    before = state.get("daily")["last_success_trade_date"]
    Ingestor(spark, FrameSource({"daily": two.limit(0)}), store, state).run("daily")
    assert state.get("daily")["last_success_trade_date"] == before == "2024-02-06"
    assert store.partition_columns("daily").keys() == {"2024-01", "2024-02"}
    assert announcement_start(d("2024-03-01"), 10, d("2015-01-01")) == d("2024-01-31")
    with pytest.raises(FileNotFoundError):
        store.read("none")
    with pytest.raises(KeyError):
        store.upsert_by_month(two, "daily", date="nothing", keys=["ts_code"])


def test_stream_merges_batches(spark, tmp_path):
    from pitloom.streaming.ingest import stream_into

    store = Store(spark, str(tmp_path / "t"))
    for k, v in enumerate((1.0, 2.0)):
        spark.createDataFrame([("A", d("2024-01-05"), v), (f"B{k}", d("2024-01-06"), v)], "ts_code string, trade_date date, close double").write.parquet(str(tmp_path / f"in/b{k}"))
    stream = spark.readStream.schema("ts_code string, trade_date date, close double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream_into(stream, store, "daily", date="trade_date", keys=["ts_code", "trade_date"], checkpoint=str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert store.read("daily").count() == 3


def test_settings_from_variables_and_a_file(tmp_path):
    (tmp_path / ".env").write_text("# local\nPIT_TOKEN='secret'\nPIT_DAILY_LOOKBACK=7\nPIT_ROOT=here\n")
    got = Config.from_env({"PIT_ROOT": "there"}, tmp_path / ".env")
    assert (got.token, got.daily_lookback, got.root, got.adjust_lookback) == ("secret", 7, "there", 60)
    assert Config.from_env({}, tmp_path / "none") == Config()


def test_small_things(spark, tmp_path):
    assert slugify(" A b!") == "a-b" and Experiment("A b", str(tmp_path), "2024-01-31").slug == "20240131__a-b"
    with pytest.raises(ValueError):
        Experiment("x", ".", "yesterday")
    got = spark.createDataFrame([("20240131",), ("2024-01-31",), ("bad",), (None,)], "x string").select(parsed_date(F.col("x")).alias("d")).collect()
    assert [r.d for r in got] == [d("2024-01-31")] * 2 + [None] * 2
    assert "<svg" in bar_chart("t", [("a", 1.0), ("b", -2.0)])
    waits, calls = [], []

    class Failing:
        def fetch(self, table, start=None, end=None):
            calls.append(table)
            raise OSError

    with pytest.raises(OSError):
        Retrying(Failing(), 3, 0.5, waits.append).fetch("daily")
    assert len(calls) == 3 and waits == [0.5, 1.0]


def test_research_from_raw_tables_to_the_report(spark, tmp_path, capsys, monkeypatch):
    """Every command on the smallest tables: ingest, build, validate, and the stages of an experiment."""
    from pitloom.research import cli
    from pitloom.sources.market import TABLES
    from pitloom.sources.proxy import RULES, Proxy

    raw = Proxy(spark, "/root/testdata/sf0.001")
    adjusted = raw.adj_factor().unionByName(raw.daily().where("trade_date like '199605%'").selectExpr("ts_code", "trade_date", "1.0 as adj_factor"))
    source = FrameSource({t: adjusted if t == "adj_factor" else raw.table(t) for t in TABLES})
    root = str(tmp_path)
    monkeypatch.setenv("PIT_HISTORY_START", "19900101")
    assert cli.main(["--root", root, "--log", f"{root}/run.log", "ingest", "all"], lambda: source) == 0
    assert "ingest table=all" in (tmp_path / "run.log").read_text()
    store = Store(spark, root)
    assert store.read("raw/daily").count() == raw.daily().count()
    for table in cli.LAKE:
        cli.build_table(store, table, Config(), replace(RULES, ipo_min_trade_days=5))
    cli.main(["--root", root, "validate"])
    assert "monthly_snapshot_base" in capsys.readouterr().out
    names = ["size", "roe", "leverage"]
    with pytest.raises(FileNotFoundError):
        cli.main(["--root", root, "research", "build-evaluation", "--name", "My run"])
    for stage, more in (("init", []), ("build-factors", ["--factors", *names]), ("build-labels", []), ("build-evaluation", ["--dry-run"]), ("build-evaluation", []), ("build-report", [])):
        assert cli.main(["--root", root, "research", stage, "--name", "My run", "--as-of", "2024-01-31", *more]) == 0
    e = Experiment("My run", root, "2024-01-31")
    made = e.manifest("evaluation")
    assert made["factors"] == [f"factor_{n}" for n in sorted(names, key=[s.name for s in FACTORS.list()].index)] and len(made["tables"]) == 18
    assert store.read(f"experiments/{e.slug}/evaluation/rank_ic_summary").count() == 9
    assert store.read(f"experiments/{e.slug}/evaluation/redundancy_summary").count() == 9
    report = (e.folder / "reports" / "report.md").read_text()
    for part in ("## Summary", "## Method", "## Charts", "### factor_size", "Rank IC is highest for"):
        assert part in report
    assert sorted(p.suffix for p in (e.folder / "reports").iterdir())[0] == ".md"
    assert any("heat" in p.stem or "corr" in p.stem for p in (e.folder / "reports").glob("*.svg"))


def test_vendor_endpoints_as_a_data_source(spark, tmp_path):
    """Requests by listing status, open day, security and calendar day; a request that fails is made again."""
    from pitloom.sources.vendor import ASKED_BY, VendorSource

    marks = str(tmp_path)

    def call(endpoint, **asked):
        import pathlib

        if endpoint == "trade_cal":
            return [{"exchange": "X", "cal_date": f"202401{k:02d}", "is_open": float(k != 6), "pretrade_date": None} for k in range(5, 9)]
        if endpoint == "stock_basic":
            known = {"L": [{"ts_code": "A.SH", "market": "M"}, {"ts_code": "C.XX", "market": "M"}], "D": [{"ts_code": "B.SZ", "market": "M", "delist_date": "20240105"}], "P": []}
            return known[asked["list_status"]]
        mark = pathlib.Path(marks) / f"{endpoint}-{'-'.join(asked.values())}"
        if not mark.exists():
            mark.write_text("")
            raise OSError("the first time fails")
        if "trade_date" in asked:
            return [{"ts_code": c, "trade_date": asked["trade_date"], "close": 1.0} for c in ("A.SH", "B.SZ")]
        if "ts_code" in asked:
            return [{"ts_code": asked["ts_code"], "ann_date": asked["end_date"], "end_date": "20231231", "revenue": 2.0}]
        return [{"ts_code": "A.SH", "ann_date": asked["ann_date"], "end_date": "20231231"}]

    store, state = Store(spark, str(tmp_path / "raw")), IngestionState(tmp_path / "state.json")
    config = Config(history_start="20240105")
    ingestor = Ingestor(spark, VendorSource(spark, call, store, config, markets=("M",), per_task=1, wait=0.0), store, state, config)
    got = {t: ingestor.run(t, end="20240108") for t in ("trade_cal", "stock_basic", "daily", "income", "forecast")}
    assert {t: r.rows for t, r in got.items()} == {"trade_cal": 4, "stock_basic": 3, "daily": 6, "income": 2, "forecast": 4}
    assert rows(store.read("income", ["ts_code", "ann_date"]), "ts_code") == [("A.SH", d("2024-01-08")), ("B.SZ", d("2024-01-08"))]
    assert [r.trade_date.day for r in store.read("daily").where("ts_code = 'A.SH'").orderBy("trade_date").collect()] == [5, 7, 8]
    assert len(ASKED_BY) == 11

    def never(endpoint, **asked):
        raise OSError("down")

    with pytest.raises(Exception, match="failed 2 times"):
        VendorSource(spark, never, store, config, attempts=2, wait=0.0).fetch("stock_basic").collect()
