"""Ranks, quantiles, windows and as-of joins that don't need a group in one task."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitloom.functions.ranks import quantile_bucket
from pitloom.operators.asof import AsofSource, asof_join
from pitloom.operators.order import bucket_of, exact_quantiles, in_stretches, numbered, ranked
from pitloom.plans.rolling import rolling_amounts


@pytest.fixture
def uncoalesced(spark):
    """Few rows would go to one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"day": ["a"] * 900 + ["b"] * 90 + [None] * 10, "x": rng.integers(0, 300, 1000) / 4.0, "code": [f"s{k:04d}" for k in rng.permutation(1000)]})
    f.loc[::50, "x"] = None
    return f


def of(spark, f, schema):
    return spark.createDataFrame(f.astype(object).where(f.notna(), None), schema)


def test_ranks_equal_average_ranks(spark, frame, uncoalesced):
    df = of(spark, frame, "day string, x double, code string").repartition(5)
    got = {r.code: r for r in ranked(df, ["day"], "x", ["code"]).collect()}
    there = frame[frame["x"].notna()]
    want = there.groupby("day", dropna=False)["x"].rank(method="average")
    assert len(got) == len(there) and all(got[c].average_rank == r for c, r in zip(there["code"], want, strict=True))
    by_window = {r.code: r.q for r in df.where("x is not null").withColumn("q", quantile_bucket(["day"], F.col("x"), "code", 5)).collect()}
    assert {r.code: r.q for r in ranked(df, ["day"], "x", ["code"]).withColumn("q", bucket_of(F.col("row_number"), F.col("group_size"), 5)).collect()} == by_window


def test_one_group_fills_all_tasks(spark, uncoalesced):
    """A date with nearly all rows, two thirds of which have one value."""
    df = spark.range(40_000).selectExpr("if(id < 39000, 'hot', 'other') as day", "if(id % 3 = 0, cast(id % 1000 as double), 5.0) as x", "id as code")
    found = ranked(df, ["day"], "x", ["code"]).persist()
    sizes = [r["count"] for r in numbered(df, ["day"], ["x", "code"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 20_000
    assert found.groupBy("day").agg(F.max("row_number"), F.count_distinct("row_number"), F.max("group_size")).orderBy("day").collect() == [("hot", 39000, 39000, 39000), ("other", 1000, 1000, 1000)]
    pdf = found.where("day = 'hot'").select("x", "average_rank").toPandas()
    assert (pdf["x"].rank() == pdf["average_rank"]).all()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(day" not in plan


def test_quantiles_equal_percentile(spark, frame, uncoalesced):
    df = of(spark, frame, "day string, x double, code string").repartition(3).unionByName(spark.createDataFrame([("c", float("nan"), "n"), ("d", 3.0, "o")], "day string, x double, code string"))
    probabilities = (0.0, 0.01, 0.3, 0.5, 0.99, 1.0)
    got = {r.day: tuple(r)[1:] for r in exact_quantiles(df, ["day"], "x", probabilities).collect()}
    assert set(got) == {"a", "b", None, "d"} and got["d"] == (3.0,) * 6
    for day in ("a", "b", None):
        mine = frame[[x == day if day else x is None for x in frame["day"].astype(object).where(frame["day"].notna(), None)]]["x"].dropna()
        assert got[day] == pytest.approx(np.quantile(mine, probabilities))
    assert exact_quantiles(df.where("false"), ["day"], "x", (0.5,)).count() == 0


@pytest.mark.parametrize(("size", "halo"), [(7, 6), (10, 3), (1000, 4), (1, 0)])
def test_stretches_have_what_a_window_sees(spark, frame, size, halo):
    df = of(spark, frame, "day string, x double, code string").repartition(3)
    rows = in_stretches(df, ["day"], ["code"], halo=halo, size=size).toPandas()
    assert (rows.groupby(["day", "stretch"], dropna=False).size() <= max(size, halo + 1) + halo).all()
    assert rows["own"].sum() == len(frame)
    for (_, _), part in rows.groupby(["day", "stretch"], dropna=False):
        own, before = part[part["own"]], part[~part["own"]]
        first = own["row_number"].min()
        assert sorted(before["row_number"]) == list(range(max(1, first - halo), first))


def test_rolling_sums_and_medians_equal_pandas(spark):
    rng = np.random.default_rng(3)
    f = pd.DataFrame({"ts_code": ["s1"] * 200 + ["s2"] * 5, "trade_date": [dt.date(2020, 1, 1) + dt.timedelta(days=int(k)) for k in [*range(200), *range(5)]], "amount": rng.normal(size=205)})
    f.loc[40:66, "amount"] = None
    got = {(r.ts_code, r.trade_date): r for r in rolling_amounts(of(spark, f, "ts_code string, trade_date date, amount double").repartition(3), size=30).collect()}
    assert len(got) == 205
    for code, g in f.groupby("ts_code"):
        windows = g["amount"].rolling(20, min_periods=1)
        for day, total, middle, n in zip(g["trade_date"], windows.sum(), windows.median(), windows.count(), strict=True):
            r = got[code, day]
            assert r.valid_rows == n
            assert (r.amount_sum, r.amount_median) == ((None, None) if n == 0 else (pytest.approx(total), pytest.approx(middle)))


def test_asof_by_buckets_equals_asof(spark):
    """Several sources with ties, missing ties and times, empty buckets, keys without rows."""
    rng = random.Random(4)
    day = lambda: None if rng.random() < 0.05 else dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(900))
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = spark.createDataFrame([(key(), day(), k) for k in range(300)], "k string, t date, n int")
    one = spark.createDataFrame([(key(), day(), rng.choice([None, 1.0, 2.0]), k) for k in range(120)], "k string, u date, tie double, v int")
    two = spark.createDataFrame([(key(), day(), rng.choice(["x", "y", None])) for _ in range(25)], "k string, w date, z string")
    sources = [AsofSource(one, "u", ["u", "tie", "v"], ["tie", "v"]), AsofSource(two, "w", ["w", "z"], ["z"])]
    want = sorted(map(str, asof_join(left, sources, key="k", left_time="t").collect()))
    for bucket in ("month", "year"):
        joined = asof_join(left, sources, key="k", left_time="t", bucket=bucket)
        assert sorted(map(str, joined.collect())) == want
        assert "windowspecdefinition(__key" in joined._jdf.queryExecution().optimizedPlan().toString()
    hot = spark.range(30_000).selectExpr("'h' as k", "date_add(date'2000-01-01', cast(id % 7000 as int)) as t", "id as n")
    found = asof_join(hot, [AsofSource(hot.select("k", F.col("t").alias("u"), F.col("n").alias("m")), "u", ["m"], ["m"])], key="k", left_time="t", bucket="month")
    assert found.where("m is null").count() == 0 and found.groupBy(F.spark_partition_id()).count().count() > 1
