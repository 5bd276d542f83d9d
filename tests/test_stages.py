"""What queries leave on disk while they run."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitloom.operators.asof import AsofSource, asof_join, last_by_mark
from pitloom.queries import QUERIES, Tables
from pitloom.sources import stages

SF = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    """Stage tables of this test alone."""
    monkeypatch.setattr(stages, "_WRITTEN", found := {})
    return lambda: {key[1] for key in found}


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for k in range(blocks.size()) if (name := blocks.apply(k).name()).startswith("shuffle")}


def test_a_stage_table_leaves_no_shuffle_files(spark, written):
    before = shuffle_files(spark)
    df = stages.staged(spark, ("sums",), lambda: spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").sum("id"))
    assert df.count() == 7 and written() == {"sums"}
    spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().write.format("noop").mode("overwrite").save()
    left = shuffle_files(spark) - before
    assert left  # what isn't a stage keeps them until the driver collects its garbage
    stages.forget(spark, "sums")
    stages.staged(spark, ("sums",), lambda: spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").sum("id"))
    assert not shuffle_files(spark) - before - left
    assert spark.conf.get(stages._CLEANUP) == "false"


@pytest.mark.parametrize("name", ["beta", "idiosyncratic_volatility"])
def test_factors_of_daily_risk_need_no_snapshot(spark, written, name):
    """Nor are bars shuffled twice for the market, and prices that are products aren't stored."""
    df = QUERIES[f"factor_{name}_raw"](spark, SF)
    assert df.where("value is not null").count() > 0
    assert written() == {"calendar", "prices", "universe", "market"}
    path, schema = next(v for k, v in stages._WRITTEN.items() if k[1] == "prices")
    assert not [c for c in schema.names if c.startswith("adj_") and c != "adj_factor"]


def test_market_data_and_quarters_are_written_before_statements_are_met(spark, written):
    """So that their shuffles are gone by then; the market data alone need no quarters."""
    assert QUERIES["snapshot_market"](spark, SF).count() > 0
    assert written() == {"calendar", "prices", "universe", "snapshot_market"}
    assert QUERIES["monthly_snapshot_base"](spark, SF).count() > 0
    assert written() == {"calendar", "prices", "universe", "snapshot_market", "quarters", "snapshot"}


def test_an_asof_join_needs_only_the_last_row_before_each_mark(spark):
    rng = np.random.default_rng(11)
    day = dt.date(2024, 1, 1)
    rows = [(None if i % 41 == 0 else f"k{rng.integers(5)}", None if i % 37 == 0 else day + dt.timedelta(int(rng.integers(0, 130))), None if i % 6 == 0 else int(rng.integers(3)), i) for i in range(600)]
    right = spark.createDataFrame(rows, "k string, u date, tie int, v int").selectExpr("*", "v as same")
    marks = [day + dt.timedelta(x) for x in (10, 40, 41, 100)]
    left = spark.createDataFrame([(f"k{i}", m) for i in range(6) for m in marks], "k string, t date")
    source = AsofSource(right, "u", ["u", "tie", "v"], ["tie", "same"])
    thin = last_by_mark(source, spark.createDataFrame([(m,) for m in marks], "mark date"), key="k")
    assert thin.table.count() <= 5 * 4
    want, got = (sorted(map(str, asof_join(left, [x], key="k", left_time="t").collect())) for x in (source, thin))
    assert got == want and sum("None" not in r for r in got) > 10
    dealt = AsofSource(right.repartition(3, "k"), "u", ["u", "v"], ["v"])
    plan = last_by_mark(dealt, spark.createDataFrame([(m,) for m in marks], "mark date"), key="k").table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1  # the repartition itself


def test_rows_of_regressions_come_month_by_month_in_order(spark, written):
    """However the tables before were cut: the last digits of coefficients on nearly collinear factors depend on the order of rows."""
    found = Tables(spark, SF).aligned.select("rebalance_date", "ts_code", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    files = {}
    for r in found:
        files.setdefault(r.rebalance_date, []).append((r.file, r.ts_code))
    assert len(files) > 20 and all(len({f for f, _ in x}) == 1 and x == sorted(x) for x in files.values())
