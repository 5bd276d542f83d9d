"""One query for each operator, over raw market tables made from the star schema (sources/proxy.py).

Numbers are rounded to six digits (small ones to nine) and dates are dates, so that results can be compared across engines.
Evaluation and regressions run on all raw factors, whose values don't depend on the order of sums. In the tables made here some are sums of others: their residuals are zero. On the smallest tables
no month has as many rows as coefficients then; six and three factors have.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.ranks import quantile_bucket
from .operators import cross_section
from .functions.scalars import with_dates
from .operators.asof import AsofSource, asof_join, last_by_mark
from .operators.calendar_map import date_map
from .operators.order import bucket_of, exact_quantiles, ranked
from .plans import evaluation as ev
from .plans import lake, quality
from .plans.factors import FACTORS, factor_panel, market_returns, raw_factors, rolling_moments, stack
from .plans.labels import LABELS, label_panel
from .plans.rolling import rolling_amounts
from .research.report import BOARDS, leaderboard
from .sources.market import FrameSource
from .sources.proxy import LEAST, RULES, WINDOW, Proxy
from .sources.stages import fingerprint, shared_folder, staged
from .sources.state import IngestionState
from .sources.store import Store
from .streaming.ingest import Ingestor
from .streaming.late import append_available, closed_windows

#: All factors and labels.
STEP_FACTORS = EVALUATED = tuple(s.name for s in FACTORS.list())
FACTORS_OF_SIX = ("size", "book_to_market", "reversal_1m", "momentum_3_1", "roe", "leverage")
FACTORS_OF_MANY = ("beta", "gross_margin", "turnover")


def _settings(names) -> ev.EvaluationSettings:
    return ev.EvaluationSettings([f"factor_{n}" for n in names], [s.field for s in LABELS.list()])


_PRICES = ["ts_code", "trade_date", "close", "vol", "amount", "adj_factor"]
SETTINGS, SIX, MANY = map(_settings, (EVALUATED, FACTORS_OF_SIX, FACTORS_OF_MANY))
Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded (without a negative zero), counts as longs, days as dates."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "double":
            x = c * F.lit(1 + 1e-12)  # engines break exact ties differently
            c = F.when(F.abs(c) < 0.001, F.round(x, 9)).otherwise(F.round(x, 6)) + F.lit(0.0)
        elif kind in ("int", "smallint", "bigint"):
            c = c.cast("bigint")
        elif kind.startswith("timestamp"):
            c = c.cast("date")
        out.append(c.alias(f.name))
    return df.select(*out)


def significant(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Those columns with so many digits: coefficients on factors that nearly explain each other are large, and as sensitive to the last digit of their inputs."""

    def of(c):
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (digits - 1))
        return F.when(c == 0, c).otherwise(F.round(c / unit, 0) * unit)

    return df.withColumns({n: of(F.col(n)) for n in names})


class Tables:
    """The tables of one input folder: lazy, but for the stages that others build on, which are written once as Parquet
    (as the command line does between its stages) and shared by the queries of an application."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.raw, self.sf_dir = spark, Proxy(spark, sf_dir, keep=self._stage), sf_dir
        self._input = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("supplier", "nation", "region", "lineitem", "orders")])

    def _stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return staged(self.spark, (name, self._input), build)

    @cached_property
    def calendar(self) -> DataFrame:
        return self._stage("calendar", lambda: lake.calendar_table(self.raw.trade_cal()))

    @cached_property
    def panel(self) -> DataFrame:
        return lake.adjusted_price_panel(self.raw.daily(), self.raw.adj_factor())

    @cached_property
    def prices(self) -> DataFrame:
        """What others read of the price panel. The adjusted price is a product, made again by each reader instead of stored."""
        kept = self._stage("prices", lambda: self.panel.select(*_PRICES).repartition("ts_code").sortWithinPartitions("ts_code", "trade_date"))
        return lake.with_adjusted(kept, ["close"])

    @cached_property
    def market(self) -> DataFrame:
        return self._stage("market", lambda: market_returns(self.prices))

    @cached_property
    def universe(self) -> DataFrame:
        return self._stage("universe", lambda: lake.monthly_universe(self.calendar, self.raw.stock_basic(), self.prices, RULES, check=False))

    def statement(self, prefix: str) -> DataFrame:
        spec = lake.STATEMENTS[prefix]
        return lake.statement_pit_table(self.raw.table(spec.table), self.calendar, spec)

    @cached_property
    def snapshot(self) -> DataFrame:
        return self._stage("snapshot", self._snapshot)

    @cached_property
    def market_values(self) -> DataFrame:
        return self._stage("snapshot_market", self._market_values)

    def _market_values(self) -> DataFrame:
        value = AsofSource(with_dates(self.raw.daily_basic(), "trade_date"), "trade_date", ["trade_date", *lake.BASIC], ["total_mv"])
        marks = self.universe.select(F.col("rebalance_date").alias("mark")).distinct()
        return lake.snapshot_market(self.universe, self.prices, last_by_mark(value, marks, key="ts_code").table)

    def _snapshot(self) -> DataFrame:
        """Market data are written before statements are met, so that the shuffles of one are gone when those of the other are there."""
        industry = self.raw.stock_basic().select("ts_code", "industry")
        market = self.market_values
        return lake.with_statements(market, {p: self.statement(p) for p in lake.STATEMENTS}).join(industry, "ts_code", "left")

    def raws(self, names) -> DataFrame:
        """Factors of daily risk alone need no snapshot: the universe has its rows."""
        specs = FACTORS.list(names=names)
        risk = [s for s in specs if s.kind == "daily_risk"]
        base = self.universe if len(risk) == len(specs) else self.snapshot
        return raw_factors(base, self.prices, specs, window=WINDOW, least=LEAST, market=self.market if risk else None)

    @cached_property
    def labels(self) -> DataFrame:
        return self._stage("labels", lambda: label_panel(self.universe, self.prices))

    @cached_property
    def evaluated(self) -> DataFrame:
        chosen = [F.col(f"factor_{n}_raw").alias(f"factor_{n}") for n in EVALUATED]
        return self._stage("evaluated", lambda: self.raws(EVALUATED).select("rebalance_date", "ts_code", "is_eligible", *chosen))

    @cached_property
    def aligned(self) -> DataFrame:
        """Dealt by month and in order, so that the last digits of regressions on nearly collinear factors don't depend on how the tables before were cut."""
        rows = lambda: ev.aligned_panel(self.evaluated, self.labels, SETTINGS)
        return self._stage("aligned", lambda: rows().repartition("rebalance_date").sortWithinPartitions("rebalance_date", "ts_code"))

    @cached_property
    def ic(self) -> DataFrame:
        return self._stage("rank_ic", lambda: ev.rank_ic_timeseries(self.aligned, SETTINGS))

    @cached_property
    def returns(self) -> DataFrame:
        return self._stage("returns", lambda: ev.quantile_returns(self.aligned, SETTINGS))

    @cached_property
    def spreads(self) -> DataFrame:
        return ev.spread_timeseries(self.returns)

    @cached_property
    def monotonicity(self) -> DataFrame:
        return ev.monotonicity_summary(self.returns, ev.quantile_summary(self.returns))

    @cached_property
    def summary(self) -> DataFrame:
        return ev.evaluation_summary(ev.rank_ic_summary(self.ic), ev.spread_summary(self.spreads), self.monotonicity)

    @cached_property
    def correlation(self) -> DataFrame:
        return self._stage("correlations", lambda: ev.correlation_timeseries(self.evaluated, SETTINGS.factors))

    @cached_property
    def redundancy(self) -> DataFrame:
        return self._stage("redundancy", lambda: self.redundancy_of(SETTINGS))

    def redundancy_of(self, settings: ev.EvaluationSettings) -> DataFrame:
        return ev.redundancy(self.aligned, settings)

    @cached_property
    def periods(self) -> DataFrame:
        return ev.robustness_periods(self.aligned)

    @cached_property
    def subperiods(self) -> DataFrame:
        return ev.subperiod_summary(self.ic, self.spreads, self.periods)

    @cached_property
    def fama_macbeth(self) -> DataFrame:
        return self._stage("fama_macbeth", lambda: ev.fama_macbeth_timeseries(self.aligned, SETTINGS))

    @cached_property
    def long(self) -> DataFrame:
        """All raw factors, long, with exposures."""
        raw = self.raws(STEP_FACTORS)
        return stack(raw, [f"factor_{n}_raw" for n in STEP_FACTORS], ["rebalance_date", "ts_code", "is_eligible", "industry", "market", "total_mv"])


def _step(steps) -> Callable[[Tables], DataFrame]:
    def of(t: Tables) -> DataFrame:
        done = cross_section.preprocess(t.long, value="factor_value", group=["rebalance_date", "factor_name"], steps=steps)
        return done.select("rebalance_date", "ts_code", "factor_name", "factor_value")

    return of


def _dates(t: Tables) -> DataFrame:
    return date_map(t.calendar).select("day", "next_day", "on_or_after", "trade_idx")


def _asof(t: Tables) -> DataFrame:
    marks = t.universe.select("rebalance_date", "ts_code")
    bars = t.prices.select("ts_code", "trade_date", "close", "vol")
    return asof_join(marks, [AsofSource(bars, "trade_date", ["trade_date", "close", "vol"], ["close"])], key="ts_code", left_time="rebalance_date")


def _reasons(t: Tables) -> DataFrame:
    return t.universe.groupBy("exclude_reason", "is_eligible").agg(F.count(F.lit(1)).alias("n"))


def _factor(name: str) -> Callable[[Tables], DataFrame]:
    def of(t: Tables) -> DataFrame:
        return t.raws([name]).select("rebalance_date", "ts_code", F.col(f"factor_{name}_raw").alias("value"))

    return of


def _label(name: str) -> Callable[[Tables], DataFrame]:
    def of(t: Tables) -> DataFrame:
        return label_panel(t.universe, t.prices, LABELS.list([name])).select("rebalance_date", "ts_code", F.col(f"label_{name}").alias("value"))

    return of


def _panel(t: Tables, **options) -> DataFrame:
    fields = [c for n in STEP_FACTORS for c in (f"factor_{n}_raw", f"factor_{n}")]
    return factor_panel(t.snapshot, t.prices, FACTORS.list(names=STEP_FACTORS), window=WINDOW, least=LEAST, **options).select("rebalance_date", "ts_code", *fields)


def _buckets(t: Tables) -> DataFrame:
    rows = t.aligned.select("rebalance_date", "ts_code", "factor_size").where("factor_size is not null")
    return rows.withColumn("quantile", quantile_bucket(["rebalance_date"], F.col("factor_size"), "ts_code", 5)).select("rebalance_date", "ts_code", "quantile")


def _moments(t: Tables) -> DataFrame:
    return rolling_moments(t.prices, window=WINDOW, least=LEAST, market=t.market)


def _store(t: Tables) -> Store:
    """A store of its own in the shared folder."""
    return Store(t.spark, shared_folder(t.spark))


_BARS = ["ts_code", "trade_date", "close"]


def _upsert(t: Tables) -> DataFrame:
    """The years up to 1996 are stored; those from 1996 on come in, with all of 1996 again at twice the price."""
    store, bars = _store(t), t.prices.select(*_BARS)
    store.replace_by_month(bars.where("year(trade_date) <= 1996"), "bars", date="trade_date", keys=_BARS[:2])
    twice = F.when(F.year("trade_date") == 1996, F.col("close") * 2).otherwise(F.col("close"))
    store.upsert_by_month(bars.where("year(trade_date) >= 1996").withColumn("close", twice), "bars", date="trade_date", keys=_BARS[:2])
    return store.read("bars", _BARS)


def _replace(t: Tables) -> DataFrame:
    """All bars, twice each, over a table that held something else."""
    store, bars = _store(t), t.prices.select(*_BARS)
    for rows in (bars.withColumn("close", F.lit(0.0)).where("ts_code like '%.SH'"), bars.unionByName(bars)):
        store.replace_by_month(rows, "bars", date="trade_date", keys=_BARS[:2])
    return store.read("bars", [*_BARS, "year", "month"])


def _ingest(t: Tables) -> DataFrame:
    """A history up to the middle of 1998, then all since the watermark less its look-back, from a source that has doubled all volumes since: late changes inside the look-back are taken in, those
    before it aren't."""
    store, daily, days = _store(t), t.raw.daily(), t.raw.trade_cal()
    changed = daily.withColumn("vol", F.col("vol") * 2)
    with tempfile.TemporaryDirectory() as folder:  # the state is the driver's alone
        for table, rows, end in (("trade_cal", daily, None), ("daily", daily, "19980630"), ("daily", changed, None)):
            Ingestor(t.spark, FrameSource({"daily": rows, "trade_cal": days}), store, IngestionState(f"{folder}/state.json"), Config(history_start="19900101")).run(table, end=end)
    return store.read("daily", ["ts_code", "trade_date", "close", "vol", "amount"])


def _late_events(t: Tables) -> DataFrame:
    """Events by day and type from a stream that is stopped and started again for each ten days. One in 17 events comes two days late and one in 101 fifteen, the look-back is three days;
    one in 13 is delivered once more a day later."""
    at = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))  # whatever the session's time zone
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select("event_id", "ts", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), at.alias("at"))
    late = F.when(F.col("event_id") % 101 == 0, 15).when(F.col("event_id") % 17 == 0, 2).otherwise(0)
    again = F.when(F.col("event_id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    days = F.datediff("ts", F.lit("2024-01-01")) + late + F.col("again")
    arriving = events.withColumn("again", F.explode(again)).withColumn("batch", F.floor(days / 10)).drop("again")
    folder = shared_folder(t.spark)
    for batch in range(5):
        arriving.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        by_day = closed_windows(stream, time="at", id_col="event_id", delay="3 days", window="1 day", keys=["event_type"], aggregates=[F.count(F.lit(1)).alias("events"), F.sum("value").cast("double").alias("total")])
        append_available(by_day, f"{folder}/out", f"{folder}/checkpoint")
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window_start") / 86_400).cast("int"))
    return t.spark.read.parquet(f"{folder}/out").withColumn("window_start", day)


def _validate(table: str) -> Callable[[Tables], DataFrame]:
    def of(t: Tables) -> DataFrame:
        tables = {"calendar_table": lambda: quality.calendar_checks(t.calendar), "adjusted_price_panel": lambda: quality.price_checks(lake.year_month(t.panel, "trade_date")), "monthly_universe": lambda: quality.universe_checks(t.universe), "monthly_snapshot_base": lambda: quality.snapshot_checks(t.snapshot)}
        return tables[table]()

    return of


def _alignment(t: Tables) -> DataFrame:
    return quality.alignment_checks(t.snapshot, t.universe)


def _duplicates(t: Tables) -> DataFrame:
    return quality.duplicates(t.prices, ["trade_date"])


def _board(name: str) -> Callable[[Tables], DataFrame]:
    tables = {"rank_ic_summary": lambda t: ev.rank_ic_summary(t.ic), "top_bottom_spread_summary": lambda t: ev.spread_summary(t.spreads), "fama_macbeth_summary": lambda t: ev.fama_macbeth_summary(t.fama_macbeth), "factor_correlation_summary": lambda t: ev.correlation_summary(t.correlation), "redundancy_summary": lambda t: ev.redundancy_summary(t.redundancy, t.summary), "robustness_summary": lambda t: ev.robustness_summary(t.subperiods, t.summary), "subperiod_summary": lambda t: t.subperiods}

    def of(t: Tables) -> DataFrame:
        return leaderboard(tables[BOARDS[name][0]](t), name, 6 if name == "top_subperiods" else 5)

    return of


def _asof_buckets(t: Tables) -> DataFrame:
    marks = t.universe.select("rebalance_date", "ts_code")
    bars = t.prices.select("ts_code", "trade_date", "close", "vol")
    return asof_join(marks, [AsofSource(bars, "trade_date", ["trade_date", "close", "vol"], ["close"])], key="ts_code", left_time="rebalance_date", bucket="year")


def _price_ranks(t: Tables) -> DataFrame:
    """All bars as one group: rank and decile of the volume, which has many ties."""
    found = ranked(t.prices.select("ts_code", "trade_date", "vol"), [], "vol", ["ts_code", "trade_date"])
    return found.select("ts_code", "trade_date", "average_rank", bucket_of(F.col("row_number"), F.col("group_size"), 10).alias("decile"))


def _factor_quantiles(t: Tables) -> DataFrame:
    """Of each factor over all months."""
    long = stack(t.evaluated, SETTINGS.factors, ["rebalance_date", "ts_code"])
    return exact_quantiles(long, ["factor_name"], "factor_value", (0.01, 0.25, 0.5, 0.99))


def _winsorize_by_order(t: Tables) -> DataFrame:
    done = cross_section.winsorize_by_order(t.long, value="factor_value", group=["rebalance_date", "factor_name"], eligible="is_eligible", lower=0.01, upper=0.99)
    return done.select("rebalance_date", "ts_code", "factor_name", "factor_value")


def _rolling(t: Tables) -> DataFrame:
    """Sum and median of the amount over 20 bars of a security, in stretches of 100."""
    found = rolling_amounts(t.prices, size=100)
    return found.withColumn("cents", F.round(F.col("amount_sum") * 100).cast("long")).drop("amount_sum")


def _features(t: Tables) -> DataFrame:
    return lake.trading_features(t.prices, lake.month_ends(t.calendar, t.prices), RULES.liquidity_window)


_PLANS: dict[str, Callable[[Tables], DataFrame]] = {
    "calendar_table": lambda t: lake.calendar_table(t.raw.trade_cal()),
    "adjusted_price_panel": lambda t: lake.adjusted_price_panel(t.raw.daily(), t.raw.adj_factor()),
    "missing_factor_months": lambda t: lake.missing_factor_months(t.raw.daily(), t.raw.adj_factor()),
    "tradable_date_map": _dates,
    "asof_join": _asof,
    "asof_join_buckets": _asof_buckets,
    "price_ranks": _price_ranks,
    "factor_quantiles": _factor_quantiles,
    "rolling_amounts": _rolling,
    "month_ends": lambda t: lake.month_ends(t.calendar, t.prices),
    "universe_features": _features,
    "monthly_universe": lambda t: t.universe,
    "universe_reason_counts": _reasons,
    **{f"statement_pit_{p}": (lambda t, p=p: t.statement(p)) for p in lake.STATEMENTS},
    "snapshot_market": lambda t: t.market_values.select("rebalance_date", "ts_code", "price_trade_date", "close", "adj_close", "amount", "vol", "daily_basic_trade_date", *lake.BASIC),
    "snapshot_statements": lambda t: t.snapshot.select("rebalance_date", "ts_code", *sorted(c for c in t.snapshot.columns if c.split("_")[0] in lake.STATEMENTS)),
    "monthly_snapshot_base": lambda t: t.snapshot,
    "rolling_moments": _moments,
    **{f"factor_{s.name}_raw": _factor(s.name) for s in FACTORS.list()},
    "pre_winsorize": _step(["winsorize"]),
    "pre_winsorize_by_order": _winsorize_by_order,
    "pre_demean": _step(["industry_neutralize"]),
    "pre_size": _step(["size_neutralize"]),
    "pre_zscore": _step(["zscore"]),
    "pre_chain": _step(list(cross_section.STEPS)),
    "factor_panel": _panel,
    "factor_panel_plain": lambda t: _panel(t, neutralize_exposures=False),
    "label_panel": lambda t: t.labels,
    **{s.name: _label(s.name) for s in LABELS.list()},
    "evaluation_input": lambda t: t.aligned,
    "rank_ic_timeseries": lambda t: t.ic,
    "rank_ic_summary": lambda t: ev.rank_ic_summary(t.ic),
    "quantile_buckets": _buckets,
    "quantile_returns": lambda t: t.returns,
    "quantile_summary": lambda t: ev.quantile_summary(t.returns),
    "spread_timeseries": lambda t: t.spreads,
    "spread_summary": lambda t: ev.spread_summary(t.spreads),
    "monotonicity_summary": lambda t: t.monotonicity,
    "evaluation_summary": lambda t: t.summary,
    "factor_corr_timeseries": lambda t: t.correlation,
    "factor_corr_summary": lambda t: ev.correlation_summary(t.correlation),
    "factor_corr_matrix": lambda t: ev.correlation_matrix(ev.correlation_summary(t.correlation), SETTINGS.factors),
    "redundancy_timeseries": lambda t: t.redundancy,
    "redundancy_summary": lambda t: ev.redundancy_summary(t.redundancy, t.summary),
    "redundancy_six": lambda t: t.redundancy_of(SIX),
    "redundancy_many": lambda t: t.redundancy_of(MANY),
    "robustness_periods": lambda t: ev.period_bounds(t.periods),
    "subperiod_summary": lambda t: t.subperiods,
    "robustness_summary": lambda t: ev.robustness_summary(t.subperiods, t.summary),
    "fama_macbeth_timeseries": lambda t: significant(t.fama_macbeth, "coefficient"),
    "fama_macbeth_summary": lambda t: significant(ev.fama_macbeth_summary(t.fama_macbeth), "mean_coefficient", "coefficient_std"),
    "fama_macbeth_six": lambda t: ev.fama_macbeth_timeseries(t.aligned, SIX),
    "fama_macbeth_many": lambda t: ev.fama_macbeth_timeseries(t.aligned, MANY),
    **{f"validate_{k}": _validate(v) for k, v in (("calendar", "calendar_table"), ("prices", "adjusted_price_panel"), ("universe", "monthly_universe"), ("snapshot", "monthly_snapshot_base"))},
    "validate_alignment": _alignment,
    "validate_duplicates": _duplicates,
    "upsert_by_month": _upsert,
    "replace_by_month": _replace,
    "incremental_ingest": _ingest,
    "late_events": _late_events,
    **{f"leaderboard_{b}": _board(b) for b in BOARDS},
}


def _query(plan: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: tidy(plan(Tables(spark, sf_dir)))


QUERIES: dict[str, Query] = {name: _query(plan) for name, plan in _PLANS.items()}
