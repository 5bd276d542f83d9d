"""The four standard tables: trading calendar, adjusted prices, monthly universe, monthly as-of snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import number, with_dates
from ..operators.asof import AsofSource, asof_join
from ..operators.calendar_map import map_dates
from ..operators.unique import assert_unique

PRICES = ("open", "high", "low", "close")
PRICE_PANEL = ("ts_code", "trade_date", *PRICES, "pre_close", "change", "pct_chg", "vol", "amount", "adj_factor", *(f"adj_{p}" for p in PRICES))
BASIC = ("total_mv", "circ_mv", "pb", "pe_ttm", "ps_ttm", "dv_ttm", "turnover_rate", "turnover_rate_f", "volume_ratio")
UNIVERSE = ("rebalance_date", "trade_execution_date", "ts_code", "exchange", "market", "list_date", "delist_date", "days_since_list", "valid_trade_days_20d", "median_amount_20d", "has_price_coverage", "is_st_flag", "is_suspended_flag", "is_eligible", "exclude_reason")


def year_month(df: DataFrame, date: str) -> DataFrame:
    return df.withColumns({"year": F.year(date).cast("int"), "month": F.month(date).cast("int")})


# -- calendar ---------------------------------------------------------------------------------------------------------


def calendar_table(raw: DataFrame) -> DataFrame:
    """trade_date, prev_trade_date, next_trade_date, is_month_end, month, from open days.

    The previous day is the vendor's if it gives one, else the one before. The last day counts as a month end. The
    calendar is small, so that one task can order it.
    """
    open_days = with_dates(raw, "cal_date", "pretrade_date").where((number(F.col("is_open")) == 1) & F.col("cal_date").isNotNull())
    vendor = F.max("pretrade_date") if "pretrade_date" in raw.columns else F.max(F.lit(None).cast("date"))
    days = open_days.groupBy(F.col("cal_date").alias("trade_date")).agg(vendor.alias("vendor"))
    by_day = Window.orderBy("trade_date")
    previous = F.col("vendor") if "pretrade_date" in raw.columns else F.lag("trade_date").over(by_day)
    after = F.lead("trade_date").over(by_day)
    month = F.date_format("trade_date", "yyyy-MM")
    return days.select("trade_date", previous.alias("prev_trade_date"), after.alias("next_trade_date"), F.coalesce(month != F.date_format(after, "yyyy-MM"), F.lit(True)).alias("is_month_end"), month.alias("month"))


# -- prices -----------------------------------------------------------------------------------------------------------


def adjusted_price_panel(daily: DataFrame, factors: DataFrame, *, check: bool = True) -> DataFrame:
    """Prices times the adjustment factor of the same day; without a factor the adjusted ones are NULL. ValueError if a security
    and day has two prices or two factors (check: an action)."""
    keys = ["ts_code", "trade_date"]
    prices = with_dates(daily, "trade_date")
    factor = with_dates(factors, "trade_date").select(*keys, number(F.col("adj_factor")).alias("adj_factor"))
    if check:
        for table, name in ((prices, "daily"), (factor, "adj_factor")):
            assert_unique(table, keys, name)
    joined = prices.join(factor, keys, "left")
    plain = [number(F.col(c)).alias(c) for c in (*PRICES, "pre_close", "change", "pct_chg", "vol", "amount")]
    return with_adjusted(joined.select(*keys, *plain, "adj_factor"), PRICES)


def with_adjusted(panel: DataFrame, prices: Sequence[str]) -> DataFrame:
    """The panel with those of its prices times its adjustment factor."""
    return panel.select("*", *((F.col(p) * F.col("adj_factor")).alias(f"adj_{p}") for p in prices))


def missing_factor_months(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """Months (year, month) with daily prices but no adjustment factors at all."""
    months = [year_month(with_dates(t, "trade_date"), "trade_date").select("year", "month").distinct() for t in (daily, factors)]
    return months[0].join(months[1], ["year", "month"], "left_anti")


# -- universe ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class UniverseRules:
    ipo_min_trade_days: int = 120
    liquidity_window: int = 20
    min_valid_trade_days: int = 15
    min_median_amount: float = 20000.0
    markets: Sequence[str] = ("主板", "创业板", "科创板")
    suffixes: Sequence[str] = (".SH", ".SZ")


def month_ends(calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """rebalance_date, trade_execution_date, rebalance_idx of month ends within the dates that prices cover."""
    numbered = calendar.withColumn("rebalance_idx", (F.row_number().over(Window.orderBy("trade_date")) - 1).cast("long"))
    covered = prices.agg(F.min("trade_date").alias("low"), F.max("trade_date").alias("high"))
    inside = numbered.where("is_month_end").crossJoin(F.broadcast(covered)).where("trade_date between low and high")
    return inside.select(F.col("trade_date").alias("rebalance_date"), F.col("next_trade_date").alias("trade_execution_date"), "rebalance_idx")


def trading_features(prices: DataFrame, dates: DataFrame, window: int = 20) -> DataFrame:
    """Over the last `window` rows of each security up to and with a bar on the date: days with amount and adjusted price,
    median amount of days that have one, and whether the day itself has an adjustment factor."""
    recent = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(-(window - 1), 0)
    valid = (F.col("amount").isNotNull() & F.col("adj_close").isNotNull()).cast("long")
    rows = prices.select("ts_code", "trade_date", F.sum(valid).over(recent).alias("valid_trade_days_20d"), F.array_sort(F.collect_list("amount").over(recent)).alias("amounts"), F.col("adj_factor").isNotNull().alias("has_adj_factor"))
    n = F.size("amounts")
    low, high = F.try_element_at("amounts", F.floor((n + 1) / 2).cast("int")), F.try_element_at("amounts", (F.floor(n / 2) + 1).cast("int"))
    wanted = rows.join(F.broadcast(dates.select(F.col("rebalance_date").alias("trade_date"))), "trade_date", "left_semi")
    return wanted.select(F.col("trade_date").alias("rebalance_date"), "ts_code", "valid_trade_days_20d", F.when(n > 0, (low + high) / 2).alias("median_amount_20d"), (F.col("valid_trade_days_20d") > 0).alias("has_price_coverage"), "has_adj_factor")


def check_depth(dates: DataFrame, rules: UniverseRules) -> None:
    """ValueError if the calendar is too short before the first rebalance to judge seasoning. An action."""
    first = dates.agg(F.min("rebalance_idx").alias("first")).first().first
    if first is not None and first + 1 < rules.ipo_min_trade_days:
        raise ValueError(f"the calendar has {first + 1} trade days up to the first rebalance; {rules.ipo_min_trade_days} are needed")


def monthly_universe(calendar: DataFrame, securities: DataFrame, prices: DataFrame, rules: UniverseRules = UniverseRules(), *, check: bool = True) -> DataFrame:
    """Every security at every month end, with what excludes it."""
    dates = month_ends(calendar, prices)
    if check:
        check_depth(dates, rules)
    stocks = with_dates(securities, "list_date", "delist_date").select("ts_code", "exchange", "market", "list_date", "delist_date")
    stocks = map_dates(stocks, calendar, "list_date", effective_list="on_or_after", list_idx="trade_idx")
    grid = stocks.crossJoin(F.broadcast(dates))
    grid = grid.join(trading_features(prices, dates, rules.liquidity_window), ["rebalance_date", "ts_code"], "left")
    no = F.lit(False)
    common = F.coalesce(F.array_contains(F.array(*map(F.lit, rules.suffixes)), F.regexp_extract("ts_code", r"(\.[^.]*)$", 1)) & F.col("market").isin(*rules.markets), no)
    listed = F.coalesce(F.col("effective_list") <= F.col("rebalance_date"), no)
    days = F.when(listed, F.col("rebalance_idx") - F.col("list_idx") + 1)
    valid, median = F.coalesce("valid_trade_days_20d", F.lit(0).cast("long")), F.coalesce("median_amount_20d", F.lit(0.0))
    covered, adjusted = F.coalesce("has_price_coverage", no), F.coalesce("has_adj_factor", no)
    trades_until = F.col("delist_date").isNull() | F.coalesce(F.col("trade_execution_date") <= F.col("delist_date"), no)
    traded = common & listed
    reasons = [
        ("NOT_COMMON_A", ~common),
        ("NOT_LISTED_YET", ~listed),
        ("DELISTED", ~trades_until),
        ("IPO_LT_120D", F.coalesce(listed & (days < rules.ipo_min_trade_days), no)),
        ("NO_PRICE_HISTORY", traded & ~covered),
        ("MISSING_ADJ_FACTOR", traded & covered & ~adjusted),
        ("LOW_LIQUIDITY_20D", traded & covered & adjusted & ((valid < rules.min_valid_trade_days) | (median < rules.min_median_amount))),
    ]
    reason = F.concat_ws("|", *(F.when(c, F.lit(name)) for name, c in reasons))
    unknown = F.lit(None).cast("boolean")
    out = grid.select("rebalance_date", "trade_execution_date", "ts_code", "exchange", "market", "list_date", "delist_date", days.alias("days_since_list"), valid.alias("valid_trade_days_20d"), "median_amount_20d", covered.alias("has_price_coverage"), unknown.alias("is_st_flag"), unknown.alias("is_suspended_flag"), (reason == "").alias("is_eligible"), reason.alias("exclude_reason"))
    return year_month(out, "rebalance_date")


# -- statements -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class StatementSpec:
    """A family of statements: where its day of publication stands, and which dates it keeps."""

    prefix: str
    table: str
    published: Sequence[str]
    keeps: Sequence[str] = ()


STATEMENTS = {
    s.prefix: s
    for s in (
        StatementSpec("fi", "fina_indicator", ("ann_date",)),
        StatementSpec("inc", "income", ("f_ann_date", "ann_date"), ("f_ann_date",)),
        StatementSpec("bs", "balancesheet", ("f_ann_date", "ann_date"), ("f_ann_date",)),
        StatementSpec("cf", "cashflow", ("f_ann_date", "ann_date"), ("f_ann_date",)),
        StatementSpec("fc", "forecast", ("ann_date",), ("first_ann_date",)),
        StatementSpec("ex", "express", ("ann_date",)),
    )
}
_NOT_METRICS = ("ts_code", "ann_date", "f_ann_date", "first_ann_date", "end_date", "update_flag", "year", "month")


def statement_pit_table(raw: DataFrame, calendar: DataFrame, spec: StatementSpec) -> DataFrame:
    """ts_code, then prefixed report_period, ann_date, [f_ann_date | first_ann_date], availability_date, tradable_date, update_flag (if any) and metrics.

    A statement can be traded on from the first trade date after it was published. Rows without a
    security, announcement or period are left out.
    """
    p = spec.prefix
    for k in spec.keeps:
        raw = raw if k in raw.columns else raw.withColumn(k, F.lit(None).cast("string"))
    rows = with_dates(raw, "ann_date", "f_ann_date", "first_ann_date", "end_date").dropna(subset=["ts_code", "ann_date", "end_date"])
    rows = rows.withColumn("availability_date", F.coalesce(*(F.col(c) for c in spec.published if c in rows.columns)))
    rows = map_dates(rows, calendar, "availability_date", tradable_date="next_day")
    metrics = [c for c in raw.columns if c not in _NOT_METRICS]
    flag = ["update_flag"] if "update_flag" in raw.columns else []
    named = [F.col("end_date").alias(f"{p}_report_period"), *(F.col(c).alias(f"{p}_{c}") for c in ("ann_date", *spec.keeps, "availability_date", "tradable_date", *flag)), *(F.col(c).alias(f"{p}_{c}") for c in metrics)]
    return rows.select("ts_code", *named)


def statement_source(table: DataFrame, prefix: str) -> AsofSource:
    ties = [f"{prefix}_{c}" for c in ("report_period", "ann_date", "f_ann_date", "update_flag") if f"{prefix}_{c}" in table.columns]
    return AsofSource(table, f"{prefix}_tradable_date", [c for c in table.columns if c != "ts_code" and c != f"{prefix}_update_flag"], ties)


def snapshot_market(universe: DataFrame, prices: DataFrame, basic: DataFrame) -> DataFrame:
    """The universe with the last bar and the last valuation at or before the rebalance date."""
    bars = prices.select("ts_code", F.col("trade_date").alias("price_trade_date"), "close", "adj_close", "amount", "vol")
    value = with_dates(basic, "trade_date").select("ts_code", F.col("trade_date").alias("daily_basic_trade_date"), *(number(F.col(c)).alias(c) for c in BASIC))
    sources = [AsofSource(bars, "price_trade_date", bars.columns[1:], ("adj_close", "close")), AsofSource(value, "daily_basic_trade_date", value.columns[1:], ("total_mv",))]
    return asof_join(universe, sources, key="ts_code", left_time="rebalance_date")


def monthly_snapshot_base(universe: DataFrame, prices: DataFrame, basic: DataFrame, statements: Mapping[str, DataFrame]) -> DataFrame:
    """The universe with market data as of the rebalance date and statements as of the execution date.

    statements: tables of statement_pit_table() by prefix; absent families are left out. All families share one shuffle.
    """
    return with_statements(snapshot_market(universe, prices, basic), statements)


def with_statements(base: DataFrame, statements: Mapping[str, DataFrame]) -> DataFrame:
    """snapshot_market's table with statements as of the execution date."""
    sources = [statement_source(t, p) for p, t in statements.items()]
    out = asof_join(base, sources, key="ts_code", left_time="trade_execution_date") if sources else base
    first = ["rebalance_date", "trade_execution_date", "ts_code", "exchange", "market", "is_eligible", "exclude_reason", "list_date", "delist_date", "days_since_list", "valid_trade_days_20d", "median_amount_20d", "has_price_coverage", "is_st_flag", "is_suspended_flag", "price_trade_date", "daily_basic_trade_date", "close", "adj_close", *BASIC, "amount", "vol"]
    more = sorted(c for s in sources for c in s.values)
    rest = [c for c in out.columns if c not in first and c not in more and c not in ("year", "month")]
    return out.select(*first, *rest, *more, "year", "month")


def schedule(universe: DataFrame) -> DataFrame:
    """Distinct rebalance dates with their execution dates; require one execution date each (see check_schedule)."""
    return universe.select("rebalance_date", "trade_execution_date").distinct()


def check_schedule(dates: DataFrame) -> None:
    """An action."""
    twice = dates.groupBy("rebalance_date").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].rebalance_date} has two execution dates")
