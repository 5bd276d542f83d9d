"""The factor catalogue and the factor panel."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import at_least, number, optional, require_columns, safe_divide, safe_inverse, safe_log
from ..operators.cross_section import DEFAULT_STEPS, preprocess
from .catalogue import Catalogue, require_name

FAMILIES = ("size_value", "momentum", "risk_liquidity", "profitability", "investment_leverage")
KINDS = ("snapshot", "lagged", "daily_risk")


@dataclass(frozen=True)
class FactorSpec:
    """A factor that owns its expression. snapshot: over a row of the snapshot; lagged: with lag(column, k) over a
    security's monthly rows; daily_risk: over the rolling moments of daily returns."""

    name: str
    family: str
    kind: str
    inputs: Sequence[str]
    expression: Callable[..., Column]
    description: str
    steps: Sequence[str] = DEFAULT_STEPS

    def __post_init__(self) -> None:
        require_name(self)
        if self.family not in FAMILIES:
            raise ValueError(f"no family {self.family!r}")
        if self.kind not in KINDS:
            raise ValueError(f"no kind {self.kind!r}")
        if not self.inputs:
            raise ValueError(f"{self.name} has no inputs")

    @property
    def field(self) -> str:
        return f"factor_{self.name}"


class FactorRegistry(Catalogue[FactorSpec]):
    """By family, then name."""

    kind = "factor"

    def __init__(self, specs: Iterable[FactorSpec] = ()) -> None:
        super().__init__(specs, order=lambda s: (FAMILIES.index(s.family), s.name))

    def list(self, *, family: str | None = None, names: Sequence[str] | None = None) -> list[FactorSpec]:
        return [s for s in super().list(names) if family in (None, s.family)]

    def families(self) -> list[str]:
        return self.groups("family")


def _col(name: str) -> Column:
    return number(F.col(name))


def _snapshot(name: str, family: str, inputs: Sequence[str], of: Callable[..., Column], text: str) -> FactorSpec:
    return FactorSpec(name, family, "snapshot", inputs, lambda: of(*map(_col, inputs)), text)


def _change(name: str, family: str, column: str, of: Callable[[Callable[[int], Column]], Column], text: str) -> FactorSpec:
    return FactorSpec(name, family, "lagged", (column,), of, text)


def _growth(now: Column, then: Column) -> Column:
    return safe_divide(now, then) - 1


def _risk(name: str, needs: Sequence[str], of: Callable[[], Column], text: str) -> FactorSpec:
    return FactorSpec(name, "risk_liquidity", "daily_risk", needs, of, text)


SIZE, MOMENTUM, RISK, PROFIT, INVEST = FAMILIES
FACTORS = FactorRegistry(
    [
        _snapshot("size", SIZE, ["total_mv"], safe_log, "ln(total_mv)"),
        _snapshot("book_to_market", SIZE, ["pb"], safe_inverse, "1 / pb"),
        _snapshot("earnings_to_price", SIZE, ["pe_ttm"], safe_inverse, "1 / pe_ttm"),
        _snapshot("sales_to_price", SIZE, ["ps_ttm"], safe_inverse, "1 / ps_ttm"),
        _snapshot("cashflow_to_price", SIZE, ["cf_n_cashflow_act", "total_mv"], safe_divide, "operating cash flow / total_mv"),
        _change("momentum_12_1", MOMENTUM, "adj_close", lambda lag: _growth(lag(1), lag(12)), "return from 12 months to 1 month ago"),
        _change("momentum_6_1", MOMENTUM, "adj_close", lambda lag: _growth(lag(1), lag(6)), "return from 6 months to 1 month ago"),
        _change("momentum_3_1", MOMENTUM, "adj_close", lambda lag: _growth(lag(1), lag(3)), "return from 3 months to 1 month ago"),
        _change("reversal_1m", MOMENTUM, "adj_close", lambda lag: -_growth(lag(0), lag(1)), "minus last month's return"),
        _risk("beta", ["adj_close"], lambda: F.when(F.col("var_m") > 0, F.try_divide(F.col("cov"), F.col("var_m"))), "covariance with the market over its variance"),
        _risk("volatility", ["adj_close"], lambda: F.sqrt(at_least(F.col("var_i"), 0.0)), "deviation of daily returns"),
        _snapshot("turnover", RISK, ["turnover_rate_f", "turnover_rate"], lambda f, t: F.coalesce(f, t), "latest free-float turnover, else turnover"),
        _risk("amihud_illiquidity", ["adj_close", "amount"], lambda: F.col("illiquidity"), "mean of |return| / amount"),
        _risk("idiosyncratic_volatility", ["adj_close"], lambda: F.sqrt(at_least(F.when(F.col("var_m") > 0, F.col("var_i") - F.try_divide(F.col("cov") * F.col("cov"), F.col("var_m"))), 0.0)), "deviation that the market doesn't explain"),
        _snapshot("roe", PROFIT, ["fi_roe"], lambda x: x, "return on equity"),
        _snapshot("roa", PROFIT, ["fi_roa"], lambda x: x, "return on assets"),
        _snapshot("gross_profitability", PROFIT, ["inc_revenue", "inc_oper_cost", "bs_total_assets"], lambda r, c, a: safe_divide(r - c, a), "(revenue - cost) / assets"),
        _snapshot("gross_margin", PROFIT, ["fi_gross_margin"], lambda x: x, "gross margin"),
        _snapshot("operating_cash_flow_to_assets", PROFIT, ["cf_n_cashflow_act", "bs_total_assets"], safe_divide, "operating cash flow / assets"),
        _snapshot("accruals", PROFIT, ["inc_n_income_attr_p", "cf_n_cashflow_act", "bs_total_assets"], lambda i, c, a: safe_divide(i - c, a), "(income - cash flow) / assets"),
        _change("asset_growth", INVEST, "bs_total_assets", lambda lag: _growth(lag(0), lag(12)), "assets against 12 monthly rows ago"),
        _change("inventory_growth", INVEST, "bs_inventories", lambda lag: _growth(lag(0), lag(12)), "inventories against 12 monthly rows ago"),
        _snapshot("leverage", INVEST, ["bs_total_liab", "bs_total_assets"], safe_divide, "liabilities / assets"),
        _snapshot("net_operating_assets", INVEST, ["bs_total_assets", "bs_money_cap", "bs_total_liab"], lambda a, m, d: safe_divide(a - m - d, a), "(assets - cash - liabilities) / assets"),
    ]
)

BASE = ("rebalance_date", "trade_execution_date", "ts_code", "is_eligible", "exclude_reason", "year", "month")


def daily_returns(prices: DataFrame, *, pad: bool = True) -> DataFrame:
    """ts_code, trade_date, ret, amount. pad: a missing price counts as the one before it."""
    by_day = Window.partitionBy("ts_code").orderBy("trade_date")
    rows = prices.select("ts_code", "trade_date", number(F.col("adj_close")).alias("p"), number(F.col("amount")).alias("amount"))
    if pad:
        rows = rows.withColumn("p", F.last("p", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("ts_code", "trade_date", (safe_divide(F.col("p"), F.lag("p").over(by_day)) - 1).alias("ret"), "amount")


def market_returns(prices: DataFrame, *, pad: bool = True) -> DataFrame:
    """trade_date, mkt: the mean over all securities that have a return on the day."""
    return daily_returns(prices, pad=pad).groupBy("trade_date").agg(F.avg("ret").alias("mkt"))


def rolling_moments(prices: DataFrame, *, window: int = 252, least: int = 120, pad: bool = True, market: DataFrame | None = None) -> DataFrame:
    """ts_code, trade_date, var_i, var_m, cov, illiquidity over the last `window` rows of each security.

    Each mean skips its own missing values and needs `least` of them, hence E[xy] - E[x]E[y] instead of a
    covariance of pairs. pad: a missing price counts as the one before it. market: the market returns (market_returns()), if they have been written already, so that
    bars aren't shuffled for them again; they are joined as a broadcast, as the calendar is small.
    """
    by_day = Window.partitionBy("ts_code").orderBy("trade_date")
    rows = daily_returns(prices, pad=pad).join(F.broadcast(market_returns(prices, pad=pad) if market is None else market), "trade_date", "left")
    recent = by_day.rowsBetween(-(window - 1), 0)

    def mean(x: Column) -> Column:
        return F.when(F.count(x).over(recent) >= least, F.avg(x).over(recent))

    ret, mkt = F.col("ret"), F.col("mkt")
    costs = F.when(F.col("amount") > 0, F.abs(ret) / F.col("amount"))
    means = rows.select("ts_code", "trade_date", mean(ret).alias("r"), mean(ret * ret).alias("rr"), mean(mkt).alias("m"), mean(mkt * mkt).alias("mm"), mean(ret * mkt).alias("rm"), mean(costs).alias("illiquidity"))
    return means.select("ts_code", "trade_date", (F.col("rr") - F.col("r") * F.col("r")).alias("var_i"), (F.col("mm") - F.col("m") * F.col("m")).alias("var_m"), (F.col("rm") - F.col("r") * F.col("m")).alias("cov"), "illiquidity")


def raw_factors(snapshot: DataFrame, prices: DataFrame | None, specs: Sequence[FactorSpec], *, window: int = 252, least: int = 120, pad: bool = True, market: DataFrame | None = None) -> DataFrame:
    """The snapshot with a column factor_<name>_raw for each spec: one projection, one window, one join at most. Where all specs are of daily risk, any table with BASE will do as the snapshot."""
    require_columns(snapshot, [*BASE, *(c for s in specs if s.kind != "daily_risk" for c in s.inputs)], "snapshot")
    by_month = Window.partitionBy("ts_code").orderBy("rebalance_date")
    columns: dict[str, Column] = {s.field + "_raw": s.expression() for s in specs if s.kind == "snapshot"}
    for s in specs:
        if s.kind == "lagged":
            of = _col(s.inputs[0])
            columns[s.field + "_raw"] = s.expression(lambda k, of=of: F.lag(of, k).over(by_month) if k else of)
    out = snapshot.withColumns(columns)
    risk = [s for s in specs if s.kind == "daily_risk"]
    if risk:
        if prices is None:
            raise ValueError("daily prices are needed for " + ", ".join(s.name for s in risk))
        moments = rolling_moments(prices, window=window, least=least, pad=pad, market=market)
        dates = snapshot.select(F.col("rebalance_date").alias("trade_date")).distinct()
        at = moments.join(F.broadcast(dates), "trade_date", "left_semi").select(F.col("trade_date").alias("rebalance_date"), "ts_code", *(s.expression().alias(s.field + "_raw") for s in risk))
        out = out.join(at, ["rebalance_date", "ts_code"], "left")
    return out


def stack(df: DataFrame, fields: Sequence[str], keys: Sequence, name: str = "factor_name", value: str = "factor_value") -> DataFrame:
    """Long form: the keys, a name and a value for each of the fields, in one pass."""
    pairs = F.array(*(F.struct(F.lit(f).alias(name), F.col(f).alias(value)) for f in fields))
    return df.select(*keys, F.explode(pairs).alias("__pair")).select("*", f"__pair.{name}", f"__pair.{value}").drop("__pair")


def factor_panel(snapshot: DataFrame, prices: DataFrame | None, specs: Sequence[FactorSpec] | None = None, *, steps: Sequence[str] | None = None, neutralize_exposures: bool = True, window: int = 252, least: int = 120, pad: bool = True) -> DataFrame:
    """BASE, then factor_<name>_raw and factor_<name> for each spec.

    Factors are preprocessed together in long form and pivoted back. neutralize_exposures=False leaves industry, market and size out,
    so that the neutralising steps do nothing.
    """
    specs = FACTORS.list() if specs is None else list(specs)
    raw = raw_factors(snapshot, prices, specs, window=window, least=least, pad=pad)
    exposures = [c for c in ("industry", "market", "total_mv") if c in snapshot.columns] if neutralize_exposures else []
    keys = ["rebalance_date", "ts_code"]
    wide = raw.select(*BASE, *(F.col(s.field + "_raw") for s in specs))
    out = wide
    for chosen in dict.fromkeys(tuple(steps if steps is not None else s.steps) for s in specs):
        mine = [s for s in specs if tuple(steps if steps is not None else s.steps) == chosen]
        long = stack(raw, [s.field + "_raw" for s in mine], [*keys, "is_eligible", *exposures])
        done = preprocess(long, value="factor_value", group=["rebalance_date", "factor_name"], steps=chosen)
        back = done.groupBy(*keys).agg(*(F.max(F.when(F.col("factor_name") == s.field + "_raw", F.col("factor_value"))).alias(s.field) for s in mine))
        out = out.join(back, keys, "left")
    return out.select(*BASE, *(c for s in specs for c in (s.field + "_raw", s.field)))


def snapshot_columns(snapshot: DataFrame, specs: Sequence[FactorSpec]) -> DataFrame:
    """Only what the specs need; exposures that the table lacks become NULLs."""
    needed = dict.fromkeys([*BASE, "market", *(c for s in specs if s.kind != "daily_risk" for c in s.inputs)])
    return snapshot.select(*needed, *(c for n, c in (("industry", optional(snapshot, "industry", "string")), ("total_mv", optional(snapshot, "total_mv", "double"))) if n not in needed))
