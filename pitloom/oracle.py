"""DuckDB SQL over the star schema for each query: written from the definitions, not from the Spark plans."""

from __future__ import annotations

import re
from functools import cache

from .plans.factors import FACTORS
from .plans.lake import BASIC, STATEMENTS
from .queries import FACTORS_OF_MANY, FACTORS_OF_SIX, SETTINGS, STEP_FACTORS

_LABELS = SETTINGS.labels
_FIELDS = SETTINGS.factors

#: Common tables by name; a query takes those that it mentions, and those that they mention.
PARTS: dict[str, str] = {
    "bars": """SELECT l_suppkey AS k, 'S' || lpad(l_suppkey::VARCHAR, 6, '0') || CASE WHEN l_suppkey % 2 = 0 THEN '.SH' ELSE '.SZ' END AS ts_code,
        date_trunc('week', l_shipdate)::DATE AS d, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high,
        sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS vol,
        sum(l_tax::DECIMAL(18,2))::DOUBLE AS tax, sum(l_discount::DECIMAL(18,2))::DOUBLE AS disc, count(*) AS n
        FROM lineitem GROUP BY 1, 2, 3""",
    "cal": "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx, lag(trade_date) OVER (ORDER BY trade_date) AS prev_trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_trade_date FROM (SELECT DISTINCT d AS trade_date FROM bars)",
    "calendar": "SELECT trade_date, prev_trade_date, next_trade_date, coalesce(strftime(trade_date, '%Y-%m') <> strftime(next_trade_date, '%Y-%m'), true) AS is_month_end, strftime(trade_date, '%Y-%m') AS month, idx FROM cal",
    "factors_of_day": "SELECT ts_code, d, 1 + 0.05::DOUBLE * (year(d) - 1995) AS adj_factor FROM bars WHERE NOT (k % 13 = 0 AND month(d) = 3) AND NOT (year(d) = 1996 AND month(d) = 5)",
    "prices": """SELECT b.ts_code, b.d AS trade_date, low AS open, high, low, amount / vol AS close, NULL::DOUBLE AS pre_close, NULL::DOUBLE AS change, NULL::DOUBLE AS pct_chg, vol, amount, adj_factor,
        low * adj_factor AS adj_open, high * adj_factor AS adj_high, low * adj_factor AS adj_low, (amount / vol) * adj_factor AS adj_close
        FROM bars b LEFT JOIN factors_of_day f USING (ts_code, d)""",
    "ends": "SELECT trade_date AS rebalance_date, next_trade_date AS trade_execution_date, idx AS rebalance_idx FROM calendar WHERE is_month_end AND trade_date BETWEEN (SELECT min(trade_date) FROM prices) AND (SELECT max(trade_date) FROM prices)",
    "features": """SELECT rebalance_date, ts_code, valid AS valid_trade_days_20d, median AS median_amount_20d, valid > 0 AS has_price_coverage, has_adj AS has_adj_factor FROM (
        SELECT ts_code, trade_date AS rebalance_date, (sum(CASE WHEN amount IS NOT NULL AND adj_close IS NOT NULL THEN 1 ELSE 0 END) OVER w)::BIGINT AS valid, quantile_cont(amount, 0.5) OVER w AS median, adj_factor IS NOT NULL AS has_adj
        FROM prices WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) JOIN ends USING (rebalance_date)""",
    "stocks": """SELECT s_suppkey AS k, 'S' || lpad(s_suppkey::VARCHAR, 6, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '.SH' ELSE '.SZ' END AS ts_code, r_name AS exchange, 'M' || n_regionkey AS market, n_name AS industry,
        ((SELECT min(trade_date) FROM cal) + ((s_suppkey % 5) * 90)::INTEGER)::DATE AS list_date, CASE WHEN s_suppkey % 17 = 0 THEN DATE '2000-06-30' END AS delist_date
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "listed_from": "SELECT s.*, c.trade_date AS from_date, c.idx AS from_idx FROM stocks s ASOF LEFT JOIN cal c ON s.list_date <= c.trade_date",
    "judged": """SELECT e.*, s.* EXCLUDE (k), f.* EXCLUDE (rebalance_date, ts_code),
        coalesce(market IN ('M0', 'M1', 'M2', 'M3'), false) AS common, coalesce(from_date <= rebalance_date, false) AS listed
        FROM ends e CROSS JOIN listed_from s LEFT JOIN features f USING (rebalance_date, ts_code)""",
    "reasoned": """SELECT *, CASE WHEN listed THEN rebalance_idx - from_idx + 1 END AS days_since_list, concat_ws('|',
        CASE WHEN NOT common THEN 'NOT_COMMON_A' END, CASE WHEN NOT listed THEN 'NOT_LISTED_YET' END,
        CASE WHEN delist_date IS NOT NULL AND NOT coalesce(trade_execution_date <= delist_date, false) THEN 'DELISTED' END,
        CASE WHEN listed AND rebalance_idx - from_idx + 1 < 12 THEN 'IPO_LT_120D' END,
        CASE WHEN common AND listed AND NOT coalesce(has_price_coverage, false) THEN 'NO_PRICE_HISTORY' END,
        CASE WHEN common AND listed AND has_price_coverage AND NOT has_adj_factor THEN 'MISSING_ADJ_FACTOR' END,
        CASE WHEN common AND listed AND has_price_coverage AND has_adj_factor AND (coalesce(valid_trade_days_20d, 0) < 10 OR coalesce(median_amount_20d, 0) < 40000) THEN 'LOW_LIQUIDITY_20D' END) AS exclude_reason FROM judged""",
    "universe": """SELECT rebalance_date, trade_execution_date, ts_code, exchange, market, list_date, delist_date, days_since_list, coalesce(valid_trade_days_20d, 0) AS valid_trade_days_20d, median_amount_20d,
        coalesce(has_price_coverage, false) AS has_price_coverage, NULL::BOOLEAN AS is_st_flag, NULL::BOOLEAN AS is_suspended_flag, exclude_reason = '' AS is_eligible, exclude_reason, year(rebalance_date) AS year, month(rebalance_date) AS month FROM reasoned""",
    "quarter_sums": """SELECT l_suppkey AS k, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS end_date,
        sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2))) AS r, sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(18,2)) AS c
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "quarters": """SELECT k, 'S' || lpad(k::VARCHAR, 6, '0') || CASE WHEN k % 2 = 0 THEN '.SH' ELSE '.SZ' END AS ts_code, end_date, (end_date + (20 + k % 40)::INTEGER)::DATE AS ann, r::DOUBLE AS revenue, c::DOUBLE AS cost,
        (sum(r + c) OVER (PARTITION BY k ORDER BY end_date))::DOUBLE AS assets FROM quarter_sums""",
    "filed": "SELECT *, CASE WHEN k % 5 <> 0 THEN (ann + (k % 3)::INTEGER)::DATE END AS f_ann, (k % 2)::VARCHAR AS flag FROM quarters",
    "basic": """SELECT ts_code, d AS daily_basic_trade_date, (amount / vol) * (1000 + k) AS total_mv, (amount / vol) * (1000 + k) * 0.6::DOUBLE AS circ_mv, 1 + 10 * (tax / n) AS pb, nullif(100 * (disc / n), 0) AS pe_ttm,
        1 + 5 * (tax / n + disc / n) AS ps_ttm, disc / n AS dv_ttm, vol / 1000 AS turnover_rate, CASE WHEN k % 7 <> 0 THEN vol / 600 END AS turnover_rate_f, n / 10 AS volume_ratio FROM bars""",
    "market_snapshot": f"""SELECT u.*, p.trade_date AS price_trade_date, p.close, p.adj_close, p.amount, p.vol, b.daily_basic_trade_date, {", ".join(f"b.{c}" for c in BASIC)}
        FROM universe u ASOF LEFT JOIN prices p ON u.ts_code = p.ts_code AND u.rebalance_date >= p.trade_date
        ASOF LEFT JOIN basic b ON u.ts_code = b.ts_code AND u.rebalance_date >= b.daily_basic_trade_date""",
}

_METRICS = {
    "fi": ("ann", "ann", None, {"roe": "revenue / assets", "roa": "cost / assets", "gross_margin": "(revenue - cost) / revenue"}),
    "inc": ("ann", "coalesce(f_ann, ann)", ("f_ann_date", "f_ann"), {"revenue": "revenue", "oper_cost": "cost", "n_income_attr_p": "revenue * 0.1::DOUBLE"}),
    "bs": ("ann", "coalesce(f_ann, ann)", ("f_ann_date", "f_ann"), {"total_assets": "assets", "total_liab": "assets * 0.4::DOUBLE + cost", "money_cap": "revenue * 0.1::DOUBLE", "inventories": "cost * 0.2::DOUBLE + 1"}),
    "cf": ("ann", "coalesce(f_ann, ann)", ("f_ann_date", "f_ann"), {"n_cashflow_act": "(revenue - cost) * (0.7::DOUBLE + 0.1::DOUBLE * (k % 4))"}),
    "fc": ("(end_date - 15)::DATE", "(end_date - 15)::DATE", ("first_ann_date", "(end_date - 15 - (k % 4)::INTEGER)::DATE"), {"net_profit_min": "revenue * 0.08::DOUBLE"}),
    "ex": ("(end_date + 10)::DATE", "(end_date + 10)::DATE", None, {"revenue": "revenue"}),
}


def _statement(p: str) -> tuple[list[str], str]:
    """Columns and SQL of one family."""
    ann, available, more, metrics = _METRICS[p]
    columns = [f"{p}_report_period", f"{p}_ann_date", *([f"{p}_{more[0]}"] if more else []), f"{p}_availability_date"]
    inner = [f"end_date AS {p}_report_period", f"{ann} AS {p}_ann_date", *([f"{more[1]} AS {p}_{more[0]}"] if more else []), f"{available} AS {p}_availability_date"]
    flag = [f"{p}_update_flag"] if p not in ("fc", "ex") else []
    names = [*columns, *flag, *(f"{p}_{m}" for m in metrics)]
    inner += [*([f"flag AS {p}_update_flag"] if flag else []), *(f"{e} AS {p}_{m}" for m, e in metrics.items())]
    sql = f"SELECT q.*, c.trade_date AS {p}_tradable_date FROM (SELECT ts_code, {', '.join(inner)} FROM filed {'WHERE k % 3 = 0' if p == 'ex' else ''}) q ASOF LEFT JOIN cal c ON q.{p}_availability_date < c.trade_date"
    return ["ts_code", *names, f"{p}_tradable_date"], sql


_STATEMENT_COLUMNS: dict[str, list[str]] = {}
for _p in STATEMENTS:
    _STATEMENT_COLUMNS[_p], PARTS[f"pit_{_p}"] = _statement(_p)
    _ties = [c for c in (f"{_p}_report_period", f"{_p}_ann_date", f"{_p}_f_ann_date", f"{_p}_update_flag") if c in _STATEMENT_COLUMNS[_p]]
    PARTS[f"last_{_p}"] = f"SELECT * FROM pit_{_p} WHERE {_p}_tradable_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts_code, {_p}_tradable_date ORDER BY {', '.join(f'{c} DESC NULLS FIRST' for c in _ties)}) = 1"

_SNAPSHOT_STATEMENTS = sorted(c for cs in _STATEMENT_COLUMNS.values() for c in cs if c != "ts_code" and not c.endswith("_update_flag"))
PARTS["snapshot"] = f"SELECT m.*, {', '.join(f'{c.split("_")[0]}.{c}' for c in _SNAPSHOT_STATEMENTS)}, s.industry FROM market_snapshot m LEFT JOIN stocks s ON s.ts_code = m.ts_code " + " ".join(f"ASOF LEFT JOIN last_{p} {p} ON m.ts_code = {p}.ts_code AND m.trade_execution_date >= {p}.{p}_tradable_date" for p in STATEMENTS)
PARTS["padded"] = "SELECT ts_code, trade_date, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS p, amount FROM prices"
PARTS["rets"] = "SELECT ts_code, trade_date, amount, p / nullif(lag(p) OVER (PARTITION BY ts_code ORDER BY trade_date), 0) - 1 AS ret FROM padded"
PARTS["with_market"] = "SELECT *, avg(ret) OVER (PARTITION BY trade_date) AS mkt FROM rets"


def _rolling(x: str, name: str) -> str:
    return f"CASE WHEN count({x}) OVER w >= 26 THEN avg({x}) OVER w END AS {name}"


PARTS["means"] = f"SELECT ts_code, trade_date, {_rolling('ret', 'r')}, {_rolling('ret * ret', 'rr')}, {_rolling('mkt', 'm')}, {_rolling('mkt * mkt', 'mm')}, {_rolling('ret * mkt', 'rm')}, {_rolling('CASE WHEN amount > 0 THEN abs(ret) / amount END', 'illiquidity')} FROM with_market WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)"
PARTS["moments"] = "SELECT ts_code, trade_date, rr - r * r AS var_i, mm - m * m AS var_m, rm - r * m AS cov, illiquidity FROM means"

_LAG = "lag({c}, {k}) OVER (PARTITION BY ts_code ORDER BY rebalance_date)"


def _lag(c: str, k: int) -> str:
    return _LAG.format(c=c, k=k)


def _over(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


_FORMULAS = {
    "size": "CASE WHEN total_mv > 0 THEN ln(total_mv) END",
    "book_to_market": _over("1", "pb"),
    "earnings_to_price": _over("1", "pe_ttm"),
    "sales_to_price": _over("1", "ps_ttm"),
    "cashflow_to_price": _over("cf_n_cashflow_act", "total_mv"),
    **{f"momentum_{k}_1": f"{_over(_lag('adj_close', 1), _lag('adj_close', k))} - 1" for k in (12, 6, 3)},
    "reversal_1m": f"-({_over('adj_close', _lag('adj_close', 1))} - 1)",
    "turnover": "coalesce(turnover_rate_f, turnover_rate)",
    "roe": "fi_roe",
    "roa": "fi_roa",
    "gross_profitability": _over("inc_revenue - inc_oper_cost", "bs_total_assets"),
    "gross_margin": "fi_gross_margin",
    "operating_cash_flow_to_assets": _over("cf_n_cashflow_act", "bs_total_assets"),
    "accruals": _over("inc_n_income_attr_p - cf_n_cashflow_act", "bs_total_assets"),
    "asset_growth": f"{_over('bs_total_assets', _lag('bs_total_assets', 12))} - 1",
    "inventory_growth": f"{_over('bs_inventories', _lag('bs_inventories', 12))} - 1",
    "leverage": _over("bs_total_liab", "bs_total_assets"),
    "net_operating_assets": _over("bs_total_assets - bs_money_cap - bs_total_liab", "bs_total_assets"),
}
_RISK = {
    "beta": "CASE WHEN var_m > 0 THEN cov / var_m END",
    "volatility": "sqrt(CASE WHEN var_i < 0 THEN 0 ELSE var_i END)",
    "amihud_illiquidity": "illiquidity",
    "idiosyncratic_volatility": "CASE WHEN var_m > 0 THEN sqrt(CASE WHEN var_i - cov * cov / var_m < 0 THEN 0 ELSE var_i - cov * cov / var_m END) END",
}

PARTS["wide"] = "SELECT s.*, " + ", ".join(f"{(_FORMULAS | _RISK)[n]} AS factor_{n}" for n in STEP_FACTORS) + " FROM snapshot s LEFT JOIN (SELECT ts_code AS m_code, trade_date AS m_date, * EXCLUDE (ts_code, trade_date) FROM moments) m ON m_code = s.ts_code AND m_date = s.rebalance_date"
PARTS["long0"] = " UNION ALL ".join(f"SELECT rebalance_date, ts_code, coalesce(is_eligible, false) AS e, industry, total_mv, 'factor_{n}_raw' AS factor_name, factor_{n} AS v FROM wide" for n in STEP_FACTORS)


def _winsorized(source: str) -> str:
    return f"SELECT * EXCLUDE (v, lo, hi), CASE WHEN v IS NULL THEN NULL ELSE least(greatest(v, coalesce(lo, v)), coalesce(hi, v)) END AS v FROM (SELECT t.*, lo, hi FROM {source} t LEFT JOIN (SELECT rebalance_date, factor_name, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM {source} WHERE e AND v IS NOT NULL GROUP BY 1, 2) USING (rebalance_date, factor_name))"


def _demeaned(source: str) -> str:
    return f"SELECT t.* EXCLUDE (v), v - coalesce(m, 0) AS v FROM {source} t LEFT JOIN (SELECT rebalance_date, factor_name, industry, avg(v) AS m FROM {source} WHERE e GROUP BY 1, 2, 3) USING (rebalance_date, factor_name, industry)"


def _sized(source: str) -> str:
    return f"""SELECT t.* EXCLUDE (v), CASE WHEN n >= 2 AND total_mv > 0 AND v IS NOT NULL THEN v - (my + CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0 END * (ln(total_mv) - mx)) ELSE v END AS v FROM {source} t LEFT JOIN (
        SELECT rebalance_date, factor_name, count(*) AS n, avg(ln(total_mv)) AS mx, avg(v) AS my, var_pop(ln(total_mv)) * count(*) AS sxx, covar_pop(ln(total_mv), v) * count(*) AS sxy FROM {source} WHERE e AND v IS NOT NULL AND total_mv > 0 GROUP BY 1, 2) USING (rebalance_date, factor_name)"""


def _standardised(source: str) -> str:
    return f"SELECT t.* EXCLUDE (v), CASE WHEN s > 1e-12 THEN (v - m) / s END AS v FROM {source} t LEFT JOIN (SELECT rebalance_date, factor_name, avg(v) AS m, stddev_pop(v) AS s FROM {source} WHERE e AND v IS NOT NULL GROUP BY 1, 2) USING (rebalance_date, factor_name)"


PARTS |= {"chain1": _winsorized("long0"), "chain2": _demeaned("chain1"), "chain3": _sized("chain2"), "chain4": _standardised("chain3"), "plain2": _standardised("chain1")}
PARTS["schedule"] = "SELECT rebalance_date, " + ", ".join(f"lead(trade_execution_date, {k}) OVER (ORDER BY rebalance_date) AS end{k}" for k in (1, 3, 6)) + " FROM ends"
PARTS["labels"] = "SELECT u.rebalance_date, u.trade_execution_date, u.ts_code, u.is_eligible, u.exclude_reason, u.trade_execution_date AS label_start_date, p0.adj_close AS label_start_adj_close, " + ", ".join(f"end{k} AS label_fwd_ret_{k}m_end_date, p{k}.adj_close AS label_fwd_ret_{k}m_end_adj_close, p{k}.adj_close / nullif(p0.adj_close, 0) - 1 AS label_fwd_ret_{k}m" for k in (1, 3, 6)) + ", u.year, u.month FROM universe u LEFT JOIN schedule s USING (rebalance_date) LEFT JOIN prices p0 ON p0.ts_code = u.ts_code AND p0.trade_date = u.trade_execution_date " + " ".join(f"LEFT JOIN prices p{k} ON p{k}.ts_code = u.ts_code AND p{k}.trade_date = end{k}" for k in (1, 3, 6))
PARTS["aligned"] = f"SELECT w.rebalance_date, w.ts_code, {', '.join(_FIELDS)}, {', '.join(_LABELS)} FROM wide w JOIN labels l ON w.rebalance_date = l.rebalance_date AND w.ts_code = l.ts_code WHERE coalesce(w.is_eligible, false)"
PARTS["pairs"] = " UNION ALL ".join(f"SELECT rebalance_date, ts_code, '{f}' AS factor_name, '{y}' AS label_name, {f} AS x, {y} AS y FROM aligned" for f in _FIELDS for y in _LABELS)
PARTS["complete"] = "SELECT * FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL"
_G = "rebalance_date, factor_name, label_name"


def _ranked(x: str, group: str) -> str:
    return f"rank() OVER (PARTITION BY {group} ORDER BY {x}) + (count(*) OVER (PARTITION BY {group}, {x}) - 1) / 2"


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


PARTS["ranks"] = f"SELECT {_G}, {_ranked('x', _G)} AS rx, {_ranked('y', _G)} AS ry FROM complete"
PARTS["ic"] = f"SELECT {_G}, rank_ic, coalesce(n, 0) AS universe_size FROM (SELECT DISTINCT {_G} FROM pairs) LEFT JOIN (SELECT {_G}, round({_corr('rx', 'ry')}, 12) AS rank_ic, count(*) AS n FROM ranks GROUP BY ALL) USING ({_G})"
_P = "factor_name, label_name"
PARTS["ic_summary"] = f"SELECT {_P}, count(rank_ic) AS observation_months, avg(rank_ic) AS ic_mean, stddev_samp(rank_ic) AS ic_std, avg((rank_ic > 0)::INTEGER) AS ic_hit_rate, avg(universe_size) AS mean_universe_size, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS icir FROM ic GROUP BY ALL"


def _bucket(x: str, group: str) -> str:
    return f"greatest(1, ((row_number() OVER (PARTITION BY {group} ORDER BY {x}, ts_code) - 1) * 5 + count(*) OVER (PARTITION BY {group}) - 2) // nullif(count(*) OVER (PARTITION BY {group}) - 1, 0))"


PARTS["bucketed"] = f"SELECT *, {_bucket('x', _G)} AS quantile, count(*) OVER (PARTITION BY {_G}) AS n FROM complete QUALIFY n >= 5"
PARTS["returns"] = f"SELECT {_G}, quantile, avg(y) AS mean_return, max(n) AS universe_size FROM bucketed GROUP BY ALL"
PARTS["quantile_means"] = f"SELECT {_P}, quantile, count(mean_return) AS observation_months, avg(mean_return) AS mean_return, stddev_samp(mean_return) AS return_std, avg((mean_return > 0)::INTEGER) AS hit_rate, avg(universe_size) AS mean_universe_size FROM returns GROUP BY ALL"
PARTS["spreads"] = f"SELECT *, top_return - bottom_return AS top_bottom_spread FROM (SELECT {_G}, max(mean_return) FILTER (quantile = 5) AS top_return, max(mean_return) FILTER (quantile = 1) AS bottom_return, max(universe_size) AS universe_size FROM returns GROUP BY ALL)"
PARTS["spread_means"] = f"SELECT {_P}, count(top_bottom_spread) AS observation_months, avg(top_bottom_spread) AS spread_mean, stddev_samp(top_bottom_spread) AS spread_std, avg((top_bottom_spread > 0)::INTEGER) AS spread_hit_rate, avg(top_bottom_spread) / nullif(stddev_samp(top_bottom_spread), 0) AS spread_ir FROM spreads GROUP BY ALL"
PARTS["curve"] = f"SELECT *, mean_return - lag(mean_return) OVER (PARTITION BY {_P} ORDER BY quantile) AS step, {_ranked('mean_return', _P)} AS r FROM quantile_means"
PARTS["whole"] = f"SELECT {_P}, max(mean_return) FILTER (quantile = 5) >= max(mean_return) FILTER (quantile = 1) AS up, {_corr('quantile', 'r')} AS rank_correlation, min(step) AS lo, max(step) AS hi, avg(step) AS step FROM curve GROUP BY ALL HAVING count(mean_return) = 5"
PARTS["month_steps"] = f"SELECT {_G}, count(*) AS n, min(step) AS lo, max(step) AS hi FROM (SELECT *, mean_return - lag(mean_return) OVER (PARTITION BY {_G} ORDER BY quantile) AS step FROM returns) GROUP BY ALL HAVING count(mean_return) = 5"
PARTS["monotone"] = f"""SELECT {_P}, CASE WHEN w.up THEN 'high_minus_low' ELSE 'low_minus_high' END AS direction, rank_correlation, CASE WHEN w.up THEN w.lo >= -1e-12 ELSE w.hi <= 1e-12 END AS is_monotonic, CASE WHEN w.up THEN step ELSE -step END AS mean_signed_step, monthly_monotonic_rate, observation_months
    FROM whole w LEFT JOIN (SELECT {_P}, avg((CASE WHEN up THEN m.lo >= -1e-12 ELSE m.hi <= 1e-12 END)::INTEGER) AS monthly_monotonic_rate, count(*) AS observation_months FROM month_steps m JOIN whole USING ({_P}) GROUP BY ALL) USING ({_P})"""
PARTS["summary"] = f"""SELECT {_P}, ic_mean, ic_std, ic_hit_rate, mean_universe_size, icir, spread_mean, spread_std, spread_hit_rate, spread_ir, direction, rank_correlation, is_monotonic, mean_signed_step, monthly_monotonic_rate,
    greatest(i.observation_months, s.observation_months, m.observation_months) AS observation_months FROM ic_summary i LEFT JOIN spread_means s USING ({_P}) LEFT JOIN monotone m USING ({_P})"""
PARTS["corr_series"] = " UNION ALL ".join(f"SELECT rebalance_date, '{a}' AS factor_a, '{b}' AS factor_b, {_corr(f'{a}', f'{b}').replace(f'stddev_pop({a})', f'stddev_pop({a}) FILTER ({b} IS NOT NULL)').replace(f'stddev_pop({b})', f'stddev_pop({b}) FILTER ({a} IS NOT NULL)') if a != b else f'var_pop({a}) / nullif(stddev_pop({a}) * stddev_pop({a}), 0)'} AS correlation, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS pair_size, count(*) AS universe_size FROM wide WHERE coalesce(is_eligible, false) GROUP BY 1" for i, a in enumerate(_FIELDS) for b in _FIELDS[i:])
PARTS["corr_means"] = "SELECT factor_a, factor_b, count(correlation) AS observation_months, avg(correlation) AS mean_corr, stddev_samp(correlation) AS corr_std, avg(abs(correlation)) AS mean_abs_corr, max(abs(correlation)) AS max_abs_corr, avg(pair_size) AS mean_pair_size FROM corr_series GROUP BY ALL"
PARTS["corr_both"] = "SELECT factor_a, factor_b, mean_corr FROM corr_means UNION SELECT factor_b, factor_a, mean_corr FROM corr_means"


def _orthogonal(name: str, source: str, steps: int) -> str:
    """Parts {name}0 to {name}{steps - 1}: each takes one more column out of those after it (modified Gram-Schmidt). source: a (columns as lists), a0 (their lengths at first) and w, a list of numbers for each
    column that goes along with it. A column that those before explain is left as it is. Gives the last part's name."""
    for p in range(steps):
        q, there = f"a[{p + 1}]", f"sqrt(list_dot_product(a[{p + 1}], a[{p + 1}])) > 1e-10 * a0[{p + 1}]"
        shares = f"SELECT *, CASE WHEN {there} THEN list_transform(a, lambda c: list_dot_product({q}, c) / list_dot_product({q}, {q})) END AS d FROM {source if p == 0 else f'{name}{p - 1}'}"
        taken = lambda x: f"CASE WHEN d IS NULL THEN {x} ELSE list_transform({x}, lambda c, j: CASE WHEN j <= {p + 1} THEN c ELSE list_transform(c, lambda v, i: v - {x}[{p + 1}][i] * d[j]) END) END AS {x}"  # noqa: B023, E731
        PARTS[f"{name}{p}"] = f"SELECT * EXCLUDE (a, w, d), {taken('a')}, {taken('w')} FROM ({shares})"
    return f"{name}{steps - 1}"


def _length(x: str) -> str:
    return f"sqrt(list_dot_product({x}, {x}))"


def _regressions(name: str, factors: tuple[str, ...]) -> None:
    """Parts {name}_residuals, _redundancy, _fm for these factors and all labels."""
    fields = [f"factor_{n}" for n in factors]
    k, whole = len(fields), " AND ".join(f"factor_{n} IS NOT NULL" for n in factors)
    columns = lambda names: f"[{', '.join(f'list({f}::DOUBLE ORDER BY ts_code)' for f in names)}]"
    centred = "list_transform(xs, lambda c, j: list_transform(c, lambda v: v - mu[j]))"
    means = "list_transform(xs, lambda c: list_avg(c))"
    # each factor after all others
    PARTS[f"{name}_x"] = f"SELECT *, {centred} AS cs FROM (SELECT *, {means} AS mu FROM (SELECT rebalance_date, count(*) AS n, list(ts_code ORDER BY ts_code) AS codes, {columns(fields)} AS xs FROM aligned WHERE {whole} GROUP BY 1 HAVING count(*) >= {k}))"
    PARTS[f"{name}_t"] = f"SELECT rebalance_date, n, codes, t, mu[t] AS mean, a, list_transform(a, lambda c: {_length('c')}) AS a0, list_transform(a, lambda c: [0.0::DOUBLE]) AS w FROM (SELECT *, list_filter(cs, lambda c, j: j <> t) || [cs[t]] AS a FROM {name}_x CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS t))"
    last = _orthogonal(f"{name}_o", f"{name}_t", k - 1)
    PARTS[f"{name}_rest"] = f"SELECT rebalance_date, n, codes, [{', '.join(repr(f) for f in fields)}][t] AS factor_name, a[{k}] AS rest, {_length(f'a[{k}]')} AS kept, CASE WHEN a0[{k}] > 1e-10 * sqrt(n * (1 + mean * mean)) THEN a0[{k}] END AS own FROM {last}"
    unit = "(coalesce(own / sqrt(n), 1.0) / CASE WHEN own IS NULL OR kept > 1e-4 * own THEN 1e9::DOUBLE ELSE 1e13::DOUBLE END)"
    nothing = "own IS NOT NULL AND kept <= 1e-11 * own"
    PARTS[f"{name}_residuals"] = f"SELECT rebalance_date, unnest(codes) AS ts_code, factor_name, unnest(list_transform(rest, lambda v: CASE WHEN {nothing} THEN 0 ELSE round(v / {unit}) * {unit} END)) AS e, CASE WHEN {nothing} THEN 1 ELSE 1 - (kept / own) * (kept / own) END AS r2, n FROM {name}_rest"
    PARTS[f"{name}_base"] = f"SELECT rebalance_date, factor_name, max(r2) AS r2, max(n) AS n_obs FROM {name}_residuals GROUP BY ALL"
    PARTS[f"{name}_pairs"] = " UNION ALL ".join(f"SELECT r.rebalance_date, r.factor_name, '{y}' AS label_name, r.ts_code, e AS x, {y} AS y FROM {name}_residuals r JOIN aligned a ON a.rebalance_date = r.rebalance_date AND a.ts_code = r.ts_code WHERE {y} IS NOT NULL" for y in _LABELS)
    PARTS[f"{name}_sizes"] = f"SELECT {_G}, count(*) AS residual_universe_size, stddev_pop(x) > 1e-12 AS varies FROM {name}_pairs GROUP BY ALL"
    PARTS[f"{name}_ic"] = f"SELECT {_G}, {_corr('rx', 'ry')} AS ic FROM (SELECT {_G}, {_ranked('x', _G)} AS rx, {_ranked('y', _G)} AS ry FROM {name}_pairs) GROUP BY ALL"
    PARTS[f"{name}_spread"] = f"SELECT {_G}, avg(y) FILTER (quantile = 5) - avg(y) FILTER (quantile = 1) AS spread FROM (SELECT *, {_bucket('x', _G)} AS quantile FROM {name}_pairs QUALIFY count(*) OVER (PARTITION BY {_G}) >= 5) GROUP BY ALL"
    PARTS[f"{name}_redundancy"] = f"SELECT {_G}, r2, n_obs, coalesce(residual_universe_size, 0) AS residual_universe_size, round(CASE WHEN varies THEN ic END, 12) AS residual_rank_ic, CASE WHEN varies THEN spread END AS residual_spread FROM {name}_base CROSS JOIN (SELECT unnest([{', '.join(repr(y) for y in _LABELS)}]) AS label_name) LEFT JOIN {name}_sizes USING ({_G}) LEFT JOIN {name}_ic USING ({_G}) LEFT JOIN {name}_spread USING ({_G})"
    # the label after all factors; w says what combination of the columns each has become
    PARTS[f"{name}_l"] = " UNION ALL ".join(f"SELECT rebalance_date, '{y}' AS label_name, count(*) AS n, {columns([*fields, y])} AS xs FROM aligned WHERE {whole} AND {y} IS NOT NULL GROUP BY 1 HAVING count(*) >= {k + 1}" for y in _LABELS)
    PARTS[f"{name}_y"] = f"SELECT rebalance_date, label_name, n, mu, a, list_transform(a, lambda c: {_length('c')}) AS a0, list_transform(range({k + 1}), lambda j: list_transform(range({k + 1}), lambda i: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS w FROM (SELECT *, {centred} AS a FROM (SELECT *, {means} AS mu FROM {name}_l))"
    last = _orthogonal(f"{name}_p", f"{name}_y", k)
    skipped = f"list_filter(range(1, {k + 1}), lambda p: {_length('a[p]')} <= 1e-10 * a0[p])"
    # coefficients with the constant's first, and what may be added without changing the fit
    with_constant = lambda v: f"[{v[1]} - list_dot_product({v[0]}, mu[1:{k}])] || {v[0]}"
    PARTS[f"{name}_b"] = f"SELECT rebalance_date, label_name, n, len(s) AS skipped, {with_constant(('b', f'mu[{k + 1}]'))} AS c, list_transform(s, lambda p: {with_constant((f'w[p][1:{k}]', '0'))}) AS vs FROM (SELECT *, {skipped} AS s, list_transform(w[{k + 1}][1:{k}], lambda x: -x) AS b FROM {last})"
    for p in range(1, 7):  # of all solutions the one of least norm
        v = f"vs[{p}]"
        PARTS[f"{name}_n{p}"] = f"SELECT rebalance_date, label_name, n, skipped, CASE WHEN skipped < {p} THEN c ELSE list_transform(c, lambda x, i: x - {v}[i] * gc) END AS c, CASE WHEN skipped < {p} THEN vs ELSE list_transform(vs, lambda u, j: CASE WHEN j <= {p} THEN u ELSE list_transform(u, lambda x, i: x - {v}[i] * gs[j]) END) END AS vs FROM (SELECT *, list_dot_product({v}, c) / list_dot_product({v}, {v}) AS gc, list_transform(vs, lambda u: list_dot_product({v}, u) / list_dot_product({v}, {v})) AS gs FROM {f'{name}_n{p - 1}' if p > 1 else f'{name}_b'})"
    terms = ["intercept", *fields]
    PARTS[f"{name}_fm"] = f"SELECT rebalance_date, label_name, unnest([{', '.join(repr(t) for t in terms)}]) AS term, unnest(c) AS coefficient, n AS n_obs, {k} AS regressor_count, {k + 1} - skipped AS design_rank, skipped = 0 AS full_rank FROM {name}_n6"


_regressions("reg", STEP_FACTORS)
_regressions("six", FACTORS_OF_SIX)
_regressions("many", FACTORS_OF_MANY)
PARTS["redundancy_means"] = f"""SELECT {_P}, r.* EXCLUDE ({_P}), ic_mean, spread_mean, residual_ic_mean / nullif(residual_ic_std, 0) AS residual_icir, residual_spread_mean / nullif(residual_spread_std, 0) AS residual_spread_ir,
    residual_ic_mean / nullif(ic_mean, 0) AS residual_ic_retention, residual_spread_mean / nullif(spread_mean, 0) AS residual_spread_retention
    FROM (SELECT {_P}, count(DISTINCT rebalance_date) AS observation_months, avg(r2) AS mean_r2, avg(residual_rank_ic) AS residual_ic_mean, stddev_samp(residual_rank_ic) AS residual_ic_std, avg((residual_rank_ic > 0)::INTEGER) AS residual_ic_hit_rate,
        avg(residual_spread) AS residual_spread_mean, stddev_samp(residual_spread) AS residual_spread_std, avg((residual_spread > 0)::INTEGER) AS residual_spread_hit_rate, avg(residual_universe_size) AS mean_residual_universe_size FROM reg_redundancy GROUP BY ALL) r LEFT JOIN summary USING ({_P})"""
PARTS["periods"] = "SELECT rebalance_date, ntile(3) OVER (ORDER BY rebalance_date) AS period FROM (SELECT DISTINCT rebalance_date FROM aligned)"
PARTS["subperiods"] = f"""SELECT period, 'period_' || period AS period_label, period_start, period_end, {_P}, ic_months, ic_mean, ic_std, ic_hit_rate, spread_mean, spread_std, spread_hit_rate, ic_mean / nullif(ic_std, 0) AS icir, spread_mean / nullif(spread_std, 0) AS spread_ir
    FROM (SELECT period, {_P}, count(rank_ic) AS ic_months, avg(rank_ic) AS ic_mean, stddev_samp(rank_ic) AS ic_std, avg((rank_ic > 0)::INTEGER) AS ic_hit_rate FROM ic JOIN periods USING (rebalance_date) GROUP BY ALL)
    LEFT JOIN (SELECT period, {_P}, avg(top_bottom_spread) AS spread_mean, stddev_samp(top_bottom_spread) AS spread_std, avg(coalesce(top_bottom_spread > 0, false)::INTEGER) AS spread_hit_rate FROM spreads JOIN periods USING (rebalance_date) GROUP BY ALL) USING (period, {_P})
    JOIN (SELECT period, min(rebalance_date) AS period_start, max(rebalance_date) AS period_end FROM periods GROUP BY 1) USING (period)"""
PARTS["robust"] = f"""SELECT {_P}, count(*) AS periods, max(s.ic_mean) AS ic_mean, min(p.ic_mean) AS min_period_ic, max(p.ic_mean) AS max_period_ic, CASE WHEN max(s.ic_mean) <> 0 THEN avg(coalesce(sign(p.ic_mean) = sign(s.ic_mean), false)::INTEGER) END AS ic_sign_consistency,
    max(s.spread_mean) AS spread_mean, min(p.spread_mean) AS min_period_spread, max(p.spread_mean) AS max_period_spread, CASE WHEN max(s.spread_mean) <> 0 THEN avg(coalesce(sign(p.spread_mean) = sign(s.spread_mean), false)::INTEGER) END AS spread_sign_consistency FROM subperiods p LEFT JOIN summary s USING ({_P}) GROUP BY ALL"""
PARTS["fm_means"] = "SELECT label_name, term, count(coefficient) AS observation_months, avg(coefficient) AS mean_coefficient, stddev_samp(coefficient) AS coefficient_std, avg((coefficient > 0)::INTEGER) AS positive_ratio, avg(n_obs) AS mean_n_obs, avg(full_rank::INTEGER) AS full_rank_ratio, avg(coefficient) / nullif(stddev_samp(coefficient) / sqrt(count(coefficient)), 0) AS t_stat FROM reg_fm GROUP BY ALL"

# each batch of the stream: the latest time of those before it (with what is delivered again), and of it and those before, less three days
PARTS["deliveries"] = """SELECT ts, (date_diff('day', DATE '2024-01-01', ts::DATE) + CASE WHEN event_id % 101 = 0 THEN 15 WHEN event_id % 17 = 0 THEN 2 ELSE 0 END + again) // 10 AS batch
    FROM events, (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR event_id % 13 = 0"""
PARTS["marks"] = """SELECT batch, max(last) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3 DAY AS mark, max(last) OVER (ORDER BY batch) - INTERVAL 3 DAY AS next_mark
    FROM (SELECT batch, date_trunc('millisecond', max(ts)) AS last FROM deliveries WHERE batch < 5 GROUP BY 1)"""

_MV = ("total_mv", "circ_mv", "pb", "pe_ttm", "ps_ttm", "dv_ttm", "turnover_rate", "turnover_rate_f", "volume_ratio")
_MARKET = ["rebalance_date", "ts_code", "price_trade_date", "close", "adj_close", "amount", "vol", "daily_basic_trade_date", *_MV]
_UNIVERSE = "rebalance_date, trade_execution_date, ts_code, exchange, market, list_date, delist_date, days_since_list, valid_trade_days_20d, median_amount_20d, has_price_coverage, is_st_flag, is_suspended_flag, is_eligible, exclude_reason, year, month"
_COVERED = ", ".join(f"coalesce(round(avg(({c} IS NOT NULL)::INTEGER), 6), 0) AS {n}_coverage_ratio" for n, c in (("price", "price_trade_date"), ("daily_basic", "daily_basic_trade_date"), *((p, f"{p}_tradable_date") for p in STATEMENTS)))


def _pivot(chain: str) -> str:
    cells = ", ".join(f"max(w.factor_{n}) AS factor_{n}_raw, max(v) FILTER (factor_name = 'factor_{n}_raw') AS factor_{n}" for n in STEP_FACTORS)
    return f"SELECT rebalance_date, ts_code, {cells} FROM wide w LEFT JOIN {chain} USING (rebalance_date, ts_code) GROUP BY 1, 2"


def _significant(*names: str) -> str:
    return ", ".join(f"CASE WHEN {c} = 0 THEN {c} ELSE round({c} / pow(10.0, floor(log10(abs({c}))) - 5)) * pow(10.0, floor(log10(abs({c}))) - 5) END AS {c}" for c in names)


def _board(table: str, columns: str, order: str, where: str = "true", k: int = 5) -> str:
    order = re.sub(r"\b(\w+)((?: DESC)? NULLS LAST)", r"round(\1, 12)\2", order)
    return f"SELECT {columns} FROM {table} WHERE {where} ORDER BY {order} LIMIT {k}"


SELECTS: dict[str, str] = {
    "calendar_table": "SELECT trade_date, prev_trade_date, next_trade_date, is_month_end, month FROM calendar",
    "adjusted_price_panel": "SELECT * FROM prices",
    "missing_factor_months": "SELECT DISTINCT year(trade_date) AS year, month(trade_date) AS month FROM prices EXCEPT SELECT year(d), month(d) FROM factors_of_day",
    "tradable_date_map": "SELECT day, (SELECT min(trade_date) FROM cal WHERE trade_date > day) AS next_day, (SELECT min(trade_date) FROM cal WHERE trade_date >= day) AS on_or_after, (SELECT min(idx) FROM cal WHERE trade_date >= day) AS trade_idx FROM (SELECT unnest(generate_series((SELECT min(trade_date) - 1 FROM cal)::TIMESTAMP, (SELECT max(trade_date) FROM cal)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)",
    "asof_join": "SELECT u.rebalance_date, u.ts_code, p.trade_date, p.close, p.vol FROM universe u ASOF LEFT JOIN prices p ON u.ts_code = p.ts_code AND u.rebalance_date >= p.trade_date",
    "asof_join_buckets": "SELECT u.rebalance_date, u.ts_code, p.trade_date, p.close, p.vol FROM universe u ASOF LEFT JOIN prices p ON u.ts_code = p.ts_code AND u.rebalance_date >= p.trade_date",
    "price_ranks": "SELECT ts_code, trade_date, rank() OVER (ORDER BY vol) + (count(*) OVER (PARTITION BY vol) - 1) / 2 AS average_rank, greatest(1, ((row_number() OVER (ORDER BY vol, ts_code, trade_date) - 1) * 10 + count(*) OVER () - 2) // nullif(count(*) OVER () - 1, 0)) AS decile FROM prices WHERE vol IS NOT NULL",
    "factor_quantiles": "SELECT factor_name, quantile_cont(v, 0.01) AS q0, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.99) AS q3 FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS factor_name, {f} AS v FROM wide" for f in _FIELDS) + ") WHERE v IS NOT NULL GROUP BY 1",
    "rolling_amounts": "SELECT ts_code, trade_date, round(sum(amount) OVER w * 100)::BIGINT AS cents, median(amount) OVER w AS amount_median, count(amount) OVER w AS valid_rows FROM prices WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "month_ends": "SELECT * FROM ends",
    "universe_features": "SELECT * FROM features",
    "monthly_universe": f"SELECT {_UNIVERSE} FROM universe",
    "universe_reason_counts": "SELECT exclude_reason, is_eligible, count(*) AS n FROM universe GROUP BY ALL",
    **{f"statement_pit_{p}": f"SELECT {', '.join(_STATEMENT_COLUMNS[p])} FROM pit_{p}" for p in STATEMENTS},
    "snapshot_market": f"SELECT {', '.join(_MARKET)} FROM market_snapshot",
    "snapshot_statements": f"SELECT rebalance_date, ts_code, {', '.join(_SNAPSHOT_STATEMENTS)} FROM snapshot",
    "monthly_snapshot_base": f"SELECT {_UNIVERSE}, {', '.join(_MARKET[2:])}, {', '.join(_SNAPSHOT_STATEMENTS)}, industry FROM snapshot",
    "rolling_moments": "SELECT * FROM moments",
    **{f"factor_{s.name}_raw": f"SELECT rebalance_date, ts_code, {_FORMULAS[s.name]} AS value FROM snapshot" if s.name in _FORMULAS else f"SELECT u.rebalance_date, u.ts_code, {_RISK[s.name]} AS value FROM universe u LEFT JOIN moments m ON m.ts_code = u.ts_code AND m.trade_date = u.rebalance_date" for s in FACTORS.list()},
    "pre_winsorize": "SELECT rebalance_date, ts_code, factor_name, v AS factor_value FROM chain1",
    "pre_winsorize_by_order": "SELECT rebalance_date, ts_code, factor_name, v AS factor_value FROM chain1",
    "pre_demean": f"SELECT rebalance_date, ts_code, factor_name, v AS factor_value FROM ({_demeaned('long0')})",
    "pre_size": f"SELECT rebalance_date, ts_code, factor_name, v AS factor_value FROM ({_sized('long0')})",
    "pre_zscore": f"SELECT rebalance_date, ts_code, factor_name, v AS factor_value FROM ({_standardised('long0')})",
    "pre_chain": "SELECT rebalance_date, ts_code, factor_name, v AS factor_value FROM chain4",
    "factor_panel": _pivot("chain4"),
    "factor_panel_plain": _pivot("plain2"),
    "label_panel": "SELECT * FROM labels",
    **{y.removeprefix("label_"): f"SELECT rebalance_date, ts_code, {y} AS value FROM labels" for y in _LABELS},
    "evaluation_input": "SELECT * FROM aligned",
    "rank_ic_timeseries": "SELECT * FROM ic",
    "rank_ic_summary": "SELECT * FROM ic_summary",
    "quantile_buckets": f"SELECT rebalance_date, ts_code, coalesce({_bucket('factor_size', 'rebalance_date')}, 1) AS quantile FROM aligned WHERE factor_size IS NOT NULL",
    "quantile_returns": "SELECT * FROM returns",
    "quantile_summary": "SELECT * FROM quantile_means",
    "spread_timeseries": "SELECT * FROM spreads",
    "spread_summary": "SELECT * FROM spread_means",
    "monotonicity_summary": "SELECT * FROM monotone",
    "evaluation_summary": "SELECT * FROM summary",
    "factor_corr_timeseries": "SELECT * FROM corr_series",
    "factor_corr_summary": "SELECT * FROM corr_means",
    "factor_corr_matrix": f"SELECT factor_a AS factor_name, {', '.join(f'''max(mean_corr) FILTER (factor_b = '{f}') AS {f}''' for f in _FIELDS)} FROM corr_both GROUP BY 1",
    "redundancy_timeseries": "SELECT * FROM reg_redundancy",
    "redundancy_six": "SELECT * FROM six_redundancy",
    "redundancy_many": "SELECT * FROM many_redundancy",
    "redundancy_summary": "SELECT * FROM redundancy_means",
    "robustness_periods": "SELECT period, min(rebalance_date) AS start_date, max(rebalance_date) AS end_date, count(*) AS months FROM periods GROUP BY 1",
    "subperiod_summary": "SELECT * FROM subperiods",
    "robustness_summary": "SELECT * FROM robust",
    "fama_macbeth_timeseries": f"SELECT * REPLACE ({_significant('coefficient')}) FROM reg_fm",
    "fama_macbeth_six": "SELECT * FROM six_fm",
    "fama_macbeth_many": "SELECT * FROM many_fm",
    "fama_macbeth_summary": f"SELECT * REPLACE ({_significant('mean_coefficient', 'coefficient_std')}) FROM fm_means",
    "validate_calendar": "SELECT count(*) AS rows, 0 AS month_label_consistency, (SELECT count(*) FROM (SELECT 1 FROM calendar GROUP BY strftime(trade_date, '%Y-%m') HAVING sum(is_month_end::INTEGER) <> 1)) AS single_month_end_per_month, 0 AS prev_trade_date_link, 0 AS next_trade_date_link, count(DISTINCT month) AS month_count, sum(is_month_end::INTEGER)::BIGINT AS month_end_count FROM calendar",
    "validate_prices": "SELECT count(*) AS rows, 0 AS partition_columns_match_trade_date, count(*) FILTER (abs(adj_open - open * adj_factor) > 1e-8 + 1e-5 * abs(open * adj_factor)) AS adj_open_formula, count(*) FILTER (abs(adj_close - close * adj_factor) > 1e-8 + 1e-5 * abs(close * adj_factor)) AS adj_close_formula, count(DISTINCT ts_code) AS unique_ts_code_count, count(DISTINCT trade_date) AS trade_date_count, round(avg((adj_factor IS NOT NULL)::INTEGER), 6) AS adj_factor_non_null_ratio FROM prices",
    "validate_universe": "SELECT count(*) AS rows, count(*) FILTER (trade_execution_date <= rebalance_date) AS trade_execution_after_rebalance, 0 AS partition_columns_match_rebalance_date, count(*) FILTER (NOT is_eligible AND exclude_reason = '') AS exclude_reason_present_for_ineligible_rows, count(*) FILTER (is_eligible) AS eligible_count, round(avg(is_eligible::INTEGER), 6) AS eligible_ratio, count(DISTINCT rebalance_date) AS rebalance_month_count FROM universe",
    "validate_snapshot": f"SELECT count(*) AS rows, 0 AS partition_columns_match_rebalance_date, count(*) FILTER (price_trade_date > rebalance_date) AS price_cutoff, count(*) FILTER (daily_basic_trade_date > rebalance_date) AS daily_basic_cutoff, {' + '.join(f'count(*) FILTER ({p}_tradable_date > trade_execution_date)' for p in STATEMENTS)} AS tradable_date_cutoff, {_COVERED} FROM snapshot",
    "validate_alignment": "SELECT count(*) FILTER (s.ts_code IS NULL OR u.ts_code IS NULL) AS key_alignment_with_monthly_universe, count(*) FILTER (s.ts_code IS NOT NULL AND u.ts_code IS NOT NULL AND (s.is_eligible IS DISTINCT FROM u.is_eligible OR s.exclude_reason IS DISTINCT FROM u.exclude_reason OR s.trade_execution_date IS DISTINCT FROM u.trade_execution_date)) AS universe_audit_columns_consistency FROM snapshot s FULL JOIN universe u ON s.rebalance_date = u.rebalance_date AND s.ts_code = u.ts_code",
    "validate_duplicates": "SELECT coalesce(sum(n), 0)::BIGINT AS primary_key_unique FROM (SELECT count(*) AS n FROM prices GROUP BY trade_date HAVING count(*) > 1)",
    "upsert_by_month": "SELECT ts_code, trade_date, CASE WHEN year(trade_date) = 1996 THEN close * 2 ELSE close END AS close FROM prices",
    "replace_by_month": "SELECT ts_code, trade_date, close, year(trade_date) AS year, month(trade_date) AS month FROM prices",
    "late_events": """SELECT day AS window_start, event_type, count(*) AS events, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM (
        SELECT *, ts::DATE AS day, (date_diff('day', DATE '2024-01-01', ts::DATE) + CASE WHEN event_id % 101 = 0 THEN 15 WHEN event_id % 17 = 0 THEN 2 ELSE 0 END) // 10 AS batch FROM events
        ) e JOIN marks m USING (batch) WHERE batch < 5 AND (m.mark IS NULL OR ts > m.mark) AND day + INTERVAL 1 DAY <= (SELECT max(next_mark) FROM marks) GROUP BY 1, 2""",
    "incremental_ingest": """WITH last AS (SELECT max(trade_date) AS day FROM prices WHERE trade_date <= DATE '1998-06-30'),
        start AS (SELECT min(trade_date) AS day FROM (SELECT trade_date FROM cal WHERE trade_date BETWEEN (SELECT day - 80 FROM last) AND (SELECT day FROM last) ORDER BY trade_date DESC LIMIT 21))
        SELECT ts_code, trade_date, close, CASE WHEN trade_date >= (SELECT day FROM start) THEN 2 * vol ELSE vol END AS vol, amount FROM prices""",
    "leaderboard_top_ic": _board("ic_summary", "factor_name, label_name, ic_mean, icir, ic_hit_rate", "ic_mean DESC NULLS LAST, factor_name, label_name"),
    "leaderboard_bottom_ic": _board("ic_summary", "factor_name, label_name, ic_mean, icir, ic_hit_rate", "ic_mean NULLS LAST, factor_name, label_name"),
    "leaderboard_top_spread": _board("spread_means", "factor_name, label_name, spread_mean, spread_ir", "spread_mean DESC NULLS LAST, factor_name, label_name"),
    "leaderboard_top_t_stat": _board("fm_means", "term, label_name, mean_coefficient, t_stat", "t_stat DESC NULLS LAST, term, label_name", "term <> 'intercept'"),
    "leaderboard_top_correlation": _board("corr_means", "factor_a, factor_b, mean_corr, mean_abs_corr", "mean_abs_corr DESC NULLS LAST, factor_a, factor_b", "factor_a <> factor_b"),
    "leaderboard_top_redundancy": _board("redundancy_means", "factor_name, label_name, mean_r2, residual_ic_retention", "mean_r2 DESC NULLS LAST, factor_name, label_name"),
    "leaderboard_top_robustness": _board("robust", "factor_name, label_name, ic_sign_consistency, spread_sign_consistency, ic_mean", "ic_sign_consistency DESC NULLS LAST, spread_sign_consistency DESC NULLS LAST, factor_name, label_name"),
    "leaderboard_weakest_robustness": _board("robust", "factor_name, label_name, ic_sign_consistency, spread_sign_consistency, ic_mean", "ic_sign_consistency NULLS LAST, factor_name, label_name"),
    "leaderboard_top_subperiods": _board("subperiods", "period, factor_name, label_name, ic_mean, spread_mean", "ic_mean DESC NULLS LAST, spread_mean DESC NULLS LAST, period, factor_name, label_name", k=6),
}


@cache
def _mentioned(sql: str) -> tuple[str, ...]:
    """The parts that it reads, in the order of PARTS."""
    read = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql))
    return tuple(n for n in PARTS if n in read)


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in _mentioned(sql):
        if name not in found:
            _needed(PARTS[name], found)
            found[name] = None


def assembled(select: str, doubles: list[str]) -> str:
    """The query with its doubles rounded like the Spark results."""
    found: dict[str, None] = {}
    _needed(select, found)
    rounded = f" REPLACE ({', '.join(f'round({c} * (1 + 1e-12::DOUBLE), CASE WHEN abs({c}) < 0.001 THEN 9 ELSE 6 END) + 0.0::DOUBLE AS {c}' for c in doubles)})" if doubles else ""
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in found) + f"\nSELECT *{rounded} FROM ({select})"


#: The star schema, for finding out which result columns are doubles.
SCHEMA = """
    CREATE TABLE region (r_regionkey INTEGER, r_name VARCHAR);
    CREATE TABLE nation (n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER);
    CREATE TABLE supplier (s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE);
    CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR);
    CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR);
    CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP);
"""


def oracle_sql() -> dict[str, str]:
    import duckdb

    con = duckdb.connect()
    for statement in SCHEMA.strip().split(";\n"):
        con.execute(statement)
    out, made = {}, set()
    for name, select in SELECTS.items():
        found: dict[str, None] = {}
        _needed(select, found)
        for part in found:  # empty, for their columns
            if part not in made:
                con.execute(f"CREATE TABLE {part} AS {PARTS[part]}")
                made.add(part)
        kinds = con.execute("DESCRIBE " + select).fetchall()
        out[name] = assembled(select, [k[0] for k in kinds if k[1] == "DOUBLE"])
    con.close()
    return out
