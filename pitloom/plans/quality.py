"""Checks of the standard tables: every table's checks are one aggregation over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config

REQUIRED = {
    "calendar_table": ("trade_date", "prev_trade_date", "next_trade_date", "is_month_end", "month"),
    "adjusted_price_panel": ("ts_code", "trade_date", "open", "close", "adj_factor", "adj_open", "adj_close", "year", "month"),
    "monthly_universe": ("rebalance_date", "trade_execution_date", "ts_code", "is_eligible", "exclude_reason", "year", "month"),
    "monthly_snapshot_base": ("rebalance_date", "trade_execution_date", "ts_code", "is_eligible", "exclude_reason", "price_trade_date", "daily_basic_trade_date", "year", "month"),
}
KEYS = {"calendar_table": ("trade_date",), "adjusted_price_panel": ("ts_code", "trade_date"), "monthly_universe": ("rebalance_date", "ts_code"), "monthly_snapshot_base": ("rebalance_date", "ts_code")}
WARNINGS = ("exclude_reason_present_for_ineligible_rows",)


@dataclass(frozen=True)
class Issue:
    table: str
    check: str
    level: str
    rows: int
    message: str = ""


@dataclass
class Result:
    issues: list[Issue] = field(default_factory=list)
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)

    @property
    def failed(self) -> bool:
        return any(i.level == "error" for i in self.issues)


def _flags(condition: Column) -> Column:
    """Rows where it is true; NULL isn't."""
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def _partition(date: str) -> Column:
    return _flags(F.col("year") != F.year(date)) + _flags(F.col("month") != F.month(date))


def _present(c: str) -> Column:
    return F.coalesce(F.round(F.avg(F.col(c).isNotNull().cast("double")), 6), F.lit(0.0))


def calendar_checks(calendar: DataFrame) -> DataFrame:
    """One row: checks as counts of bad rows, metrics by their names. The calendar is one task's worth."""
    by_day = Window.orderBy("trade_date")
    month = F.date_format("trade_date", "yyyy-MM")
    rows = calendar.withColumns({"__prev": F.lag("trade_date").over(by_day), "__next": F.lead("trade_date").over(by_day), "__n": F.row_number().over(by_day), "__ends": F.sum(F.col("is_month_end").cast("long")).over(Window.partitionBy(month)), "__first": F.row_number().over(Window.partitionBy(month).orderBy("trade_date"))})
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        _flags(month != F.col("month")).alias("month_label_consistency"),
        _flags((F.coalesce("__ends", F.lit(0)) != 1) & (F.col("__first") == 1)).alias("single_month_end_per_month"),
        _flags((F.col("__n") > 1) & ~F.col("prev_trade_date").eqNullSafe(F.col("__prev"))).alias("prev_trade_date_link"),
        _flags(F.col("__next").isNotNull() & ~F.col("next_trade_date").eqNullSafe(F.col("__next"))).alias("next_trade_date_link"),
        F.count_distinct(month).alias("month_count"),
        F.coalesce(F.sum(F.col("is_month_end").cast("long")), F.lit(0)).alias("month_end_count"),
    )


def price_flags() -> dict[str, Column]:
    """Counts of bad rows, as aggregates that a write can observe."""

    def formula(adjusted: str, plain: str) -> Column:
        return _flags(~close(F.col(adjusted), F.col(plain) * F.col("adj_factor")))

    return {"partition_columns_match_trade_date": _partition("trade_date"), "adj_open_formula": formula("adj_open", "open"), "adj_close_formula": formula("adj_close", "close")}


def price_checks(prices: DataFrame) -> DataFrame:
    return prices.agg(F.count(F.lit(1)).alias("rows"), *_named(price_flags()), F.count_distinct("ts_code").alias("unique_ts_code_count"), F.count_distinct("trade_date").alias("trade_date_count"), _present("adj_factor").alias("adj_factor_non_null_ratio"))


def _named(columns: Mapping[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def universe_flags() -> dict[str, Column]:
    ineligible = ~F.coalesce("is_eligible", F.lit(False))
    return {
        "trade_execution_after_rebalance": _flags(F.col("trade_execution_date") <= F.col("rebalance_date")), "partition_columns_match_rebalance_date": _partition("rebalance_date"),
        "exclude_reason_present_for_ineligible_rows": _flags(ineligible & (F.coalesce("exclude_reason", F.lit("")) == "")),
    }


def universe_checks(universe: DataFrame) -> DataFrame:
    return universe.agg(F.count(F.lit(1)).alias("rows"), *_named(universe_flags()), F.coalesce(F.sum(F.col("is_eligible").cast("long")), F.lit(0)).alias("eligible_count"), F.coalesce(F.round(F.avg(F.coalesce("is_eligible", F.lit(False)).cast("double")), 6), F.lit(0.0)).alias("eligible_ratio"), F.count_distinct("rebalance_date").alias("rebalance_month_count"))


COVERAGE = (("price", "price_trade_date", "market"), ("daily_basic", "daily_basic_trade_date", "market"), *((p, f"{p}_tradable_date", "event" if p in ("fc", "ex") else "financial") for p in ("fi", "inc", "bs", "cf", "fc", "ex")))


def snapshot_flags(columns: Sequence[str]) -> dict[str, Column]:
    late = [_flags(F.col(c) > F.col("trade_execution_date")) for c in columns if c.endswith("_tradable_date")]
    total = late[0] if late else F.lit(0)
    for c in late[1:]:
        total = total + c
    return {
        "partition_columns_match_rebalance_date": _partition("rebalance_date"), "price_cutoff": _flags(F.col("price_trade_date") > F.col("rebalance_date")),
        "daily_basic_cutoff": _flags(F.col("daily_basic_trade_date") > F.col("rebalance_date")), "tradable_date_cutoff": total,
    }


def snapshot_checks(snapshot: DataFrame) -> DataFrame:
    covered = [_present(c).alias(f"{n}_coverage_ratio") for n, c, _ in COVERAGE if c in snapshot.columns]
    return snapshot.agg(F.count(F.lit(1)).alias("rows"), *_named(snapshot_flags(snapshot.columns)), *covered)


def write_flags(table: str, columns: Sequence[str]) -> dict[str, Column]:
    """What a write of that table observes: counts of rows that break an error-level check, by check."""
    flags = {"adjusted_price_panel": price_flags, "monthly_universe": universe_flags, "monthly_snapshot_base": lambda: snapshot_flags(columns)}[table]()
    return {n: c for n, c in flags.items() if n not in WARNINGS}


def alignment_checks(snapshot: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: keys in only one of the tables, and common keys whose audit columns differ. One full outer join."""
    keys = ["rebalance_date", "ts_code"]
    a = snapshot.select(*keys, F.col("trade_execution_date").alias("at"), F.col("is_eligible").alias("e"), F.coalesce("exclude_reason", F.lit("")).alias("r"), F.lit(True).alias("left"))
    b = universe.select(*keys, F.col("trade_execution_date").alias("uat"), F.col("is_eligible").alias("ue"), F.coalesce("exclude_reason", F.lit("")).alias("ur"), F.lit(True).alias("right"))
    both = a.join(b, keys, "full")
    same = F.col("left") & F.col("right")
    return both.agg(_flags(F.col("left").isNull() | F.col("right").isNull()).alias("key_alignment_with_monthly_universe"), _flags(same & (~F.col("e").eqNullSafe(F.col("ue")) | (F.col("r") != F.col("ur")) | ~F.col("at").eqNullSafe(F.col("uat")))).alias("universe_audit_columns_consistency"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("primary_key_unique"))


def coverage_issues(metrics: Mapping[str, float], config: Config) -> list[Issue]:
    out = []
    for name, _, kind in COVERAGE:
        ratio = metrics.get(f"{name}_coverage_ratio")
        if ratio is None:
            continue
        warn, error = getattr(config, f"{kind}_coverage_warn"), getattr(config, f"{kind}_coverage_error")
        if ratio < warn:
            out.append(Issue("monthly_snapshot_base", f"{name}_coverage", "error" if ratio < error else "warning", 0, f"{ratio} is below {error if ratio < error else warn}"))
    return out


def schema_consistency(columns: Mapping[str, Sequence[str]], table: str) -> list[Issue]:
    """columns: ordered column names by partition."""
    kinds = {tuple(c) for c in columns.values()}
    return [Issue(table, "partition_schema_consistency", "error", len(kinds), "partitions differ in their columns")] if len(kinds) > 1 else []


def validate(tables: Mapping[str, DataFrame], config: Config = Config()) -> Result:
    """All checks of the tables that are given. One small row for each aggregation reaches the driver."""
    checks = {"calendar_table": calendar_checks, "adjusted_price_panel": price_checks, "monthly_universe": universe_checks, "monthly_snapshot_base": snapshot_checks}
    out = Result()
    for table, df in tables.items():
        missing = [c for c in REQUIRED[table] if c not in df.columns]
        if missing:
            out.issues.append(Issue(table, "required_columns_present", "error", len(missing), ", ".join(missing)))
            continue
        row = checks[table](df).first().asDict() | duplicates(df, KEYS[table]).first().asDict()
        if table == "monthly_snapshot_base" and "monthly_universe" in tables:
            row |= alignment_checks(df, tables["monthly_universe"]).first().asDict()
        if not row["rows"]:
            out.issues.append(Issue(table, "non_empty", "error", 0))
        measured = {k: v for k, v in row.items() if k.endswith(("_count", "_ratio")) or k == "rows"}
        out.metrics[table] = measured
        out.issues += [Issue(table, k, "warning" if k in WARNINGS else "error", int(v)) for k, v in row.items() if k not in measured and v]
        if table == "monthly_snapshot_base":
            out.issues += coverage_issues(measured, config)
    return out


def report(result: Result) -> str:
    """Markdown."""
    lines = ["# Validation report", "", f"Status: {'failed' if result.failed else 'passed'}", "", "## Issues", ""]
    lines += [f"- {i.level}: {i.table}.{i.check}: {i.rows} rows {i.message}".rstrip() for i in result.issues] or ["None."]
    for table, metrics in result.metrics.items():
        lines += ["", f"## {table}", "", "| metric | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in sorted(metrics.items()))]
    return "\n".join(lines) + "\n"
