"""Command line: ingest, build, validate, research."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence

from ..config import Config
from ..logs import logger
from ..plans.lake import STATEMENTS, UniverseRules, adjusted_price_panel, calendar_table, missing_factor_months, monthly_snapshot_base, monthly_universe, statement_pit_table
from ..plans.quality import report, schema_consistency, validate, write_flags
from ..session import session
from ..sources.market import TABLES, MarketSource
from ..sources.state import IngestionState
from ..sources.store import Store
from ..streaming.ingest import Ingestor
from . import experiment as x

LAKE = ("calendar_table", "adjusted_price_panel", "monthly_universe", "monthly_snapshot_base")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pitloom")
    top.add_argument("--root", default=None)
    top.add_argument("--log", default=None, help="a file for log lines, besides standard error")
    sub = top.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("table", choices=[*TABLES, "all"])
    ingest.add_argument("--end")
    for flag in ("--full-refresh", "--replace", "--dry-run"):
        ingest.add_argument(flag, action="store_true")
    build = sub.add_parser("build")
    build.add_argument("table", choices=[*LAKE, "all"])
    sub.add_parser("validate")
    research = sub.add_parser("research")
    research.add_argument("stage", choices=["init", "build-factors", "build-labels", "build-evaluation", "build-report"])
    research.add_argument("--name", required=True)
    research.add_argument("--as-of")
    research.add_argument("--factors", nargs="*")
    research.add_argument("--labels", nargs="*")
    research.add_argument("--quantiles", type=int, default=5)
    research.add_argument("--periods", type=int, default=3)
    research.add_argument("--dry-run", action="store_true")
    return top


def build_table(store: Store, table: str, config: Config, rules: UniverseRules | None = None) -> None:
    """One lake table from raw and earlier lake tables. Those by month are published only if their checks pass; the write itself counts."""

    def publish(df, date: str, keys: list[str]) -> None:
        store.replace_checked(df, table, date=date, keys=keys, flags=write_flags(table, df.columns))

    raw = lambda t: store.read(f"raw/{t}")
    rules = rules or UniverseRules(config.ipo_min_trade_days, config.liquidity_window, config.min_valid_trade_days, config.min_median_amount)
    if table == "calendar_table":
        store.overwrite(calendar_table(raw("trade_cal")), table)
    elif table == "adjusted_price_panel":
        missing = missing_factor_months(raw("daily"), raw("adj_factor")).limit(1).collect()
        if missing:
            raise FileNotFoundError(f"adj_factor has nothing for {missing[0].year}-{missing[0].month:02d}")
        publish(adjusted_price_panel(raw("daily"), raw("adj_factor"), check=False), "trade_date", ["ts_code", "trade_date"])
    elif table == "monthly_universe":
        publish(monthly_universe(store.read("calendar_table"), raw("stock_basic"), store.read("adjusted_price_panel"), rules), "rebalance_date", ["rebalance_date", "ts_code"])
    else:
        families = {p: t for p, s in STATEMENTS.items() if (t := store.read_optional(f"raw/{s.table}")) is not None}
        calendar = store.read("calendar_table")
        statements = {p: statement_pit_table(t.drop("year", "month"), calendar, STATEMENTS[p]) for p, t in families.items()}
        publish(monthly_snapshot_base(store.read("monthly_universe"), store.read("adjusted_price_panel"), raw("daily_basic"), statements), "rebalance_date", ["rebalance_date", "ts_code"])


def main(argv: Sequence[str] | None = None, source: Callable[[], MarketSource] | None = None) -> int:
    """source makes the market source that ingestion asks."""
    args = parser().parse_args(argv)
    config = Config.from_env()
    root = args.root or config.root
    spark = session()
    store = Store(spark, root)
    log = logger("pitloom", args.log)
    log.info("%s %s", args.command, " ".join(f"{k}={v}" for k, v in vars(args).items() if v and k not in ("command", "root", "log")))
    if args.command == "ingest":
        if source is None:
            raise SystemExit("no market source is configured")
        ingestor = Ingestor(spark, source(), Store(spark, f"{root}/raw"), IngestionState(f"{root}/state.json"), config)
        for t in TABLES if args.table == "all" else [args.table]:
            print(json.dumps(ingestor.run(t, end=args.end, full_refresh=args.full_refresh, replace=args.replace, dry_run=args.dry_run).__dict__, default=str))
        return 0
    if args.command == "build":
        for t in LAKE if args.table == "all" else [args.table]:
            build_table(store, t, config)
            print(json.dumps({"table": t}))
        return 0
    if args.command == "validate":
        tables = {t: df for t in LAKE if (df := store.read_optional(t)) is not None}
        result = validate(tables, config)
        for t, df in tables.items():
            if "year" in df.columns:
                result.issues += schema_consistency(store.partition_columns(t), t)
        print(report(result))
        return int(result.failed)
    e = x.Experiment(args.name, root, args.as_of)
    if args.stage == "init":
        e.start()
    elif args.stage == "build-factors":
        x.build_factors(e, store, args.factors, dry_run=args.dry_run)
    elif args.stage == "build-labels":
        x.build_labels(e, store, args.labels, dry_run=args.dry_run)
    elif args.stage == "build-evaluation":
        x.build_evaluation(e, store, args.factors, args.labels, quantiles=args.quantiles, periods=args.periods, dry_run=args.dry_run)
    else:
        x.build_report(e, store, dry_run=args.dry_run)
    return 0
