"""Incremental ingestion: start where the last run ended, less a look-back, and merge by key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import parsed_date, with_dates
from ..sources.market import TABLES, MarketSource
from ..sources.state import IngestionState
from ..sources.store import Store, merge_by_key

_DATES = ("trade_date", "cal_date", "pretrade_date", "list_date", "delist_date", "ann_date", "f_ann_date", "first_ann_date", "end_date")
#: The order of a pull's rows.
_ORDER = "__pulled_at"
_STATEMENTS = ("fina_indicator", "income", "balancesheet", "cashflow", "forecast", "express")


def open_days(calendar: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    day = parsed_date(F.col("cal_date"))
    out = calendar.where("is_open = 1").select(day.alias("trade_date")).where("trade_date is not null").distinct()
    if start:
        out = out.where(F.col("trade_date") >= F.lit(start))
    return out.where(F.col("trade_date") <= F.lit(end)) if end else out


def trade_date_start(calendar: DataFrame, last: date | None, lookback: int, history_start: date) -> date:
    """The lookback-th open day before the last ingested one, looked for among the max(4 * lookback, 30) days before it; the last ingested one if no day of these was open."""
    if last is None:
        return history_start
    before = open_days(calendar, last - timedelta(days=max(4 * lookback, 30)), last).orderBy(F.desc("trade_date")).limit(lookback + 1).collect()
    return min((r.trade_date for r in before), default=last)


def announcement_start(last: date | None, lookback_days: int, history_start: date) -> date:
    return history_start if last is None else last - timedelta(days=max(lookback_days, 30))


@dataclass(frozen=True)
class IngestResult:
    table: str
    start: str | None
    rows: int
    months: Sequence[tuple[int, int]]
    dry_run: bool


class Ingestor:
    def __init__(self, spark: SparkSession, source: MarketSource, store: Store, state: IngestionState, config: Config = Config()) -> None:
        self.spark, self.source, self.store, self.state, self.config = spark, source, store, state, config

    def _history(self) -> date:
        return datetime.strptime(self.config.history_start, "%Y%m%d").date()

    def start_of(self, table: str, full_refresh: bool = False) -> date | None:
        column = TABLES[table][0]
        if column is None:
            return None
        seen = self.state.get(table).get(f"last_success_{column}")
        last = None if full_refresh or not seen else date.fromisoformat(seen)
        if table in _STATEMENTS:
            return announcement_start(last, self.config.statement_lookback_days, self._history())
        lookback = self.config.adjust_lookback if table == "adj_factor" else self.config.daily_lookback
        return trade_date_start(self.store.read("trade_cal"), last, lookback, self._history())

    def run(self, table: str, *, end: str | None = None, full_refresh: bool = False, replace: bool = False, dry_run: bool = False) -> IngestResult:
        """An empty pull keeps the watermark. replace: the table is rewritten instead of merged.

        The source is asked once: what it gives is landed as Parquet, with the order of its rows. Of rows with equal keys the last counts.
        """
        column, keys = TABLES[table]
        start = self.start_of(table, full_refresh)
        pulled = with_dates(self.source.fetch(table, start and start.strftime("%Y%m%d"), end), *_DATES)
        if dry_run:
            return IngestResult(table, start and start.isoformat(), pulled.count(), [], True)
        landing = f"landing/{uuid.uuid4().hex}"
        self.store.overwrite(pulled.withColumn(_ORDER, F.monotonically_increasing_id()), landing)
        try:
            return self._merge(table, self.store.read(landing), start, replace)
        finally:
            self.store.clear(landing)

    def _merge(self, table: str, landed: DataFrame, start: date | None, replace: bool) -> IngestResult:
        column, keys = TABLES[table]
        if column is None:
            self.store.overwrite(merge_by_key(None, landed, keys, [_ORDER]).drop(_ORDER), table)
            rows = self.store.read(table).count()
            self.state.mark_success(table, rows=rows, mode="overwrite")
            return IngestResult(table, None, rows, [], False)
        size = landed.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("rows"), F.max(column).alias("last")).first()
        latest = merge_by_key(None, landed.where(F.col(column).isNotNull()), keys, [_ORDER]).drop(_ORDER)
        months: Sequence[tuple[int, int]] = []
        if replace:
            self.store.replace_by_month(latest, table, date=column, keys=keys)
        elif size.rows:
            months = self.store.upsert_by_month(latest, table, date=column, keys=keys)
        before = self.state.get(table).get(f"last_success_{column}")
        self.state.mark_success(table, rows=size.rows, months=[list(m) for m in months], mode="replace" if replace else "upsert", **{f"last_success_{column}": size.last.isoformat() if size.last else before})
        return IngestResult(table, start and start.isoformat(), size.rows, months, False)

    def run_all(self, tables: Sequence[str] = tuple(TABLES), **options) -> list[IngestResult]:
        return [self.run(t, **options) for t in tables]


def stream_into(stream: DataFrame, store: Store, table: str, *, date: str, keys: Sequence[str], checkpoint: str):
    """A Structured Streaming query that merges each micro-batch by key; started by the caller through the returned writer.

    A batch is landed first, so that its source is read once, however often the merge reads it. The merge is idempotent, so that a batch that is replayed after a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        landing = f"landing/{table}-{number}"
        store.overwrite(batch, landing)
        try:
            store.upsert_by_month(store.read(landing), table, date=date, keys=keys)
        finally:
            store.clear(landing)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
