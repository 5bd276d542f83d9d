"""Where raw market tables come from: a protocol, a file-backed source and one that retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parsed_date

#: Raw tables with their date column and key; the first two are replaced as a whole.
TABLES = {
    "trade_cal": (None, ("exchange", "cal_date")),
    "stock_basic": (None, ("ts_code",)),
    "daily": ("trade_date", ("ts_code", "trade_date")),
    "daily_basic": ("trade_date", ("ts_code", "trade_date")),
    "adj_factor": ("trade_date", ("ts_code", "trade_date")),
    "fina_indicator": ("ann_date", ("ts_code", "ann_date", "end_date")),
    "income": ("ann_date", ("ts_code", "ann_date", "end_date")),
    "balancesheet": ("ann_date", ("ts_code", "ann_date", "end_date")),
    "cashflow": ("ann_date", ("ts_code", "ann_date", "end_date")),
    "forecast": ("ann_date", ("ts_code", "ann_date", "end_date")),
    "express": ("ann_date", ("ts_code", "ann_date", "end_date")),
}


class MarketSource(Protocol):
    def fetch(self, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows whose date lies from start to end (yyyyMMdd, both included; None: no bound)."""
        ...


class FrameSource:
    """Serves tables that are there already, such as files."""

    def __init__(self, tables: Mapping[str, DataFrame]) -> None:
        self.tables = tables

    def fetch(self, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
        df = self.tables[table]
        date = TABLES[table][0]
        if date is None:
            return df
        day = parsed_date(F.col(date))
        if start is not None:
            df = df.where(day >= F.to_date(F.lit(start), "yyyyMMdd"))
        if end is not None:
            df = df.where(day <= F.to_date(F.lit(end), "yyyyMMdd"))
        return df


class Retrying:
    """Asks another source up to `attempts` times, waiting longer each time."""

    def __init__(self, source: MarketSource, attempts: int = 3, wait: float = 0.3, sleep: Callable[[float], None] = time.sleep) -> None:
        self.source, self.attempts, self.wait, self._sleep = source, attempts, wait, sleep

    def fetch(self, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.source.fetch(table, start, end)
            except Exception:
                if attempt == self.attempts:
                    raise
                self._sleep(self.wait * attempt)
        raise ValueError("at least one attempt")
