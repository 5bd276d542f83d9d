"""A vendor's endpoints as a Spark data source: tasks make the requests, each with retries, and give rows."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..config import Config
from ..functions.scalars import parsed_date
from ..plans.lake import BASIC, PRICES, UniverseRules
from .store import Store

#: What one request of a table asks for: all, a listing status, an open day, a security over a range of days, or a calendar day.
ASKED_BY = {"trade_cal": "all", "stock_basic": "list_status", **dict.fromkeys(("daily", "daily_basic", "adj_factor"), "trade_date"), **dict.fromkeys(("fina_indicator", "income", "balancesheet", "cashflow"), "ts_code"), **dict.fromkeys(("forecast", "express"), "ann_date")}
#: Listed, delisted, paused.
STATUSES = ("L", "D", "P")


def _fields(texts: Sequence[str], numbers: Sequence[str]) -> str:
    return ", ".join([*(f"{c} string" for c in texts), *(f"{c} double" for c in numbers)])


_FILED = ("ts_code", "ann_date", "f_ann_date", "end_date", "update_flag")
#: The columns that the plans read; a source may be given others.
SCHEMAS = {
    "trade_cal": _fields(("exchange", "cal_date", "pretrade_date"), ("is_open",)),
    "stock_basic": _fields(("ts_code", "name", "industry", "market", "exchange", "list_status", "list_date", "delist_date"), ()),
    "daily": _fields(("ts_code", "trade_date"), (*PRICES, "pre_close", "change", "pct_chg", "vol", "amount")),
    "daily_basic": _fields(("ts_code", "trade_date"), BASIC),
    "adj_factor": _fields(("ts_code", "trade_date"), ("adj_factor",)),
    "fina_indicator": _fields(("ts_code", "ann_date", "end_date", "update_flag"), ("roe", "roa", "gross_margin")),
    "income": _fields(_FILED, ("revenue", "oper_cost", "n_income_attr_p")),
    "balancesheet": _fields(_FILED, ("total_assets", "total_liab", "money_cap", "inventories")),
    "cashflow": _fields(_FILED, ("n_cashflow_act",)),
    "forecast": _fields(("ts_code", "ann_date", "first_ann_date", "end_date"), ("net_profit_min",)),
    "express": _fields(("ts_code", "ann_date", "end_date"), ("revenue",)),
}
#: call(endpoint, **parameters) gives rows as mappings; columns that a row lacks are NULL. It runs in tasks.
Call = Callable[..., Iterable[Mapping]]


@dataclass
class _Requests(InputPartition):
    asked: list[dict]


class _Pace:
    """How requests are made: in tasks, each tried a few times, with a wait after each.

    With `lanes` there are that many tasks at most and each waits so many times as long, so that all of them together ask no faster than one would, however many cores there are.
    """

    def __init__(self, call: Call, table: str, per_task: int, attempts: int, wait: float, lanes: int | None) -> None:
        self.call, self.table, self.per_task, self.attempts, self.lanes = call, table, per_task, attempts, lanes
        self.wait = wait * (lanes or 1)

    def dealt(self, asked: list[dict]) -> list[InputPartition]:
        if self.lanes:
            parts = [asked[k :: self.lanes] for k in range(min(self.lanes, len(asked)))]
        else:
            parts = [asked[at : at + self.per_task] for at in range(0, len(asked), self.per_task)]
        return [_Requests(p) for p in parts] or [_Requests([])]

    def rows(self, asked: list[dict], columns: Sequence[str]) -> Iterator[tuple]:
        for parameters in asked:
            for attempt in range(1, self.attempts + 1):
                try:
                    found = list(self.call(self.table, **parameters))
                    break
                except Exception as e:
                    if attempt == self.attempts:
                        raise RuntimeError(f"{self.table} {parameters} failed {self.attempts} times") from e
                    time.sleep(self.wait * attempt)
            for r in found:
                yield tuple(r.get(c) for c in columns)
            time.sleep(self.wait)  # the vendor's pace


def _format(name: str, schema: str, pace: _Pace, asked: list[dict]) -> type[DataSource]:
    class Reader(DataSourceReader):
        def __init__(self, columns: Sequence[str]) -> None:
            self.columns = list(columns)

        def partitions(self) -> list[InputPartition]:
            return pace.dealt(asked)

        def read(self, partition: _Requests) -> Iterator[tuple]:
            return pace.rows(partition.asked, self.columns)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(schema.names)

    return Source


def _stream_format(name: str, schema: str, pace: _Pace, start: str, end: str | None) -> type[DataSource]:
    class Reader(DataSourceStreamReader):
        """Offsets are open days: all up to and with that one have been asked for. They are kept in the query's checkpoint, so each day is asked for once."""

        def __init__(self, columns: Sequence[str]) -> None:
            self.columns = list(columns)

        def _open_days(self, after: str, last: str) -> list[str]:
            columns = ("cal_date", "is_open")
            calendar = _Pace(pace.call, "trade_cal", 1, pace.attempts, 0.0, None).rows([{"exchange": "", "start_date": start, "end_date": last}], columns)
            return sorted({day for day, is_open in calendar if day and is_open is not None and int(is_open) == 1 and after < day <= last and day >= start})

        def initialOffset(self) -> dict:
            return {"day": ""}

        def latestOffset(self) -> dict:
            return {"day": max(self._open_days("", end or date.today().strftime("%Y%m%d")), default="")}

        def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
            return pace.dealt([{"trade_date": d} for d in self._open_days(start["day"], end["day"])])

        def read(self, partition: _Requests) -> Iterator[tuple]:
            return pace.rows(partition.asked, self.columns)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return Reader(schema.names)

    return Source


class VendorSource:
    """A market source that asks a vendor request by request. Open days and securities come from what `store` has ingested already."""

    def __init__(self, spark: SparkSession, call: Call, store: Store, config: Config = Config(), *, schemas: Mapping[str, str] = SCHEMAS, markets: Sequence[str] = UniverseRules.markets, suffixes: Sequence[str] = UniverseRules.suffixes, per_task: int = 50, attempts: int = 3, wait: float = 0.3, lanes: int | None = None) -> None:
        if attempts < 1:
            raise ValueError("at least one attempt")
        self.spark, self.call, self.store, self.config, self.schemas = spark, call, store, config, schemas
        self.markets, self.suffixes = markets, suffixes
        self.per_task, self.attempts, self.wait, self.lanes = per_task, attempts, wait, lanes

    def _pace(self, table: str) -> _Pace:
        return _Pace(self.call, table, self.per_task, self.attempts, self.wait, self.lanes)

    def requests(self, table: str, start: str | None, end: str | None) -> list[dict]:
        """The parameters of each request; there are as many as days or securities."""
        end = end or date.today().strftime("%Y%m%d")
        start = start or (self.config.calendar_start if table == "trade_cal" else self.config.history_start)
        by = ASKED_BY[table]
        if by == "all":
            return [{"exchange": "", "start_date": start, "end_date": end}]
        if by == "list_status":
            return [{"list_status": s} for s in STATUSES]
        if by == "trade_date":
            day = parsed_date(F.col("cal_date"))
            bounds = [F.to_date(F.lit(x), "yyyyMMdd") for x in (start, end)]
            days = self.store.read("trade_cal").where((F.col("is_open").cast("int") == 1) & day.between(*bounds)).select(F.date_format(day, "yyyyMMdd").alias("d")).distinct().orderBy("d")
            return [{"trade_date": r.d} for r in days.collect()]
        if by == "ts_code":
            common = F.col("market").isin(*self.markets) & F.array_contains(F.array(*map(F.lit, self.suffixes)), F.regexp_extract("ts_code", r"(\.[^.]*)$", 1))
            codes = self.store.read("stock_basic").where(common).select("ts_code").distinct().orderBy("ts_code")
            return [{"ts_code": r.ts_code, "start_date": start, "end_date": end} for r in codes.collect()]
        first, last = (datetime.strptime(x, "%Y%m%d").date() for x in (start, end))
        return [{"ann_date": (first + timedelta(days=k)).strftime("%Y%m%d")} for k in range((last - first).days + 1)]

    def fetch(self, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
        name = f"market_{table}_{uuid.uuid4().hex}"
        self.spark.dataSource.register(_format(name, self.schemas[table], self._pace(table), self.requests(table, start, end)))
        return self.spark.read.format(name).load()

    def stream(self, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """The rows of a table that is asked for by open day, as a stream. The vendor's own calendar says which days were open. A query on it
        keeps in its checkpoint how far it has come, and needs no other state."""
        if ASKED_BY[table] != "trade_date":
            raise ValueError(f"{table} isn't asked for by open day")
        name = f"market_stream_{table}"  # a query that is started again looks for the same name
        self.spark.dataSource.register(_stream_format(name, self.schemas[table], self._pace(table), start or self.config.history_start, end))
        return self.spark.readStream.format(name).load()
