"""Streams with state: late rows, restarts, and a vendor that is asked for each day once."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from pitloom.config import Config
from pitloom.sources.store import Store
from pitloom.sources.vendor import VendorSource
from pitloom.streaming.ingest import stream_into
from pitloom.streaming.late import append_available, closed_windows

SCHEMA = "id long, at timestamp, kind string, x int"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.UTC)


def test_late_rows_inside_and_outside_the_delay(spark, tmp_path):
    """The query ends after each delivery and is started again from its checkpoint."""
    deliveries = [
        [(1, at(1), "a", 1), (2, at(2), "a", 10), (3, at(3, 5), "b", 5), (None, None, "a", 7)],
        [(4, at(6), "a", 3), (2, at(2), "a", 10), (5, at(1, 1), "a", 100)],  # 2 comes again, 5 within two days and a bit
        [(6, at(1, 2), "a", 1000), (7, at(5), "b", 8), (8, at(12), "a", 1)],  # 6 is too late, 7 isn't
        [(9, at(12, 1), "b", 4), (7, at(5), "b", 8)],
    ]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    seen = []
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        append_available(closed_windows(stream, time="at", id_col="id", delay="3 days", window="1 day", keys=["kind"], aggregates=[F.sum("x").alias("x"), F.count(F.lit(1)).alias("n")]), out, checkpoint, timeout=120)
        seen.append({(r.window_start.day, r.kind): (r.x, r.n) for r in spark.read.parquet(out).collect()})
    assert seen[0] == {}  # the 3rd less three days closes nothing
    assert seen[1] == {(1, "a"): (101, 2), (2, "a"): (10, 1)}
    assert seen[2] == {**seen[1], (3, "b"): (5, 1), (5, "b"): (8, 1), (6, "a"): (3, 1)}
    assert seen[3] == seen[2]


def vendor(folder, last):
    """Gives three rows for a day and notes each request as a file; the calendar ends on `last`, the 4th is closed."""
    folder = str(folder)

    def call(endpoint, **asked):
        import pathlib
        import time

        if endpoint == "trade_cal":
            days = [f"202401{k:02d}" for k in range(1, last + 1)]
            return [{"cal_date": day, "is_open": float(day[-2:] != "04")} for day in days if asked["start_date"] <= day <= asked["end_date"]]
        (pathlib.Path(folder) / f"{asked['trade_date']}-{time.time_ns()}").write_text("")
        return [{"ts_code": c, "trade_date": asked["trade_date"], "close": float(asked["trade_date"][-2:])} for c in "ABC"]

    return call


def test_each_open_day_is_asked_for_once(spark, tmp_path):
    """Over restarts, with a calendar that grows, and with a batch whose sink fails after it was read."""
    asked = tmp_path / "asked"
    asked.mkdir()
    store = Store(spark, str(tmp_path / "raw"))
    days = lambda: sorted(p.name[:8] for p in asked.iterdir())

    def run(last, sink=None):
        source = VendorSource(spark, vendor(asked, last), store, Config(history_start="20240102"), wait=0.0, lanes=2)
        stream = source.stream("daily", end="20240131").withColumn("trade_date", F.to_date("trade_date", "yyyyMMdd"))
        writer = stream_into(stream, store, "daily", date="trade_date", keys=["ts_code", "trade_date"], checkpoint=str(tmp_path / "checkpoint")) if sink is None else stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(sink)
        writer.trigger(availableNow=True).start().awaitTermination(120)

    run(5)
    assert days() == ["20240102", "20240103", "20240105"]
    run(5)
    assert len(days()) == 3
    run(7)
    assert days()[3:] == ["20240106", "20240107"]

    def fails(batch, _):
        raise RuntimeError("the sink is down")

    with pytest.raises(Exception, match="sink is down"):
        run(8, fails)
    run(8)
    table = store.read("daily", ["ts_code", "trade_date", "close"]).collect()
    assert len(table) == 6 * 3 == len({(r.ts_code, r.trade_date) for r in table}) and all(r.close == r.trade_date.day for r in table)
    with pytest.raises(ValueError, match="open day"):
        VendorSource(spark, vendor(asked, 5), store).stream("income")


def test_lanes_keep_one_pace(spark, tmp_path):
    """Three tasks with a wait of 0.1 s for each request of all: twelve requests take over a second, whatever the cores."""
    from pitloom.sources.vendor import _Pace

    pace = _Pace(vendor(tmp_path, 31), "daily", 50, 3, 0.1, 3)
    parts = pace.dealt([{"trade_date": f"202401{k:02d}"} for k in range(1, 13)])
    assert [len(p.asked) for p in parts] == [4, 4, 4] and pace.wait == pytest.approx(0.3)
    began = time.monotonic()
    assert len(list(pace.rows(parts[0].asked[:2], ["ts_code"]))) == 6
    assert time.monotonic() - began >= 0.6
    assert len(pace.dealt([])) == 1 and len(pace.dealt([{"trade_date": "x"}])) == 1
