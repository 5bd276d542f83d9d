"""Windows over event time that wait for late rows, as Structured Streaming with state.

A row may arrive as late as the look-back allows. Repeated deliveries are recognised by their id for as long; a window is given out once, when nothing that may still come belongs to it.
What comes later than that is left out. State and progress live in the checkpoint: a query that is started again goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_windows(stream: DataFrame, *, time: str, id_col: str, delay: str, window: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """window_start, keys and aggregates of each window that is closed. stream: a streaming DataFrame. Rows whose time isn't after the watermark (the latest time of the batches before,
    less `delay`) are late; rows without a time are left out."""
    once = stream.where(F.col(time).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([id_col])
    found = once.groupBy(F.window(time, window).alias("window"), *keys).agg(*aggregates)
    return found.select(F.col("window.start").alias("window_start"), *(c for c in found.columns if c != "window"))


def append_available(windows: DataFrame, path: str, checkpoint: str, *, timeout: int | None = None) -> None:
    """Takes in what is there now, in the order in which it came, and appends the windows that this closes to the Parquet table at `path`, each once whatever fails in between."""
    running = windows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    running.awaitTermination(timeout)
