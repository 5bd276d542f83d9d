"""Rolling sums and medians over a security's bars, without a task that holds all of a security."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import in_stretches


def rolling_amounts(prices: DataFrame, *, window: int = 20, size: int = 1 << 16) -> DataFrame:
    """ts_code, trade_date, amount_sum, amount_median, valid_rows of the last `window` bars, missing amounts left out (sum and median are NULL without any).

    Sums and counts are windows over stretches. Medians come from pandas' rolling median, which keeps the window sorted while it moves, instead of sorting it for each row.
    """
    bars = in_stretches(prices.select("ts_code", "trade_date", "amount"), ["ts_code"], ["trade_date"], halo=window - 1, size=size)
    by = Window.partitionBy("ts_code", "stretch").orderBy("row_number").rowsBetween(1 - window, 0)
    summed = bars.withColumns({"amount_sum": F.sum("amount").over(by), "valid_rows": F.count("amount").over(by)})

    def medians(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_number")
        found = part["amount"].rolling(window, min_periods=1).median()
        return part.assign(amount_median=found)[["ts_code", "trade_date", "amount_sum", "amount_median", "valid_rows", "own"]]

    schema = "ts_code string, trade_date date, amount_sum double, amount_median double, valid_rows long, own boolean"
    done = summed.groupBy("ts_code", "stretch").applyInPandas(medians, schema).where("own").drop("own")
    # pandas has no NULL among numbers
    return done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("amount_sum", "amount_median")})
