"""Forward-return labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_divide
from .catalogue import Catalogue, require_name
from .lake import check_schedule, schedule

@dataclass(frozen=True)
class LabelSpec:
    name: str
    months: int
    description: str
    stage: str = "v1"
    anchor: str = "trade_execution_date"
    window_rule: str = "require_full_window"

    def __post_init__(self) -> None:
        require_name(self)
        if self.months < 1:
            raise ValueError("a label looks at least one month ahead")
        if self.anchor != "trade_execution_date" or self.window_rule != "require_full_window":
            raise ValueError("only full windows from the execution date are supported")

    @property
    def field(self) -> str:
        return f"label_{self.name}"


class LabelRegistry(Catalogue[LabelSpec]):
    """By stage, horizon and name."""

    kind = "label"

    def __init__(self, specs: Iterable[LabelSpec] = ()) -> None:
        super().__init__(specs, order=lambda s: (s.stage, s.months, s.name))

    def list(self, names: Sequence[str] | None = None, *, stage: str | None = None) -> list[LabelSpec]:
        return [s for s in super().list(names) if stage in (None, s.stage)]

    def stages(self) -> list[str]:
        return self.groups("stage")


LABELS = LabelRegistry(LabelSpec(f"fwd_ret_{k}m", k, f"Return from the execution date to the one {k} rebalance dates later") for k in (1, 3, 6))


def label_panel(universe: DataFrame, prices: DataFrame, specs: Sequence[LabelSpec] | None = None, *, check: bool = True) -> DataFrame:
    """Base columns, the start (adjusted price on the execution date), then for each label its end date, end price and return.

    A label's end is the execution date k rebalance dates later; the return is NULL if either price is missing or the first is zero. Of
    several prices of a security and a day the last one as read counts. ValueError if a rebalance date has two execution dates (check: an action).

    Only bars on execution dates matter; they become one map of prices by date for each security, so that the universe is joined once.
    """
    specs = LABELS.list() if specs is None else list(specs)
    keys = ["rebalance_date", "trade_execution_date"]
    months = schedule(universe)
    if check:
        check_schedule(months)
    by_date = Window.orderBy("rebalance_date")  # one row for each month
    dates = months.select(*keys, *(F.lead("trade_execution_date", s.months).over(by_date).alias(f"{s.field}_end_date") for s in specs))
    days = F.broadcast(months.select(F.col("trade_execution_date").alias("trade_date")))
    bars = prices.select("ts_code", "trade_date", "adj_close").withColumn("__at", F.monotonically_increasing_id()).join(days, "trade_date", "left_semi")
    by_day = bars.groupBy("ts_code", "trade_date").agg(F.max_by("adj_close", "__at").alias("adj_close"))
    maps = by_day.groupBy("ts_code").agg(F.map_from_entries(F.collect_list(F.struct("trade_date", "adj_close"))).alias("__prices"))
    base = ["rebalance_date", "trade_execution_date", "ts_code", "is_eligible", "exclude_reason", "year", "month"]
    out = universe.select(*base).join(F.broadcast(dates), keys, "left").join(maps, "ts_code", "left")
    at = lambda day: F.try_element_at("__prices", F.col(day))
    out = out.withColumns({"label_start_adj_close": at("trade_execution_date"), **{f"{s.field}_end_adj_close": at(f"{s.field}_end_date") for s in specs}})
    values = [c for s in specs for c in (F.col(f"{s.field}_end_date"), F.col(f"{s.field}_end_adj_close"), (safe_divide(F.col(f"{s.field}_end_adj_close"), F.col("label_start_adj_close")) - 1).alias(s.field))]
    return out.select("rebalance_date", "trade_execution_date", "ts_code", "is_eligible", "exclude_reason", F.col("trade_execution_date").alias("label_start_date"), "label_start_adj_close", *values, "year", "month")
