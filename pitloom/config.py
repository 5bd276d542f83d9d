"""Settings of a research run; each can come from an environment variable PIT_<NAME>."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    root: str = "data"
    token: str = ""
    history_start: str = "20150101"
    calendar_start: str = "19900101"
    daily_lookback: int = 20
    adjust_lookback: int = 60
    statement_lookback_days: int = 120
    ipo_min_trade_days: int = 120
    liquidity_window: int = 20
    min_valid_trade_days: int = 15
    min_median_amount: float = 20000.0
    market_coverage_warn: float = 0.75
    market_coverage_error: float = 0.60
    financial_coverage_warn: float = 0.75
    financial_coverage_error: float = 0.60
    event_coverage_warn: float = 0.50
    event_coverage_error: float = 0.30

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, file: str | Path = ".env") -> Config:
        """From variables PIT_<FIELD>; lines NAME=value of the file (if there is one) count where a variable isn't set."""
        env = os.environ if env is None else env
        lines = [x.strip() for x in Path(file).read_text().splitlines()] if Path(file).is_file() else []
        told = {k.strip(): v.strip().strip("\"'") for k, v in (x.split("=", 1) for x in lines if "=" in x and not x.startswith("#"))}
        told |= env
        return cls(**{f.name: type(f.default)(told[key]) for f in fields(cls) if (key := f"PIT_{f.name.upper()}") in told})
