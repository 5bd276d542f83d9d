"""Experiments: their names, folders and manifests, and the stages that fill them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from ..plans.evaluation import EvaluationSettings, evaluate
from ..plans.factors import FACTORS, factor_panel, snapshot_columns
from ..plans.labels import LABELS, label_panel
from ..sources.state import read_json, write_json
from ..sources.store import Store
from .report import render, svg_charts

STAGES = ("factors", "labels", "evaluation", "report")
_DATE = re.compile(r"(\d{4})-?(\d{2})-?(\d{2})")


def slugify(text: str) -> str:
    slug = re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")
    if not slug:
        raise ValueError(f"no letters or digits in {text!r}")
    return slug


@dataclass(frozen=True)
class Experiment:
    """as_of names the experiment; it doesn't cut the data."""

    name: str
    root: str
    as_of: str | None = None

    def __post_init__(self) -> None:
        slugify(self.name)
        if self.as_of is not None and not _DATE.fullmatch(self.as_of):
            raise ValueError(f"{self.as_of!r} isn't a date")

    @property
    def slug(self) -> str:
        day = "".join(_DATE.fullmatch(self.as_of).groups()) if self.as_of else ""
        return f"{day}__{slugify(self.name)}" if day else slugify(self.name)

    @property
    def folder(self) -> Path:
        return Path(self.root) / "experiments" / self.slug

    def panel(self, name: str) -> str:
        return f"panel/{self.slug}/{name}"

    def start(self) -> None:
        for d in ("evaluation", "reports", "manifests"):
            (self.folder / d).mkdir(parents=True, exist_ok=True)
        self.manifest("experiment", {"name": self.name, "as_of": self.as_of, "slug": self.slug, "stages": list(STAGES)})

    def manifest(self, stage: str, payload: dict | None = None) -> dict:
        path = self.folder / "manifests" / f"{stage}.json"
        if payload is not None:
            write_json(path, payload)
        return read_json(path)

    def required(self, stage: str) -> dict:
        found = self.manifest(stage)
        if not found:
            raise FileNotFoundError(self.folder / "manifests" / f"{stage}.json")
        return found


def build_factors(e: Experiment, store: Store, names: Sequence[str] | None = None, *, dry_run: bool = False, **options) -> dict:
    specs = FACTORS.list(names=names)
    e.start()
    snapshot = snapshot_columns(store.read("monthly_snapshot_base"), specs)
    prices = store.read("adjusted_price_panel") if any(s.kind == "daily_risk" for s in specs) else None
    manifest = {"factors": [s.name for s in specs], "fields": [s.field for s in specs], "table": e.panel("factor_panel"), "dry_run": dry_run}
    if not dry_run:
        store.replace_by_month(factor_panel(snapshot, prices, specs, **options), e.panel("factor_panel"), date="rebalance_date", keys=["rebalance_date", "ts_code"])
    return e.manifest("factors", manifest)


def build_labels(e: Experiment, store: Store, names: Sequence[str] | None = None, *, dry_run: bool = False) -> dict:
    specs = LABELS.list(names)
    e.start()
    manifest = {"labels": [s.name for s in specs], "fields": [s.field for s in specs], "table": e.panel("label_panel"), "dry_run": dry_run}
    if not dry_run:
        panel = label_panel(store.read("monthly_universe"), store.read("adjusted_price_panel", ["ts_code", "trade_date", "adj_close"]), specs)
        store.replace_by_month(panel, e.panel("label_panel"), date="rebalance_date", keys=["rebalance_date", "ts_code"])
    return e.manifest("labels", manifest)


def build_evaluation(e: Experiment, store: Store, factors: Sequence[str] | None = None, labels: Sequence[str] | None = None, *, quantiles: int = 5, periods: int = 3, dry_run: bool = False) -> dict:
    """Factors and labels default to those of the earlier stages' manifests."""
    fields = [f"factor_{n}" for n in factors] if factors else e.required("factors")["fields"]
    targets = [f"label_{n}" for n in labels] if labels else e.required("labels")["fields"]
    s = EvaluationSettings(fields, targets, quantiles, periods)
    panel = store.read(e.panel("factor_panel"), ["rebalance_date", "ts_code", "is_eligible", *fields])
    written: set[str] = set()

    def keep(name: str, df: DataFrame) -> DataFrame:
        """Tables that others are made from are written at once and read back."""
        if dry_run:
            return df
        store.overwrite(df, f"experiments/{e.slug}/evaluation/{name}")
        written.add(name)
        return store.read(f"experiments/{e.slug}/evaluation/{name}")

    tables = evaluate(panel, store.read(e.panel("label_panel"), ["rebalance_date", "ts_code", *targets]), s, keep)
    for name, df in tables.items():
        if name not in written:
            keep(name, df)
    return e.manifest("evaluation", {"factors": fields, "labels": targets, "quantiles": quantiles, "periods": periods, "tables": sorted(tables), "dry_run": dry_run})


def build_report(e: Experiment, store: Store, *, dry_run: bool = False) -> dict:
    """report.md and its charts, from the evaluation's summaries (small tables)."""
    made = e.required("evaluation")
    tables = {t: store.read(f"experiments/{e.slug}/evaluation/{t}") for t in made["tables"]}
    charts = svg_charts(tables)
    text = render(tables, title=e.name, factors=made["factors"], labels=made["labels"], charts=sorted(charts))
    if not dry_run:
        (e.folder / "reports" / "report.md").write_text(text)
        for name, svg in charts.items():
            (e.folder / "reports" / f"{name}.svg").write_text(svg)
    return e.manifest("report", {"charts": sorted(charts), "characters": len(text), "dry_run": dry_run})
