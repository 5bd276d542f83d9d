"""The research report: leaderboards by top-k queries, Markdown, and charts as SVG."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.factors import FACTORS
from ..plans.labels import LABELS

#: name: table, what to sort by (- for descending), columns.
BOARDS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "top_ic": ("rank_ic_summary", ("-ic_mean", "factor_name", "label_name"), ("factor_name", "label_name", "ic_mean", "icir", "ic_hit_rate")),
    "bottom_ic": ("rank_ic_summary", ("ic_mean", "factor_name", "label_name"), ("factor_name", "label_name", "ic_mean", "icir", "ic_hit_rate")),
    "top_spread": ("top_bottom_spread_summary", ("-spread_mean", "factor_name", "label_name"), ("factor_name", "label_name", "spread_mean", "spread_ir")),
    "top_t_stat": ("fama_macbeth_summary", ("-t_stat", "term", "label_name"), ("term", "label_name", "mean_coefficient", "t_stat")),
    "top_correlation": ("factor_correlation_summary", ("-mean_abs_corr", "factor_a", "factor_b"), ("factor_a", "factor_b", "mean_corr", "mean_abs_corr")),
    "top_redundancy": ("redundancy_summary", ("-mean_r2", "factor_name", "label_name"), ("factor_name", "label_name", "mean_r2", "residual_ic_retention")),
    "top_robustness": ("robustness_summary", ("-ic_sign_consistency", "-spread_sign_consistency", "factor_name", "label_name"), ("factor_name", "label_name", "ic_sign_consistency", "spread_sign_consistency", "ic_mean")),
    "weakest_robustness": ("robustness_summary", ("ic_sign_consistency", "factor_name", "label_name"), ("factor_name", "label_name", "ic_sign_consistency", "spread_sign_consistency", "ic_mean")),
    "top_subperiods": ("subperiod_summary", ("-ic_mean", "-spread_mean", "period", "factor_name", "label_name"), ("period", "factor_name", "label_name", "ic_mean", "spread_mean")),
}


def leaderboard(table: DataFrame, name: str, k: int = 5) -> DataFrame:
    """The first k rows; missing values come last, names settle ties (of numbers equal to 12 digits)."""
    _, order, columns = BOARDS[name]
    if name == "top_t_stat":
        table = table.where("term <> 'intercept'")
    if name == "top_correlation":
        table = table.where("factor_a <> factor_b")
    value = lambda c: F.round(c, 12) if table.schema[c].dataType.typeName() == "double" else F.col(c)
    return table.orderBy(*(F.desc_nulls_last(value(c[1:])) if c[0] == "-" else F.asc_nulls_last(value(c)) for c in order)).limit(k).select(*columns)


def _cell(x) -> str:
    if x is None or x != x:
        return "NA"
    return f"{x:.4f}" if isinstance(x, float) else str(x)


def markdown_table(rows: Sequence, columns: Sequence[str]) -> list[str]:
    return [f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}", *(f"| {' | '.join(_cell(r[c]) for c in columns)} |" for r in rows)] if rows else ["No rows."]


def render(tables: Mapping[str, DataFrame], *, title: str, factors: Sequence[str], labels: Sequence[str], k: int = 5, charts: Sequence[str] = ()) -> str:
    lines = [f"# {title}", "", f"{len(factors)} factors, {len(labels)} labels.", "", *_summary(tables), *_sizes(tables), *_method(factors, labels)]
    for name, (table, _, columns) in BOARDS.items():
        if table in tables:
            lines += [f"## {name.replace('_', ' ').capitalize()}", "", *markdown_table(leaderboard(tables[table], name, 6 if name == "top_subperiods" else k).collect(), columns), ""]
    if "robustness_periods" in tables:
        periods = tables["robustness_periods"].orderBy("period").collect()
        lines += ["## Periods", "", *markdown_table(periods, ("period", "start_date", "end_date", "months")), ""]
    if charts:
        lines += ["## Charts", "", *(f"![{c.replace('_', ' ')}]({c}.svg)" for c in charts), ""]
    return "\n".join([*lines, *_by_factor(tables, factors)])


#: A board's first row as a sentence.
HIGHLIGHTS = {
    "top_ic": "Rank IC is highest for `{factor_name}` on `{label_name}`: mean {ic_mean}, ICIR {icir}.",
    "top_spread": "The spread between top and bottom is widest for `{factor_name}` on `{label_name}`: mean {spread_mean}, ratio {spread_ir}.",
    "top_robustness": "`{factor_name}` on `{label_name}` keeps its sign best: {ic_sign_consistency} of the periods.",
    "top_t_stat": "Of the regression's terms `{term}` on `{label_name}` has the largest t: {t_stat}.",
    "top_correlation": "`{factor_a}` and `{factor_b}` overlap most: mean absolute correlation {mean_abs_corr}.",
    "top_redundancy": "The other factors explain `{factor_name}` best: mean R² {mean_r2}.",
}


def _summary(tables: Mapping[str, DataFrame]) -> list[str]:
    lines = []
    for name, sentence in HIGHLIGHTS.items():
        if BOARDS[name][0] in tables:
            lines += [f"- {sentence.format(**{c: _cell(v) for c, v in r.asDict().items()})}" for r in leaderboard(tables[BOARDS[name][0]], name, 1).collect()]
    return ["## Summary", "", *lines, ""] if lines else []


def _sizes(tables: Mapping[str, DataFrame]) -> list[str]:
    """Rows of the summaries, which are small."""
    found = [f"- {t}: {tables[t].count()} rows" for t in sorted(tables) if t.endswith("_summary")]
    return ["## Tables", "", *found, ""] if found else []


def _method(factors: Sequence[str], labels: Sequence[str]) -> list[str]:
    known = {s.field: s for s in (*FACTORS, *LABELS)}
    steps = dict.fromkeys(", ".join(known[f].steps) for f in factors if f in known)
    told = [f"- `{n}`: {known[n].description}" for n in (*factors, *labels) if n in known]
    return ["## Method", "", "Cross-sections of eligible securities at month ends, with data as of then; labels begin on the day of execution.", "", *(f"- Steps: {s}" for s in steps), *told, ""]


def _by_factor(tables: Mapping[str, DataFrame], factors: Sequence[str]) -> list[str]:
    """A line for each factor and label, with what the evaluation and the redundancy say of it."""
    if "evaluation_summary" not in tables:
        return []
    columns = ("label_name", "ic_mean", "icir", "spread_mean", "direction", "is_monotonic")
    table = tables["evaluation_summary"]
    if "redundancy_summary" in tables:
        columns += ("mean_r2", "residual_ic_retention")
        table = table.join(tables["redundancy_summary"].select("factor_name", "label_name", "mean_r2", "residual_ic_retention"), ["factor_name", "label_name"], "left")
    rows = table.orderBy("factor_name", "label_name").collect()  # one for each factor and label
    out = ["## By factor", ""]
    for f in factors:
        mine = [r for r in rows if r.factor_name == f]
        out += [f"### {f}", "", *markdown_table(mine, columns), ""]
    return out


def bar_chart(title: str, bars: Sequence[tuple[str, float]], width: int = 640) -> str:
    high = max((abs(v) for _, v in bars), default=0) or 1
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + 24 * len(bars)}" font-family="sans-serif" font-size="12">', f'<text x="8" y="20" font-weight="bold">{escape(title)}</text>']
    zero, span = width * 0.62, width * 0.3
    for k, (name, v) in enumerate(bars):
        length, y = abs(v) / high * span, 32 + 24 * k
        out += [f'<rect x="{zero if v >= 0 else zero - length:.1f}" y="{y}" width="{length:.1f}" height="16" fill="{"#3b6ea5" if v >= 0 else "#b5533c"}"/>', f'<text x="8" y="{y + 12}">{escape(name)}: {v:.4f}</text>']
    return "\n".join([*out, "</svg>"])


def heat_map(title: str, names: Sequence[str], values: Mapping[tuple[str, str], float | None], cell: int = 22) -> str:
    n = len(names)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{220 + cell * n}" height="{40 + cell * n}" font-family="sans-serif" font-size="11">', f'<text x="8" y="20" font-weight="bold">{escape(title)}</text>']
    for i, a in enumerate(names):
        out.append(f'<text x="8" y="{46 + cell * i}">{escape(a)}</text>')
        for j, b in enumerate(names):
            v = values.get((a, b))
            shade = 255 - int(200 * min(1, abs(v))) if v is not None else 240
            fill = f"rgb({shade},{shade},255)" if v is None or v >= 0 else f"rgb(255,{shade},{shade})"
            out.append(f'<rect x="{210 + cell * j}" y="{32 + cell * i}" width="{cell}" height="{cell}" fill="{fill}"/>')
    return "\n".join([*out, "</svg>"])


def svg_charts(tables: Mapping[str, DataFrame], k: int = 10) -> dict[str, str]:
    out = {}
    for name, value, title in (("top_ic", "ic_mean", "Rank IC"), ("top_spread", "spread_mean", "Top-bottom spread"), ("top_t_stat", "t_stat", "Fama-MacBeth t"), ("top_robustness", "ic_sign_consistency", "Periods with the whole's sign")):
        table = BOARDS[name][0]
        if table in tables:
            rows = leaderboard(tables[table], name, k).collect()
            out[name] = bar_chart(title, [(f"{r[0]} / {r[1]}", r[value]) for r in rows if r[value] is not None])
    if "factor_correlation_summary" in tables:
        rows = tables["factor_correlation_summary"].collect()  # one row for each pair of factors
        values = {pair: r.mean_corr for r in rows for pair in ((r.factor_a, r.factor_b), (r.factor_b, r.factor_a))}
        out["correlation"] = heat_map("Mean correlation", sorted({a for a, _ in values}), values)
    return out
