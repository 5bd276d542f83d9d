"""Ranks, buckets and rank correlations of many pairs of columns within cross-sections.

A cross-section goes to a task as blocks of some fields with all labels, so that what is shuffled grows with the columns and not with their pairs. A task holds one block of one
cross-section: rows times BLOCK fields and the labels, eight bytes each. Missing values are NULLs; NaN counts as the greatest value and equals itself, as in Spark's order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fields of a block.
BLOCK = 6


def _order(x: np.ndarray, tie: np.ndarray | None = None) -> np.ndarray:
    return np.argsort(x, kind="stable") if tie is None else np.lexsort((tie, x))


def average_ranks(x: np.ndarray) -> np.ndarray:
    """1-based, ties get the mean of their ranks."""
    order = _order(x)
    s = x[order]
    starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))]))
    sizes = np.diff(np.append(starts, len(x)))
    out = np.empty(len(x))
    out[order] = np.repeat(starts + (sizes + 1) / 2, sizes)
    return out


class Section:
    """One block of one cross-section. fields: its names; masks choose rows."""

    def __init__(self, table: pa.Table, fields: Sequence[str], labels: Sequence[str], tie: str | None) -> None:
        self.fields = fields
        columns = {**{f: table.column(f"__x{k}") for k, f in enumerate(fields)}, **{n: table.column(f"__y{k}") for k, n in enumerate(labels)}}
        self._there = {n: pc.is_valid(c).to_numpy() for n, c in columns.items()}
        self._values = {n: c.to_numpy() for n, c in columns.items()}
        # places in the order of the ties
        self._tie = None if tie is None else np.asarray(pc.rank(table.column("__tie").combine_chunks(), tiebreaker="dense", null_placement="at_start"))
        self._ranks: dict[tuple[str, bytes], np.ndarray] = {}

    def there(self, name: str) -> np.ndarray:
        """Where the column isn't missing."""
        return self._there[name]

    def ranks(self, name: str, rows: np.ndarray) -> np.ndarray:
        """Of those rows among themselves; kept while other columns are missing in the same rows."""
        key = name, np.packbits(rows).tobytes()
        if key not in self._ranks:
            self._ranks = {k: v for k, v in self._ranks.items() if k[0] != name}  # a rank for each column at most
            self._ranks[key] = average_ranks(self._values[name][rows])
        return self._ranks[key]

    def rank_correlation(self, a: str, b: str, rows: np.ndarray) -> float | None:
        """Spearman to 12 digits, so that what should be zero is; None where one doesn't vary."""
        if not rows.any():
            return None
        x, y = (r - r.mean() for r in (self.ranks(a, rows), self.ranks(b, rows)))
        scale = float(np.sqrt((x @ x) * (y @ y)))
        return round(float(x @ y) / scale, 12) if scale else None

    def deviation(self, name: str, rows: np.ndarray) -> float:
        return float(self._values[name][rows].std())

    def bucket_means(self, by: str, of: str, rows: np.ndarray, buckets: int) -> Iterator[tuple[int, float]]:
        """Means of a column in the buckets of another: right-closed cuts of equal width of the numbers 1 to n, equal values in the order of the ties. Buckets without rows are absent."""
        x, y = self._values[by][rows], self._values[of][rows]
        n = len(x)
        number = np.arange(n, dtype=np.int64)
        bucket = np.maximum(1, (number * buckets + n - 2) // max(n - 1, 1)) if n > 1 else np.ones(n, np.int64)
        y = y[_order(x, self._tie[rows])]
        for q in range(1, buckets + 1):
            low, high = np.searchsorted(bucket, [q, q + 1])
            if high > low:
                yield q, float(y[low:high].mean())


def by_section(rows: DataFrame, date: str, fields: Sequence[str], labels: Sequence[str], of: Callable[[Section], Iterable[tuple]], schema: str, *, tie: str | None = None) -> DataFrame:
    """date, then the columns of the schema: of(block) gives tuples of these. tie: the column that settles the order of equal values."""
    fields, labels = list(fields), list(labels)
    blocks = [fields[k : k + BLOCK] for k in range(0, len(fields), BLOCK)]
    double = lambda c: F.col(c).cast("double")
    width = max(map(len, blocks))
    each = [F.struct(F.lit(k).alias("__block"), *((double(block[j]) if j < len(block) else F.lit(None).cast("double")).alias(f"__x{j}") for j in range(width))) for k, block in enumerate(blocks)]
    keys = [F.col(date), *(double(y).alias(f"__y{k}") for k, y in enumerate(labels)), *([F.col(tie).cast("string").alias("__tie")] if tie else [])]
    dealt = rows.select(*keys, F.explode(F.array(*each)).alias("__b")).select("*", "__b.*").drop("__b")
    kind = rows.schema[date].dataType
    whole = StructType.fromDDL(f"`{date}` {kind.simpleString()}, {schema}")
    names = whole.names

    def found(table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = [*of(Section(table, blocks[table.column("__block")[0].as_py()], labels, tie))]
        wanted = to_arrow_schema(whole)
        first = table.column(date)[0].as_py()
        columns = [[first] * len(out), *([t[k] for t in out] for k in range(len(names) - 1))]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, wanted, strict=True)], names=names)

    return dealt.groupBy(date, "__block").applyInArrow(found, whole)
