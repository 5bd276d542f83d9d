"""Correlations of all pairs of fields over the rows that have both, from masked products of matrices.

For each group, four k x k matrices hold how many rows have both fields, the mean of the first over those, and centred sums of squares and products. A batch gives them as products
of its values with its mask; two of them merge exactly as two samples' moments do, so that no large sums cancel and no pair of values is a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reduced import reduced


def moments_of(x: np.ndarray) -> np.ndarray:
    """4 x k x k of rows with missing values (NaN): counts, means of the row's field, centred squares of it, centred products."""
    there = ~np.isnan(x)
    mask = there.astype(float)
    least = np.where(there.any(axis=0), np.where(there, x, np.inf).min(axis=0), 0.0)
    moved = np.where(there, x - least, 0.0)
    n = mask.T @ mask
    some = np.maximum(n, 1)
    sums, squares = moved.T @ mask, (moved**2).T @ mask
    centred = np.maximum(squares - sums**2 / some, 0.0)
    centred[centred <= 1e-13 * squares] = 0.0  # what is constant beside some field
    return np.stack([n, np.where(n > 0, least[:, None] + sums / some, 0.0), centred, moved.T @ moved - sums * sums.T / some])


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Of the rows of all parts together."""
    k = int(round((parts[0].size / 4) ** 0.5))
    whole = parts[0].reshape(4, k, k)
    for part in parts[1:]:
        other = part.reshape(4, k, k)
        n = whole[0] + other[0]
        some = np.maximum(n, 1)
        step = np.where((whole[0] > 0) & (other[0] > 0), other[1] - whole[1], 0.0)
        share = whole[0] * other[0] / some
        mean = np.where(whole[0] == 0, other[1], np.where(other[0] == 0, whole[1], whole[1] + step * other[0] / some))
        whole = np.stack([n, mean, whole[2] + other[2] + step**2 * share, whole[3] + other[3] + step * step.T * share])
    return whole


def correlations(moments: np.ndarray) -> np.ndarray:
    """k x k, NaN where a field doesn't vary over the rows that have both."""
    n, mean, squares, products = moments
    varies = squares > n * (1e-13 * mean) ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(varies & varies.T, products / (np.sqrt(squares) * np.sqrt(squares.T)), np.nan)


def pair_correlations(rows: DataFrame, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """group, a, b, correlation, pair_size, universe_size for every unordered pair of fields, each with itself too. universe_size counts all rows of the group. A group is a row in
    the shuffle for each task that reads rows of it."""
    fields, k = list(fields), len(fields)
    i, j = np.triu_indices(k)

    def make(part: pd.DataFrame):
        yield None, len(part), moments_of(part[fields].to_numpy(float))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                moments = np.asarray(row.summary, float).reshape(4, k, k)
                found = pd.Series(correlations(moments)[i, j])
                yield pd.DataFrame({**{g: [getattr(row, g)] * len(i) for g in group}, "a": np.array(fields)[i], "b": np.array(fields)[j], "correlation": found.astype(object).where(found.notna(), None), "pair_size": moments[0][i, j].astype(np.int64), "universe_size": row.n_obs})

    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    return reduced(rows.select(*group, *fields), group, make, merged).drop("name").mapInPandas(listed, f"{kinds}, a string, b string, correlation double, pair_size long, universe_size long")
