"""Least squares by group from tall-skinny QR factors.

Each task reduces the rows that it reads to one small triangular factor for each group, a batch at a time, and Spark merges a group's factors (see reduced). A factor has the singular values of the whole design matrix, so ranks and solutions are those of the rows
themselves: nothing is squared, as in sums of products.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .reduced import reduced

#: Of a field's deviation: a residual of no more is rounding error.
NOTHING = 1e-11


def triangular(*parts: np.ndarray) -> np.ndarray:
    """The R factor of matrices on top of each other."""
    return np.linalg.qr(np.vstack(parts), "r")


def r_factors(rows: DataFrame, group: Sequence[str], fields: Sequence[str], responses: Sequence[str] = ()) -> DataFrame:
    """group, response, n_obs, r (row after row) of the columns: constant, fields, response; over rows that have all of them. Without responses there is one factor for each
    group and `response` is NULL. A group without such rows has none."""
    fields, wanted = list(fields), list(responses) or [None]
    width = len(fields) + 1 + bool(responses)

    def make(part: pd.DataFrame):
        known = part[fields].to_numpy(float)
        for response in wanted:
            x = [np.ones(len(known)), known]
            if response is not None:
                y = part[response].to_numpy(float)
                there = ~np.isnan(y)
                x = [np.ones(int(there.sum())), known[there], y[there]]
            if len(x[0]):
                yield response, len(x[0]), triangular(np.column_stack(x))

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        return triangular(*(p.reshape(-1, width) for p in parts))

    # no aliases: Catalyst would derive the condition that all fields are there anew for each of them
    base = rows.select(*group, *fields, *responses).dropna(subset=fields)
    return reduced(base, group, make, merge).withColumnsRenamed({"name": "response", "summary": "r"})


@dataclass(frozen=True)
class Fit:
    """A field's least squares on others and a constant. slopes are in the others' order; rank counts the constant; deviation and residual are population standard deviations."""

    intercept: float
    slopes: np.ndarray
    rank: int
    deviation: float
    residual: float

    @property
    def r2(self) -> float | None:
        """None for a constant field, 1 if the residual is rounding error."""
        if not self.deviation:
            return None
        return 1.0 if self.residual <= NOTHING * self.deviation else 1 - (self.residual / self.deviation) ** 2


def fit(r: np.ndarray, n: int, target: int, others: Sequence[int], *, least_norm: bool = True) -> Fit:
    """From an R factor (column 0 is the constant) of n rows. Singular values below machine precision times the larger dimension of the largest count as none, as is usual; of all
    solutions the one of least norm is given (any, if least_norm is off).

    The slopes come from centred columns of unit length, which are better conditioned than the design itself; the first row of R is what centring takes away.
    """
    others = np.asarray(others, int)
    k = len(others) + 1
    design = r[:, np.concatenate([[0], others])]
    singular = np.linalg.svd(design, compute_uv=False)
    rank = int((singular > np.finfo(float).eps * max(n, k) * singular[0]).sum())
    means = r[0] / r[0, 0]
    inner, outer = r[1:][:, others], r[1:, target]
    norms = np.sqrt((inner**2).sum(axis=0))
    flat = norms <= 1e-10 * np.sqrt(n * (1 + means[others] ** 2))
    unit = np.where(flat, 0.0, inner / np.where(flat, 1.0, norms))
    scale = np.where(flat, 1.0, norms)
    u, s, vt = np.linalg.svd(unit, full_matrices=True) if unit.size else (np.zeros((len(inner), 0)), np.zeros(0), np.eye(k - 1))
    kept = rank - 1
    if kept < len(s) and s[kept] > 1e-9 * s[0] or kept > 0 and (kept > len(s) or s[kept - 1] <= 1e-12 * s[0]):
        # a column so small that the design's own singular values drop it: the design as it stands decides
        whole = np.linalg.lstsq(design, r[:, target], rcond=np.finfo(float).eps * max(n, k))[0]
        intercept, slopes = float(whole[0]), whole[1:]
    else:
        slopes = (vt[:kept].T @ ((u[:, :kept].T @ outer) / s[:kept])) / scale
        intercept = means[target] - means[others] @ slopes
        if least_norm and kept < k - 1:
            free = vt[kept:].T / scale[:, None]
            axes = np.linalg.qr(np.vstack([-means[others] @ free, free]))[0]
            whole = np.concatenate([[intercept], slopes])
            whole = whole - axes @ (axes.T @ whole)
            intercept, slopes = float(whole[0]), whole[1:]
    deviation = float(np.sqrt((outer**2).sum() / n))
    residual = float(np.sqrt(((outer - inner @ slopes) ** 2).sum() / n))
    if deviation <= 1e-10 * np.sqrt(1 + means[target] ** 2):
        deviation = 0.0
    return Fit(float(intercept), slopes, rank, deviation, residual)
