"""Small summaries of groups, made in tasks and merged in two steps.

A task keeps one array for each group while it reads its batches, so that what is shuffled is a row for each group and task. Spark brings the arrays of a group together by
buckets of tasks and then the buckets, so that no step holds more of them than there are tasks divided by buckets, or buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that a task holds before it passes their summaries on; summaries that meet in the last step.
HELD, BUCKETS = 4096, 64

Made = Iterable[tuple[str | None, int, np.ndarray]]


def reduced(rows: DataFrame, group: Sequence[str], make: Callable[[pd.DataFrame], Made], merge: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """group, name, n_obs, summary (array<double>).

    make(rows of a group in a batch) gives (name, number of rows, array) for each summary that the group has; merge(arrays) is the summary of them all. Arrays are merged in the order
    of their tasks, so the result doesn't depend on which comes first.
    """
    group = list(group)
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    names = [*group, "name", "part", "n_obs", "summary"]

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        part = TaskContext.get().partitionId() << 20

        def out() -> pd.DataFrame:
            nonlocal part
            done = pd.DataFrame([(*key, part, n, np.ravel(x)) for key, (n, x) in held.items()], columns=names)
            held.clear()
            part += 1
            return done

        for batch in batches:
            for key, mine in batch.groupby(group, sort=False, dropna=False):
                for name, n, new in make(mine):
                    before = held.get((*key, name))
                    held[(*key, name)] = (n, new) if before is None else (before[0] + n, merge([before[1], new]))
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = [np.ravel(merge([np.asarray(p["summary"], float) for p in parts])) for parts in batch["parts"]]
            yield batch.drop(columns="parts").assign(n_obs=[sum(p["n_obs"] for p in parts) for parts in batch["parts"]], summary=arrays)

    def together(parts: DataFrame, by: Sequence[str], kept: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct("part", "n_obs", "summary"))).alias("parts")
        return parts.groupBy(*by).agg(listed).mapInPandas(merged, f"{kinds}, name string, {kept} n_obs long, summary array<double>")

    made = rows.mapInPandas(in_task, f"{kinds}, name string, part long, n_obs long, summary array<double>")
    some = together(made.withColumn("bucket", F.shiftright("part", 20) % BUCKETS), [*group, "name", "bucket"], "bucket long,")
    return together(some.withColumnRenamed("bucket", "part"), [*group, "name"], "")
