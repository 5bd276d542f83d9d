"""Word features inside a task: each distinct word is computed once, texts become arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


class _Numbering(dict):
    """word -> number in order of first appearance; new words wait in `fresh`."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordFeatures:
    """Feature rows of words, computed on first sight by `compute(list of words) -> array of rows`.

    It forgets everything once `limit` words or `characters` are held (checked between texts), so memory is bounded.
    """

    def __init__(self, compute: Callable[[list], np.ndarray], limit: int = 400_000, characters: int = 16 << 20) -> None:
        self._compute, self._limit, self._characters = compute, limit, characters
        self._clear()

    def _clear(self) -> None:
        self._numbers, self._held = _Numbering(), 0
        self._rows: np.ndarray | None = None

    def rows(self, texts: list[list]) -> list[np.ndarray]:
        """For each text, given as its words, one feature row for each word, in order.

        The new words of all given texts are computed together.
        """
        if len(self._numbers) > self._limit or self._held > self._characters:
            self._clear()
        find = self._numbers.__getitem__
        ids = [np.fromiter(map(find, words), np.int64, len(words)) for words in texts]
        if self._numbers.fresh or self._rows is None:
            new = self._compute(self._numbers.fresh)
            known = len(self._numbers) - len(new)
            self._held += sum(map(len, self._numbers.fresh))
            self._numbers.fresh = []
            if self._rows is None or len(self._rows) < known + len(new):
                grown = np.empty((max(1024, 2 * (known + len(new))), *new.shape[1:]), new.dtype)
                if known:
                    grown[:known] = self._rows[:known]
                self._rows = grown
            self._rows[known : known + len(new)] = new
        return [self._rows[i] for i in ids]


def text_rows(batch: pa.RecordBatch, *names: str, size: int = 256) -> Iterator[tuple[list, ...]]:
    """Values of the named columns, a slice of rows at a time."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield tuple(part.column(n).to_pylist() for n in names)


def map_texts(df, keep: tuple[str, ...], text_col: str, added: list[tuple[str, pa.DataType, str]], make: Callable[[], Callable[[list], list[tuple]]]):
    """A row for each row: the columns in `keep`, then those in `added` (name, Arrow type, Spark type).

    make() is called once in each task and gives the function from some texts to the added values of each. No shuffle.
    """
    from pyspark.sql import functions as F

    part = df.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]), *(f"{n} {kind}" for n, _, kind in added)])
    names, kinds = [*part.columns[:-1], *(n for n, _, _ in added)], [kind for _, kind, _ in added]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            out = [x for (texts,) in text_rows(batch, "__text") for x in of(texts)]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    return part.mapInArrow(rows, schema)


def shipped(spark, value) -> Callable[[], object]:
    """Broadcast a value of bounded size together with the code of its class; call the result in a task."""
    import pickle

    from pyspark import cloudpickle

    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)  # noqa: S301
