"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive tokens; its hash takes the tokens at some positions and ignores the
others, so that it survives substitutions there. Seeds of documents and benchmark items are joined;
around every hit the two texts are compared token by token on the hit's diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import NOT_ALPHANUMERIC, Hasher, byte_classes, mixed, slices, words_of
from .words import shipped

#: Fixed values. Of 13 tokens with any two substituted, one of these masks fits between the substitutions.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 9, 10))
WINDOW, SIMILARITY = 13, 0.8
#: Items with fewer tokens are only found in documents that have no other tokens: as a part of longer texts they would tell nothing.
SHORTEST = 5
#: Hits that are looked at together.
_TOGETHER = 1 << 20
#: What isn't a letter, digit or mark beyond ASCII, where bytes don't tell.
_OTHER = r"[^\x00-\x7F\p{L}\p{N}\p{M}]"


def lowered(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    """With the texts in lower case and white space for what separates tokens beyond ASCII."""
    at = batch.schema.get_field_index(text)
    low = pc.utf8_lower(batch.column(at))
    if not pc.all(pc.string_is_ascii(low), min_count=0).as_py():
        low = pc.replace_substring_regex(low, _OTHER, " ")
    return batch.set_column(at, batch.schema.field(at), low)


def seed_hashes(words: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Of the mask at each position where it fits."""
    n = len(words) - mask[-1]
    total = np.full(max(n, 0), salt, np.uint64)
    for at in mask if n > 0 else ():
        total *= np.uint64(0xC2B2AE3D27D4EB4F)
        total += words[at : at + n]
    return mixed(total)


def masks_for(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(salt, mask) for an item of n tokens. Below WINDOW, the run of tokens that is left between any substitutions SIMILARITY permits; below SHORTEST, all."""
    if n < SHORTEST:
        return [(2000 + n, tuple(range(n)))] if n else []
    if n >= WINDOW:
        return [(k + 1, m) for k, m in enumerate(MASKS)]
    other = int(n * (1 - SIMILARITY) + 1e-9)
    run = -(-(n - other) // (other + 1))
    return [(1000 + run, tuple(range(run)))]


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Tokens of doc at diagonal + i against those of item at i: the longest stretch made of windows of WINDOW tokens (or of
    the whole item if it is shorter) that agree in SIMILARITY of their tokens or more, as (start in item, length, equal tokens)."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    width = min(WINDOW, len(item))
    if high - low < width:
        return None
    same = np.concatenate([[0], np.cumsum(item[low:high] == doc[low + diagonal : high + diagonal])])
    good = np.flatnonzero((same[width:] - same[:-width]) >= SIMILARITY * width - 1e-9)
    if not len(good):
        return None
    begin = np.concatenate([[0], np.flatnonzero(np.diff(good) > width) + 1])
    end = np.append(begin[1:], len(good)) - 1
    k = int(np.argmax(good[end] - good[begin]))
    a, b = int(good[begin[k]]), int(good[end[k]]) + width
    return low + a, b - a, int(same[b] - same[a])


def best_of_diagonals(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, best: tuple | None = None) -> tuple | None:
    """The best of `best` and the overlaps on these diagonals as (equal tokens, length, -start in doc, start in item), the greatest.

    Diagonals on which as many tokens as they have, or as are equal on them, couldn't be better aren't looked at closer."""
    low = np.maximum(0, -diagonals)
    length = np.minimum(len(item), len(doc) - diagonals) - low

    def descending(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
        return of[np.lexsort((low[of], -(low + diagonals)[of], length[of], counts))[::-1]]

    def limit(count: int, k: int) -> tuple:
        return count, int(length[k]), -int(low[k] + diagonals[k]), int(low[k])

    order = descending(length, np.arange(len(diagonals)))
    step = max(1, min(1 << 12, (1 << 22) // max(1, len(item))))
    for at in range(0, len(order), step):
        some = order[at : at + step]
        if best and limit(int(length[some[0]]), int(some[0])) <= best:
            break
        place = diagonals[some][:, None] + np.arange(len(item))
        equal = ((place >= 0) & (place < len(doc)) & (doc[np.clip(place, 0, len(doc) - 1)] == item)).sum(1)
        counts = dict(zip(some.tolist(), equal.tolist(), strict=True))
        for k in descending(equal, some).tolist():
            if best and limit(counts[k], k) <= best:
                break
            found = best_overlap(doc, item, int(diagonals[k]))
            if found:
                mine = (found[2], found[1], -(found[0] + int(diagonals[k])), found[0])
                best = max(best, mine) if best else mine
    return best


@dataclass
class Seeds:
    """Items' tokens and their seeds, sorted by hash."""

    items: np.ndarray
    tokens: list[np.ndarray]
    #: Each one once, in order.
    hashes: np.ndarray
    #: Of a seed, in order: its hash's place in `hashes` times `len(hashes) + 1`, plus that of the seed before it in its item counted from 1 (0: none).
    key: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, tokens: list[np.ndarray]) -> Seeds:
        found = [(seed_hashes(t, m, salt), k) for k, t in enumerate(tokens) for salt, m in masks_for(len(t))]
        flat = np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)])
        item = np.concatenate([np.full(len(h), k) for h, k in found] or [np.zeros(0, np.int64)])
        place = np.concatenate([np.arange(len(h)) for h, _ in found] or [np.zeros(0, np.int64)])
        hashes, code = np.unique(flat, return_inverse=True)
        before = np.where(place > 0, np.roll(code, 1) + 1, 0)
        key = code * (len(hashes) + 1) + before
        order = np.argsort(key, kind="stable")
        return Seeds(ids, tokens, hashes, key[order], item[order], place[order])

    def masks(self) -> list[tuple[int, tuple[int, ...]]]:
        return sorted({x for t in self.tokens for x in masks_for(len(t))})

    def filter(self) -> np.ndarray:
        """Whether a hash with these top 22 bits can be among the seeds."""
        out = np.zeros(1 << 22, bool)
        out[self.hashes >> np.uint64(42)] = True
        return out

    def hits(self, hashes: np.ndarray, maybe: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of hashes, items and places in them of equal seeds, a bounded number at a time; first: the positions where texts begin.

        Of neighbouring hits on one diagonal only the first is there. The others needn't be looked at: they are those whose seeds before are equal too."""
        at = np.flatnonzero(maybe[hashes >> np.uint64(42)])
        code = np.searchsorted(self.hashes, hashes[at])
        equal = self.hashes[np.minimum(code, len(self.hashes) - 1)] == hashes[at] if len(at) else np.zeros(0, bool)
        at, code = at[equal], code[equal]
        before = np.full(len(at), -1)
        follows = np.flatnonzero((np.diff(at, prepend=-2) == 1) & ~np.isin(at, first))
        before[follows] = code[follows - 1] + 1
        base = code * (len(self.hashes) + 1)
        low, high = np.searchsorted(self.key, base), np.searchsorted(self.key, base + len(self.hashes) + 1)
        cut, resume = (np.where(before < 0, high, np.searchsorted(self.key, base + before, side)) for side in ("left", "right"))
        count = np.stack([cut - low, high - resume], 1).ravel()
        begin, at = np.stack([low, resume], 1).ravel(), np.repeat(at, 2)
        some = np.flatnonzero(count)
        count, begin, at = count[some], begin[some], at[some]
        block = np.cumsum(count) // _TOGETHER
        for part in np.split(np.arange(len(count)), np.flatnonzero(np.diff(block)) + 1):
            if not len(part):
                continue
            n = count[part]
            seed = np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield np.repeat(at[part], n), self.item[seed], self.place[seed]


def _tokenised(batch: pa.RecordBatch, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, and where each row's begin."""
    w = words_of(batch.column("text"), byte_classes(NOT_ALPHANUMERIC))
    return hasher.words(w), w.first


_RESULT = "doc_id long, item_id long, doc_start int, item_start int, n_tokens int, n_equal int"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_tokens", pa.int32()), ("n_equal", pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def _longest(overlaps: DataFrame) -> DataFrame:
    """One row for each document and item."""
    best = F.max(F.struct("n_equal", "n_tokens", (-F.col("doc_start")).alias("before"), "item_start")).alias("best")
    out = overlaps.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("best.before")).alias("doc_start"), F.col("best.item_start").alias("item_start"), F.col("best.n_tokens").alias("n_tokens"), F.col("best.n_equal").alias("n_equal"))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_tokens, n_equal: the best overlap of each document and item that have one.

    Tokens are runs of letters and digits, lower-cased. An overlap is at least 13 tokens long (or the whole item, if that is
    shorter), and any 13 of its tokens or the like differ in a fifth of them at most. Items with fewer than 5 tokens are found where a document has
    no other tokens. Null ids and null texts take no part. Of equally good overlaps the one that begins first in the document counts, then the later one in the item. Rows with equal ids count as one document (item) with all their texts. An empty table gives an empty one.
    The benchmark is broadcast if its texts have at most broadcast_bytes; else its seeds are joined by a shuffle.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("size")).first().size
    return _longest(_broadcast_overlaps(docs, items) if size <= broadcast_bytes else _joined_overlaps(docs, items))


def _broadcast_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    got = items.toPandas().sort_values(["item_id", "text"], kind="stable")
    batch = lowered(pa.RecordBatch.from_pydict({"text": pa.array(list(got["text"]), pa.string())}), "text")
    hashes, first = _tokenised(batch, Hasher(21))
    seeds = Seeds.of(got["item_id"].to_numpy(np.int64), [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)])
    held = shipped(docs.sparkSession, seeds)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, hasher = held(), Hasher(21)
        maybe, masks = seeds.filter(), seeds.masks()
        for batch in batches:
            found = []
            for part in slices(batch, "text"):
                words, first = _tokenised(lowered(part, "text"), hasher)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                best: dict[tuple[int, int], tuple | None] = {}
                for salt, mask in masks:
                    for at, item, place in seeds.hits(seed_hashes(words, mask, salt), maybe, first):
                        row = np.searchsorted(first, at, "right") - 1
                        tried = np.stack([row, item, at - place - first[row]])
                        tried = tried[:, np.lexsort(tried[::-1])]
                        tried = tried[:, np.any(np.diff(tried, prepend=tried[:, :1] - 1), axis=0)]
                        pair = np.flatnonzero(np.any(np.diff(tried[:2], prepend=-1), axis=0))
                        for k, upto in zip(pair.tolist(), [*pair[1:].tolist(), tried.shape[1]], strict=True):
                            row, item = int(tried[0, k]), int(tried[1, k])
                            doc, wanted = words[first[row] : first[row + 1]], seeds.tokens[item]
                            if len(wanted) >= SHORTEST or len(doc) == len(wanted):
                                best[row, item] = best_of_diagonals(doc, wanted, tried[2, k:upto], best.get((row, item)))
                found += [(int(ids[row]), int(seeds.items[item]), -x[2], x[3], x[1], x[0]) for (row, item), x in best.items() if x]
            yield _rows(found)

    return docs.mapInArrow(of, _RESULT)


def _joined_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: seeds meet by a shuffle, then texts by their ids."""

    masks_of_docs = sorted({x for n in range(1, WINDOW + 1) for x in masks_for(n)})

    def seeds(of_docs: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(21)
            for batch in batches:
                for part in slices(batch, "text"):
                    words, first = _tokenised(lowered(part, "text"), hasher)
                    size, row = np.diff(first), np.repeat(np.arange(len(first) - 1), np.diff(first))
                    found, where, before = [], [], []
                    for salt, mask in masks_of_docs:
                        h = seed_hashes(words, mask, salt)
                        at = np.flatnonzero(row[: len(h)] == row[mask[-1] :][: len(h)])  # inside one text
                        n = size[row[at]]
                        if len(mask) < SHORTEST and salt >= 2000:
                            at = at[n == len(mask)]
                        elif not of_docs:
                            at = at[np.isin(n, [k for k in range(SHORTEST, WINDOW) if (salt, mask) in masks_for(k)]) | ((n >= WINDOW) & (salt < 1000))]
                        found.append(h[at])
                        where.append(at)
                        before.append(np.where(at > first[row[at]], h[at - 1], 0))  # zero stands for none
                    at = np.concatenate(where)
                    ids = part.column("id").to_numpy(zero_copy_only=False)[row[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(before).view(np.int64)), pa.array(ids, pa.int64()), pa.array((at - first[row[at]]).astype(np.int32))], names=["seed", "before", "id", "place"])

        return of

    kind = "seed long, before long, id long, place int"
    of_docs = docs.withColumnRenamed("doc_id", "id").mapInArrow(seeds(True), kind)
    of_items = items.withColumnRenamed("item_id", "id").mapInArrow(seeds(False), kind).toDF("seed", "item_before", "item_id", "item_place")
    # of neighbouring hits on one diagonal only the first
    met = of_docs.join(of_items, "seed").where("before != item_before or before = 0")
    tried = met.select(F.col("id").alias("doc_id"), "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).groupBy("doc_id", "item_id").agg(F.collect_set("diagonal").alias("diagonals"))
    both = tried.join(items.withColumnRenamed("text", "item_text"), "item_id").join(docs, "doc_id").select("doc_id", "item_id", "diagonals", "text", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(21)
        for batch in batches:
            found = []
            for part in slices(batch, "text"):
                words, first = _tokenised(lowered(part, "text"), hasher)
                wanted = part.select(["item_text"]).rename_columns(["text"])
                tokens, begin = _tokenised(lowered(wanted, "text"), hasher)
                for k, (i, j, diagonals) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "item_id", "diagonals")), strict=True)):
                    doc, item = words[first[k] : first[k + 1]], tokens[begin[k] : begin[k + 1]]
                    if len(item) < SHORTEST and len(doc) != len(item):
                        continue
                    best = best_of_diagonals(doc, item, np.array(diagonals))
                    if best:
                        found.append((i, j, -best[2], best[3], best[1], best[0]))
            yield _rows(found)

    return both.mapInArrow(verify, _RESULT)
