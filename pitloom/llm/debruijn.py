"""Exact removal of passages that occur earlier in the corpus, over a compacted de Bruijn graph.

Each window of `window` words is represented by its anchor: the one of its token k-mers with the least
hash. Equal windows have equal anchors at equal places, so that windows need comparing only where
anchors meet. The anchors are the graph's nodes; consecutive windows with the same anchor form one edge, labelled with the
hash of all its words, and a node's degree is the number of its different labels. An edge whose anchor has degree one doesn't branch: every
occurrence but the first repeats it as a whole. Joins find which edges go on where the one before ends, in the repeat as in its source; such
paths compact into one long span with the source's coordinates. The words at both coordinates are then compared through a hash of another
family, and only spans that agree are removed. Windows of branching edges are compared one by one. A tie in the 64-bit anchor is settled by the
64-bit label of its words, a span by 64 bits more, a window by 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .tokens import WHITE, Hasher, byte_classes, least, mixed, slices, words_of


#: So many edges or windows are compared at once inside a task.
_TOGETHER = 500_000


def _first_of_equals(keys: list[np.ndarray], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row whether it is the earliest of those with the same keys (by id, then start), and which row is."""
    order = np.lexsort((starts, ids, *keys))
    new = np.ones(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] = (s[1:] != s[:-1]) | new[1:] if k is not keys[0] else s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][group]
    out, first = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    out[order] = (ids[order] == ids[head]) & (starts[order] == starts[head])
    first[order] = head
    return out, first


def _runs(at: np.ndarray, ids: np.ndarray, starts: np.ndarray, count: np.ndarray, steady: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows `at`, those where a run begins that continues from row to row (with the same `steady` values), and how many windows it has."""
    if not len(at):
        return at, count[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (ids[at[1:]] != ids[at[:-1]]) | (starts[at[1:]] != starts[at[:-1]] + count[at[:-1]])
    for x in steady:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    return at[new], np.add.reduceat(count[at], np.flatnonzero(new))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def edges(docs: DataFrame, *, window: int = 20, anchor: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """anchor, label, id, start (of its first window, in words), n (windows), known, source_id, source_start.

    Edges that occur earlier in the same batch of rows, at their source, are known to be repeats; they needn't meet
    the others, so that runs of them are merged and carry a key that spreads them instead of their anchor. This
    bounds a hot anchor's rows with one label by the number of batches.
    """

    def merged(parts: list[tuple]) -> pa.RecordBatch:
        key, label, ids, begin, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        earliest, first = _first_of_equals([key, label], ids, begin)
        known = ~earliest
        source, place = ids[first], begin[first]
        run, total = _runs(np.flatnonzero(known), ids, begin, count, (source, place - begin))
        key[run] = mixed(label[run] ^ mixed(ids[run].view(np.uint64) + begin[run].astype(np.uint64)))
        count[run] = total
        rest = ~known
        rest[run] = True
        return pa.RecordBatch.from_arrays([_signed(key[rest]), _signed(label[rest]), pa.array(ids[rest]), pa.array(begin[rest].astype(np.int32)), pa.array(count[rest].astype(np.int32)), pa.array(known[rest]), pa.array(source[rest], mask=~known[rest]), pa.array(place[rest].astype(np.int32), mask=~known[rest])], names=["anchor", "label", "id", "start", "n", "known", "source_id", "source_start"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmers, labels, parts = Hasher(11), Hasher(12), []
        for part in (p for b in batches for p in slices(b, "text")):
            w = words_of(part.column("text"), byte_classes(WHITE))
            n = len(w.begin)
            if n < window:
                continue
            row = w.row()
            starts = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
            if not len(starts):
                continue
            hashes = kmers.words(w)
            at = np.arange(n - anchor + 1)
            kmer = kmers.stretch(kmers.sums(hashes), at, at + anchor)
            place = least(kmer, window - anchor + 1)[1][starts]
            new = np.ones(len(starts), bool)
            new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
            run = np.flatnonzero(new)
            count = np.diff(np.append(run, len(starts)))
            begin = starts[run]
            label = labels.stretch(labels.sums(mixed(hashes)), begin, begin + count + window - 1)
            ids = part.column("id").to_numpy(zero_copy_only=False)[row[begin]]
            parts.append((kmer[place[run]], label, ids.astype(np.int64), begin - w.first[row[begin]], count))
            if sum(len(x[0]) for x in parts) > _TOGETHER:
                yield merged(parts)
        if parts:
            yield merged(parts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInArrow(of, "anchor long, label long, id long, start int, n int, known boolean, source_id long, source_start int")


def repeats(found: DataFrame) -> DataFrame:
    """From edges(): id, start, n, source_id, source_start, branching; edges that neither repeat nor branch are left out.

    Source coordinates are null for branching edges.
    """
    graph = found.where("not known").groupBy("anchor").agg(F.count("*").alias("uses"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("id", "start")).alias("first")).where("uses > 1")
    met = found.join(graph.select("anchor", (F.col("low") != F.col("high")).alias("branching"), "first"), "anchor", "left")
    first = F.col("first")
    later = (F.col("id") != first["id"]) | (F.col("start") != first["start"])
    met = met.where(F.col("known") | F.col("branching") | (first.isNotNull() & later))
    branching = F.coalesce(~F.col("known") & F.col("branching"), F.lit(False))
    source = F.when(F.col("known"), F.struct(F.col("source_id").alias("id"), F.col("source_start").alias("start"))).when(~branching, first)
    return met.select("id", "start", "n", source["id"].alias("source_id"), source["start"].alias("source_start"), branching.alias("branching"))


def passages(repeated: DataFrame) -> DataFrame:
    """From repeats(): nonbranching edges that follow one source compacted to id, start, n (windows), source_id, source_start."""
    steps = repeated.where("not branching").select("id", "start", "n", "source_id", "source_start").distinct()
    ends = steps.select("id", (F.col("start") + F.col("n")).alias("start"), "source_id", (F.col("source_start") + F.col("n")).alias("source_start"), F.lit(0).alias("head")).distinct()
    place = ["id", "start", "source_id", "source_start"]
    met = steps.join(ends, place, "left").select(*place, "n", F.coalesce("head", F.lit(1)).alias("head"), (F.col("source_start") - F.col("start")).alias("shift"))
    along = Window.partitionBy("id", "source_id", "shift").orderBy("start", "n")
    paths = met.withColumn("path", F.sum("head").over(along)).groupBy("id", "source_id", "shift", "path")
    return paths.agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n"), F.min("source_start").alias("source_start")).select("id", "start", "n", "source_id", "source_start")


def _looked_up(docs: DataFrame, repeated: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """What the texts hold at the places that are asked for: windows of branching edges (key, check, id, start, n, known; mark null), and the words of
    passages and of their sources (id, start, n and their hash, mark). Each text is read once for both."""

    def merged(parts: list[tuple]) -> pa.RecordBatch:
        key, check, ids, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        known = ~_first_of_equals([key, check], ids, start)[0]
        count = np.ones(len(key), np.int64)
        run, total = _runs(np.flatnonzero(known), ids, start, count)
        key[run] = mixed(key[run] ^ mixed(ids[run].view(np.uint64) + start[run].astype(np.uint64)))
        count[run] = total
        rest = ~known
        rest[run] = True
        rows = [_signed(key[rest]), pa.array((check[rest] >> np.uint64(33)).astype(np.int32)), pa.array(ids[rest]), pa.array(start[rest].astype(np.int32)), pa.array(count[rest].astype(np.int32)), pa.array(known[rest])]
        return pa.RecordBatch.from_arrays([*rows, pa.nulls(len(rows[0]), pa.int64())], names=names)

    def marks(parts: list[tuple]) -> pa.RecordBatch:
        mark, ids, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), none.cast(pa.bool_()), _signed(mark)], names=names)

    names = ["key", "check", "id", "start", "n", "known", "mark"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other, third, parts, seen = Hasher(13), Hasher(14), Hasher(15), [], []
        for part in (p for b in batches for p in slices(b.filter(b.column("spans").is_valid()), "text")):
            w = words_of(part.column("text"), byte_classes(WHITE))
            spans = part.column("spans")
            flat = spans.flatten()
            begin, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n"))
            whole = flat.field("whole").to_numpy(zero_copy_only=False).astype(bool)
            row = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths()))
            ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = hasher.words(w)
            place = w.first[row] + begin
            inside = whole & (place + n + window - 1 <= w.first[row + 1])  # of texts with one id each has its own length
            if inside.any():
                at, upto = place[inside], place[inside] + n[inside] + window - 1
                seen.append((third.stretch(third.sums(mixed(hashes)), at, upto), ids[row[inside]], begin[inside], n[inside]))
                if sum(len(x[0]) for x in seen) > _TOGETHER:
                    yield marks(seen)
            begin, n, row = begin[~whole], n[~whole], row[~whole]
            if not len(n):
                continue
            whose = np.repeat(row, n)
            start = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = w.first[whose] + start
            fits = place + window <= w.first[whose + 1]
            whose, start, place = whose[fits], start[fits], place[fits]
            parts.append((hasher.stretch(hasher.sums(hashes), place, place + window), other.stretch(other.sums(mixed(hashes)), place, place + window), ids[whose], start))
            if sum(len(x[0]) for x in parts) > _TOGETHER:
                yield merged(parts)
        for rows, make in ((parts, merged), (seen, marks)):
            if rows:
                yield make(rows)

    ask = lambda df, whole, id_="id", start="start": df.select(F.col(id_).alias("id"), F.col(start).cast("int").alias("start"), F.col("n").cast("int").alias("n"), F.lit(whole).alias("whole"))
    asked = ask(repeated.where("branching"), False).unionByName(ask(spans, True).unionByName(ask(spans, True, "source_id", "source_start")).distinct())
    by_text = asked.groupBy("id").agg(F.collect_list(F.struct("start", "n", "whole")).alias("spans"))
    return docs.join(by_text, "id", "left").select("id", "text", "spans").mapInArrow(of, "key long, check int, id long, start int, n int, known boolean, mark long")


def _verified(spans: DataFrame, found: DataFrame) -> DataFrame:
    """id, start, n of the passages whose words are those at their source's coordinates."""
    marks = found.where("mark is not null").select("id", "start", "n", "mark").distinct()
    source = marks.select(F.col("id").alias("source_id"), F.col("start").alias("source_start"), "n", F.col("mark").alias("source_mark"))
    met = spans.join(marks, ["id", "start", "n"]).join(source, ["source_id", "source_start", "n"])
    return met.where("mark = source_mark").select("id", "start", F.col("n").cast("bigint").alias("n"))


def _repeated_windows(found: DataFrame) -> DataFrame:
    """id, start, n: windows of branching edges that occur earlier."""
    windows = found.where("mark is null").select("key", "check", "id", "start", "n", "known")
    # one row for each batch that has a window; its earliest place is reduced before the shuffle and met by a join, which splits what is hot
    unknown = windows.where("not known")
    first = unknown.groupBy("key", "check").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("uses")).where("uses > 1")
    later = unknown.join(first, ["key", "check"]).where("id != first.id or start != first.start")
    gone = later.select("id", "start", "n").unionByName(windows.where("known").select("id", "start", "n"))
    return gone.withColumn("n", F.col("n").cast("bigint"))


def remove_repeats(docs: DataFrame, *, window: int = 20, anchor: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (the kept words joined by one space), n_words, n_removed.

    A word goes if a window of `window` words that covers it occurs earlier: in a document with a smaller
    id, or earlier in the same one. Windows are judged on the input. A null text counts as empty;
    texts shorter than a window lose nothing. Rows with equal id and text are one document twice:
    neither is earlier; rows with equal ids and different texts count as one document with both texts, which loses words at the same places in each. A null id takes no part and loses nothing. An empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    repeated = materialize(repeats(edges(docs, window=window, anchor=anchor, id_col="id")))
    spans = materialize(passages(repeated))
    found = materialize(_looked_up(docs, repeated, spans, window))
    gone = _verified(spans, found).unionByName(_repeated_windows(found))
    gone = gone.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, size, lost = [], [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split() if text else []
                    size.append(len(words))
                    if spans:
                        steps = np.zeros(len(words) + 1, np.int64)
                        begin = np.array([s["start"] for s in spans])
                        np.add.at(steps, begin, 1)
                        np.add.at(steps, np.minimum(begin + [s["n"] + window - 1 for s in spans], len(words)), -1)
                        keep = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
                        words = [words[k] for k in keep]
                    lost.append(size[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(size, pa.int64()), pa.array(lost, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return docs.join(gone, "id", "left").select("id", "text", "spans").mapInArrow(of, "doc_id long, text string, n_words long, n_removed long")
