"""Near-duplicates by the Jaccard similarity of word shingles.

Texts equal word for word are merged. Two kinds of candidates come together: texts whose SimHash fingerprints ball hashing links, and,
as fingerprints of texts with a few edited words lie further apart than any ball reaches, texts that share a MinHash band. The shingles of
the two texts decide. A band that many texts share is never paired out: all its texts are compared with its most central one, and what
is in other components after that is compared with the band block against block, so that every two texts that share a band are linked if they are similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_labels
from .scratch import materialize
from .simhash import bits_of, links
from .tokens import mixed
from .words import text_rows

#: At similarity 0.8 two texts share none of 24 bands of 5 hashes with probability (1 - 0.8^5)^24 < 0.0001.
BANDS, HASHES = 24, 5
#: A band of more texts than this isn't paired out.
SMALL = 16
#: Texts and shingles of one side of a block comparison, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 100_000


def words_of(text: str | None) -> list[bytes]:
    """As in op6: lower-cased, between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], size: int) -> set[bytes]:
    """All runs of `size` words; fewer words are one shingle, none have none."""
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a: set, b: set) -> float:
    """Two texts without words are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def hashes_of(found: set[bytes], seed: int = 42) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in found), np.uint64, len(found))


class Bands:
    """Keys of a text's bands; a band's number is part of its key."""

    def __init__(self, bands: int = BANDS, hashes: int = HASHES, seed: int = 42) -> None:
        draw = np.random.default_rng(seed)
        self._bands, self._hashes = bands, hashes
        self._salt, self._odd = (draw.integers(0, 2**64, (bands * hashes, 1), np.uint64) for _ in range(2))
        self._odd |= np.uint64(1)
        self._row = draw.integers(0, 2**64, (bands, hashes), np.uint64) | np.uint64(1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """From the hashes of a text's distinct shingles."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        least = np.full(len(self._salt), 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), 1024):  # a long text's shingles a part at a time
            least = np.minimum(least, ((hashes[at : at + 1024] ^ self._salt) * self._odd).min(axis=1))
        keys = (mixed(least).reshape(self._bands, self._hashes) * self._row).sum(axis=1, dtype=np.uint64)
        return mixed(keys + np.arange(self._bands, dtype=np.uint64)).view(np.int64)


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """id, digest (128 bits of the text's words), fingerprint, n (distinct shingles), bands (none without words). No shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            digests, prints, sizes, keys = [], [], [], []
            for (texts,) in text_rows(batch, "text"):
                for words in map(words_of, texts):
                    hashes = hashes_of(shingles(words, size))
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    prints.append(bits_of(hashes))
                    sizes.append(len(hashes))
                    keys.append(bands.of(hashes))
            columns = [batch.column("id"), pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "fingerprint", "n", "bands"])

    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, fingerprint long, n long, bands array<long>")


def similar(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of pairs a, b those with texts of that similarity or more. texts: id, text."""
    kind = pairs.schema["a"].dataType.simpleString()
    met = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, set()
        for batch in batches:
            keep = []
            for left, right in text_rows(batch, "text_a", "text_b"):
                for x, y in zip(left, right, strict=True):
                    if x != last:  # one text often meets many in turn
                        last, first = x, shingles(words_of(x), size)
                    keep.append(jaccard(first, shingles(words_of(y), size)) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "text_a", "text_b").mapInArrow(of, f"a {kind}, b {kind}").distinct()


def _by_fingerprint(nodes: DataFrame, distance: int) -> DataFrame:
    """Candidates a, b: texts with equal fingerprints against the least of them, and least ones whose fingerprints ball hashing links."""
    least = nodes.groupBy("fingerprint").agg(F.min("id").alias("least"))
    equal = nodes.join(least, "fingerprint").where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    met = links(least.select("fingerprint"), distance=distance)
    one, two = (least.select(F.col("fingerprint").alias(x), F.col("least").alias(f"least_{x}")) for x in "ab")
    far = met.join(one, "a").join(two, "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return equal.unionByName(far)


def _shingle_hashes(texts: DataFrame, size: int) -> DataFrame:
    """id, hashes: a text's distinct shingles, sorted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.sort(hashes_of(shingles(words_of(t), size))).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "hashes"])

    return texts.mapInArrow(of, f"id {texts.schema['id'].dataType.simpleString()}, hashes array<long>")


def block_links(block: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links a, b of one block comparison: rows of side 0 with those of side 1 in other components. Shared shingles are counted by a product of two incidence matrices."""
    lone, all_ = (block[block["side"] == s] for s in (0, 1))
    none = block.iloc[:0][["id"]].rename(columns={"id": "a"}).assign(b=block["id"].iloc[:0])
    if not len(lone) or not len(all_):
        return none
    flat = [np.concatenate(x["hashes"].to_list()) for x in (lone, all_)]
    size = [x["hashes"].map(len).to_numpy() for x in (lone, all_)]
    known, place = np.unique(flat[0], return_inverse=True)
    at = np.minimum(np.searchsorted(known, flat[1]), len(known) - 1)
    hit = known[at] == flat[1]
    row = [np.repeat(np.arange(len(n)), n) for n in size]
    both = np.zeros((len(lone), len(all_)), np.float32)
    for low in range(0, len(known), 8192):  # a part of the shingles at a time
        width = min(8192, len(known) - low)
        left, right = np.zeros((len(lone), width), np.float32), np.zeros((len(all_), width), np.float32)
        mine = (place >= low) & (place < low + width)
        left[row[0][mine], place[mine] - low] = 1
        other = hit & (at >= low) & (at < low + width)
        right[row[1][other], at[other] - low] = 1
        both += left @ right.T
    alike = both >= similarity * (size[0][:, None] + size[1][None, :] - both) - 1e-6
    alike &= lone["component"].to_numpy()[:, None] != all_["component"].to_numpy()[None, :]
    i, j = np.nonzero(alike)
    return none if not len(i) else pd.DataFrame({"a": lone["id"].to_numpy()[i], "b": all_["id"].to_numpy()[j]})


def _in_blocks(left: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links a, b inside bands with several components. left: key, id, component, n. What isn't in a band's largest component is compared with all of
    the band, dealt into blocks on either side; no pair is a row, and no task holds more than two blocks."""
    parts = left.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max(F.struct("m", "component", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    blocks = lambda m, s: F.ceil(F.greatest(m / F.lit(BLOCK_TEXTS), s / F.lit(BLOCK_SHINGLES), F.lit(1.0))).cast("int")
    main = main.select("key", "main", blocks(F.col("m"), F.col("s")).alias("all_blocks"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("lone_blocks"))
    met = left.join(main, "key")
    deal = lambda k: F.pmod(F.xxhash64("id", "key"), k).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    lone = met.where("component != main").select("key", "id", "component", F.lit(0).alias("side"), deal(F.col("lone_blocks")).alias("i"), each("all_blocks").alias("j"))
    all_ = met.select("key", "id", "component", F.lit(1).alias("side"), each("lone_blocks").alias("i"), deal(F.col("all_blocks")).alias("j"))
    rows = lone.unionByName(all_).join(_shingle_hashes(texts.join(left.select("id").distinct(), "id", "left_semi"), size), "id")
    kind = left.schema["id"].dataType.simpleString()

    def compared(block: pd.DataFrame) -> pd.DataFrame:
        return block_links(block, similarity)

    return rows.groupBy("key", "i", "j").applyInPandas(compared, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, distance: int = 2, small: int = SMALL) -> DataFrame:
    """doc_id, component_id: the smallest id reachable over texts of that similarity; a row for each id.

    Rows with equal ids count as one document with all their texts, null ids take no part. Texts without words are equal. An empty
    table gives an empty one. Bands of at most `small` texts are paired out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    made = materialize(sketches(rows, size))
    alike = made.groupBy("digest").agg(F.min("id").alias("node"))
    nodes = materialize(made.join(alike, ["digest"]).select("id", "node", "fingerprint", "n", "bands"))
    same = nodes.where("id != node").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct()
    own = nodes.where("id = node")
    band = own.select("id", "n", F.explode("bands").alias("key")).distinct()
    shared = band.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    left = materialize(band.join(shared, "key").select("key", "id", "n", "m"))
    few = left.where(F.col("m") <= small).select("key", "id", "n")
    other = few.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"))
    # the smaller text's shingles are at most all shared
    fits = F.least("n", "n_b") >= F.lit(similarity - 1e-9) * F.greatest("n", "n_b")
    pairs = few.join(other, "key").where((F.col("id") < F.col("b")) & fits).select(F.col("id").alias("a"), "b")
    many = left.where(F.col("m") > small)
    # a text that is like many others is in many of their bands
    central = many.groupBy("id").agg(F.sum("m").alias("weight"))
    lead = many.join(central, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("l")).select("key", F.col("l.id").alias("leader"))
    led = many.join(lead, "key").where("id != leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    tried = materialize(reduce(DataFrame.unionByName, [pairs, led, _by_fingerprint(own, distance).where("a != b")]).distinct())
    texts = materialize(rows.join(tried.select(F.explode(F.array("a", "b")).alias("id")).unionByName(many.select("id")).distinct(), "id", "left_semi"))
    # of rows with equal ids, any text may be the similar one
    edges = materialize(similar(tried, texts, size, similarity))
    labels = component_labels(edges)
    rest = many.select("key", "id", "n").join(labels, many.id == labels.node, "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed_ = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    more = materialize(_in_blocks(materialize(rest.join(mixed_, "key")), texts, size, similarity))
    labels = component_labels(reduce(DataFrame.unionByName, [same, edges, more]))
    ids = made.select(F.col("id").alias("doc_id")).distinct()
    return ids.join(labels, ids.doc_id == labels.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
