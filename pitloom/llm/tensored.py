"""MinHash near-duplicates by tensored banding.

A table key is a pair: one hash from a first small collection and one from a second. Twelve of each give 144 tables from 24 hashes, 72 minhashes in place of 864. What no other text has in
common in either collection is left out before pairs are formed, so that most texts form none. Candidates are confirmed on the full sets of shingles.

A table key that many texts share is never paired out: all its texts are compared with the one that has most company, what isn't linked to the key's largest component by then with another text
of that, and only what is in different components after that is compared within the key, small keys pair by pair and large ones block against block. So no link between components is
lost, and no group of copies is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_labels
from .scratch import materialize
from .tokens import mixed
from .words import WordFeatures, shipped, text_rows

#: At similarity 0.85 two texts share none of 12 hashes of 3 minhashes with probability (1 - 0.85^3)^12 = 0.00001, in either collection.
SLOTS, HASHES = 12, 3
#: A key of more texts than this isn't paired out.
SMALL = 16
#: Texts and shingles of one side of a block comparison, about; pairs that share one copy of a set.
BLOCK_TEXTS, BLOCK_SHINGLES, SHARED_BY = 256, 100_000, 128
#: Bits of a filter: so many for each row, and this many at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
_ODD = np.uint64(0x9E3779B97F4A7C15)


class ShingleSets:
    """Sorted distinct 64-bit hashes of a text's word shingles; words are hashed once each."""

    def __init__(self, size: int) -> None:
        self._size = size
        self._words = WordFeatures(lambda words: np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)))

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """A-Z is lower-cased, words stand between ASCII white space; fewer words than a shingle has are one shingle, none have none."""
        words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
        return [self._set(x) for x in self._words.rows(words)]

    def _set(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x.astype(np.uint64)
        size = min(self._size, len(x))
        out = np.full(len(x) - size + 1, size, np.uint64)
        for k in range(size):
            out = mixed(out * _ODD + x[k : k + len(out)])
        return np.unique(out)


class Halves:
    """The hashes of both collections; a hash names its collection and slot."""

    def __init__(self, slots: int = SLOTS, hashes: int = HASHES, seed: int = 42) -> None:
        draw = np.random.default_rng(seed)
        self._shape = (2 * slots, hashes)
        self._salt, self._odd = (draw.integers(0, 2**64, (2 * slots * hashes, 1), np.uint64) for _ in range(2))
        self._odd |= np.uint64(1)
        self._row = draw.integers(0, 2**64, self._shape, np.uint64) | np.uint64(1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, np.int64)
        least = np.full(len(self._salt), 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), 1024):
            least = np.minimum(least, ((hashes[at : at + 1024] ^ self._salt) * self._odd).min(axis=1))
        keys = (mixed(least).reshape(self._shape) * self._row).sum(axis=1, dtype=np.uint64)
        return mixed(keys + np.arange(len(keys), dtype=np.uint64)).view(np.int64)


def digest_of(hashes: np.ndarray) -> bytes | None:
    """128 bits of a set; none for an empty one."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 x intersection >= percent x union, of sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """id, text_hash, n (distinct shingles), digest of the set, halves. No shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, halves = ShingleSets(size), Halves()
        for batch in batches:
            found = [(len(h), digest_of(h), halves.of(h)) for (texts,) in text_rows(batch, "text") for h in sets.of(texts)]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), *columns], names=["id", "text_hash", "n", "digest", "halves"])

    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, n long, digest binary, halves array<long>")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """digest, hashes (sorted) of each text. No shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(size)
        for batch in batches:
            for (part,) in text_rows(batch, "text", size=64):
                found = sets.of(part)
                yield pa.RecordBatch.from_arrays([pa.array(map(digest_of, found), pa.binary()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["digest", "hashes"])

    return texts.select("text").mapInArrow(of, "digest binary, hashes array<long>")


def chosen_texts(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of texts whose text_hash and id are those of a row of reps (h, i), each once. A filter of bits over reps drops most others in the scan, so that the texts which are shuffled
    grow with reps; the join decides."""
    size, wanted = 1 << 15, min(MOST_BITS, BITS_EACH * reps.count())
    while size < wanted:
        size *= 2
    bit = lambda h, i: F.pmod(F.xxhash64(h, i), F.lit(size)) + 1
    set_ = reps.select(bit("h", "i").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in set_.collect():
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    held = shipped(texts.sparkSession, bits)

    @F.pandas_udf("boolean")
    def maybe(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy() - 1
        return pd.Series((held()[at >> 3] >> (at & 7) & 1).astype(bool))

    near = texts.where(maybe(bit("text_hash", "id")))
    return near.join(reps, (F.col("text_hash") == F.col("h")) & F.col("id").eqNullSafe(F.col("i")), "left_semi").dropDuplicates(["text_hash", "id"])


# -- candidates -------------------------------------------------------------------------------------------------------


def table_keys(made: DataFrame, slots: int = SLOTS) -> DataFrame:
    """key, digest, n: the keys of every distinct set, pairs of one hash of either collection. Only hashes that another set has too form pairs; a key without them could have no
    second text."""
    half = made.where("n > 0").select("digest", "n", F.posexplode("halves").alias("slot", "half"))
    shared = half.groupBy("half").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").select("half")
    first, second = (F.collect_set(F.when(c, F.col("half"))) for c in (F.col("slot") < slots, F.col("slot") >= slots))
    sides = half.join(shared, "half", "left_semi").groupBy("digest").agg(F.max("n").alias("n"), first.alias("x"), second.alias("y"))
    return sides.select("digest", "n", F.explode("x").alias("x"), "y").select("digest", "n", "x", F.explode("y").alias("y")).select(F.xxhash64("x", "y").alias("key"), "digest", "n")


def _fits(a, b, percent: int):
    """What is shared is at most the smaller set."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


# -- confirmation -----------------------------------------------------------------------------------------------------


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs a, b those that are alike. b's set is sent for each pair, a's once for up to 128 of them; rows pass sorted, so that a task holds one set."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARED_BY).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    members = pairs.join(degree, "a").select("a", part.alias("part"), "b").join(sets.withColumnRenamed("digest", "b"), "b").select("a", "part", "b", "hashes")
    heads = degree.join(sets.withColumnRenamed("digest", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "hashes")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            lists = batch.column("hashes")
            flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            keep = []
            for k, b in enumerate(batch.column("b").is_valid().to_pylist()):
                mine = flat[ends[k] : ends[k + 1]]
                if not b:
                    head = mine.copy()
                keep.append(b and alike(head, mine, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return rows.mapInArrow(of, "a binary, b binary")


def block_links(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links a, b of one block comparison: rows of side 0 with those of side 1 in other components. What two sets share is counted by a product of incidence matrices, a part of the shingles at a time."""
    lone, all_ = (block[block["side"] == s] for s in (0, 1))
    if not len(lone) or not len(all_):
        return block.iloc[:0][["digest"]].rename(columns={"digest": "a"}).assign(b=block["digest"].iloc[:0])
    flat = [np.concatenate(x["hashes"].to_list()) for x in (lone, all_)]
    size = [x["hashes"].map(len).to_numpy() for x in (lone, all_)]
    known, place = np.unique(flat[0], return_inverse=True)
    at = np.minimum(np.searchsorted(known, flat[1]), len(known) - 1)
    hit = known[at] == flat[1]
    row = [np.repeat(np.arange(len(n)), n) for n in size]
    both = np.zeros((len(lone), len(all_)), np.int64)
    for low in range(0, len(known), 8192):
        width = min(8192, len(known) - low)
        left, right = np.zeros((len(lone), width), np.float32), np.zeros((len(all_), width), np.float32)
        mine = (place >= low) & (place < low + width)
        left[row[0][mine], place[mine] - low] = 1
        other = hit & (at >= low) & (at < low + width)
        right[row[1][other], at[other] - low] = 1
        both += (left @ right.T).astype(np.int64)  # at most 8192 a part: exact
    found = 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)
    i, j = np.nonzero(found & (lone["component"].to_numpy()[:, None] != all_["component"].to_numpy()[None, :]))
    return pd.DataFrame({"a": lone["digest"].to_numpy()[i], "b": all_["digest"].to_numpy()[j]})


def _in_blocks(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b inside keys with several components. left: key, digest, n, component. Keys with one largest component are taken together, so that no two texts are compared in each key that they
    share: what isn't in that component is compared with all texts of its keys, dealt into blocks on either side. No pair is a row, and no task holds more than two blocks."""
    largest = _largest(left)
    rows = left.join(largest, "key").select("main", "digest", "component", "n").distinct()
    lone_ = F.col("component") != F.col("main")
    count = lambda x, c=F.lit(True): F.sum(F.when(c, x).otherwise(0))
    whole = rows.groupBy("main").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"), count(F.lit(1), lone_).alias("lone_m"), count(F.col("n"), lone_).alias("lone_s"))
    blocks = lambda m, s: F.ceil(F.greatest(F.col(m) / F.lit(BLOCK_TEXTS), F.col(s) / F.lit(BLOCK_SHINGLES), F.lit(1.0))).cast("int")
    met = rows.join(whole.select("main", blocks("m", "s").alias("all_blocks"), blocks("lone_m", "lone_s").alias("lone_blocks")), "main")
    deal = lambda k: F.pmod(F.xxhash64("digest", "main"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    lone = met.where(lone_).select("main", "digest", "component", F.lit(0).alias("side"), deal("lone_blocks").alias("i"), each("all_blocks").alias("j"))
    all_ = met.select("main", "digest", "component", F.lit(1).alias("side"), each("lone_blocks").alias("i"), deal("all_blocks").alias("j"))
    sized = lone.unionByName(all_).join(sets, "digest")
    return sized.groupBy("main", "i", "j").applyInPandas(lambda block: block_links(block, percent), "a binary, b binary").distinct()


def _largest(rows: DataFrame) -> DataFrame:
    """key, main: the component with most texts of each key."""
    return rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "component")).alias("l")).select("key", F.col("l.component").alias("main"))


def _undecided(bucket: DataFrame, labels: DataFrame) -> DataFrame:
    """key, digest, n, m, component of keys that hold several components, written as a table."""
    now = bucket.join(labels, bucket.digest == labels.node, "left").select("key", "digest", "n", "m", F.coalesce("component", "digest").alias("component"))
    several = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    return materialize(now.join(several, "key", "left_semi"))


def links(made: DataFrame, texts: DataFrame, *, size: int, percent: int, small: int = SMALL) -> DataFrame:
    """node, component: components over links between digests. made: sketches; texts: id, text_hash, text."""
    keys = materialize(table_keys(made))
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    bucket = materialize(keys.join(many, "key"))
    # one row of those that have a set; rows of one text and id are one
    reps = bucket.select("digest").distinct().join(made, "digest").groupBy("digest").agg(F.min(F.struct("text_hash", "id")).alias("r")).select(F.col("r.text_hash").alias("h"), F.col("r.id").alias("i"))
    chosen = chosen_texts(texts, materialize(reps))
    # dealt by digest once, for all joins below
    sets = materialize(shingle_sets(chosen, size)).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "digest").persist(StorageLevel.MEMORY_AND_DISK)
    # first: a key's texts against the one that has most company
    weight = bucket.groupBy("digest").agg(F.sum("m").alias("weight"))
    lead = bucket.join(weight, "digest").groupBy("key").agg(F.max(F.struct("weight", "digest", "n")).alias("l")).select("key", F.col("l.digest").alias("a"), F.col("l.n").alias("n_a"))
    led = lambda rows, lead: rows.join(lead, "key").where((F.col("digest") != F.col("a")) & _fits(F.col("n"), F.col("n_a"), percent)).select("a", F.col("digest").alias("b")).distinct()
    star = materialize(led(bucket, lead))
    edges = materialize(confirmed(star, sets, percent))
    labels = component_labels(edges)
    left = _undecided(bucket, labels)
    # then: what isn't in a key's largest component against some text of that, another one in each key
    placed = left.join(_largest(left), "key")
    lead = placed.where("component = main").groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "digest").alias("h"), "digest", "n")).alias("l")).select("key", F.col("l.digest").alias("a"), F.col("l.n").alias("n_a"))
    again = materialize(led(placed.where("component != main"), lead).join(star, ["a", "b"], "left_anti"))
    found = materialize(confirmed(again, sets, percent))
    if not found.isEmpty():
        edges = materialize(edges.unionByName(found))
        labels = component_labels(edges)
        left = _undecided(left.drop("component"), labels)
    # last: what is left in other components against all of the key
    few = left.where(F.col("m") <= small)
    other = few.select("key", F.col("digest").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("component_b"))
    across = few.join(other, "key").where((F.col("digest") < F.col("b")) & (F.col("component") != F.col("component_b")) & _fits(F.col("n"), F.col("n_b"), percent)).select(F.col("digest").alias("a"), "b").distinct()
    tried = star.unionByName(again).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = confirmed(materialize(across.join(tried, ["a", "b"], "left_anti")), sets, percent)
    rest = materialize(more.unionByName(_in_blocks(left.where(F.col("m") > small), sets, percent)))
    sets.unpersist()
    return labels if rest.isEmpty() else component_labels(edges.unionByName(rest))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable), kept (whether that is its own): a row for each row.

    Texts are linked if 100 x intersection >= percent x union of their sets of word shingles. Sets are compared by 64-bit hashes of their shingles, equal sets by 128 bits. Rows without words
    (null and empty texts) have an empty set, are linked with nothing and keep their id. Rows that share an id but not a text are linked only through their texts. A null id names no
    component: one of null ids only has a null component_id, and kept is false there. Other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    made = materialize(sketches(rows, size))
    labels = links(made, rows, size=size, percent=percent, small=small)
    least = made.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"))
    named = least.join(labels, least.digest == labels.node, "left").select("digest", "least", F.coalesce("component", "digest").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    of_set = named.join(names, "component").select("digest", "name")
    out = made.select("id", "n", "digest").join(of_set, "digest", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("name")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
