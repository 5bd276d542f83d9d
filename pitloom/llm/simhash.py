"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within two bits of each other have a common neighbour within one bit of both. So
every distinct fingerprint emits all variants within half the radius; fingerprints that meet on a
variant are linked. A variant has at most 65 fingerprints around it, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_labels
from .scratch import materialize


def fingerprint_words(words: list[bytes], size: int = 3, seed: int = 42) -> int:
    """Of lower-cased words: the bits set in over half the hashes of all shingles; 0 without words."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length)
    begin = end - length
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], seed) for a, b in zip(begin[: len(words) - size + 1].tolist(), (end[size - 1 :] - 1).tolist(), strict=True)], np.uint64)
    return bits_of(hashes)


def bits_of(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a long text's bits a part at a time
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """id, fingerprint long (its 64 bits). A null text has no words. No shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                for text in batch.slice(at, 256).column("text").to_pylist():
                    out.append(fingerprint_words(text.encode("utf-8", "surrogatepass").lower().split(), size) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(out, np.uint64).view(np.int64))], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long")


def ball(radius: int) -> list[int]:
    """All 64-bit masks with at most so many bits."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m | 1 << b for m in masks for b in range(64)} | set(masks))
    return masks


def links(distinct: DataFrame, *, distance: int = 2) -> DataFrame:
    """a, b (a != b): fingerprints that differ in at most `distance` bits (an even number, else ValueError), linked through the least
    fingerprint around each variant; two that are linked only through others have a path. Input: distinct fingerprints."""
    if distance % 2 or distance < 0:  # half of it is no whole radius, and some links would have no variant in common
        raise ValueError("the distance must be even")
    masks = F.array(*(F.lit(m - 2**64 if m >= 2**63 else m).cast("long") for m in ball(distance // 2)))
    # dealt anew, as few small partitions would become large ones here; by a hash, as Spark leaves out a repartition
    # by a column that rows are already dealt by, and then merges the small partitions
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fingerprint"))
    variants = dealt.select("fingerprint", F.explode(masks).alias("mask")).select(F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"), "fingerprint")
    # those around one variant are within the distance of each other: at most as many as the ball has masks
    met = variants.groupBy("variant").agg(F.collect_list("fingerprint").alias("around")).where(F.size("around") > 1)
    pairs = met.select(F.array_min("around").alias("a"), F.explode("around").alias("b")).where("a != b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest id reachable over links.

    Documents with equal fingerprints are linked, those without words (null or empty texts) too, with fingerprint zero. Repeated
    rows get a row each. A null id takes no part in naming components: a component of null ids only has a
    null component_id. An empty table gives an empty one. Other columns are ignored.
    """
    prints = fingerprints(docs, id_col=id_col, text_col=text_col, size=size)
    prints = materialize(prints)
    distinct = prints.groupBy("fingerprint").agg(F.min("id").alias("least"))
    labels = component_labels(links(distinct.select("fingerprint"), distance=distance))
    named = distinct.join(labels, distinct.fingerprint == labels.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("fingerprint", "component_id")
    out = prints.join(named, "fingerprint")
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
