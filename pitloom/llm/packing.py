"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the largest permitted length. Within a shard, pieces go by
descending length into the open bin with the least room that suffices. If none has, the permitted length with
the least cost per token opens: its own length and a fixed overhead, over what it can still be filled with.
At the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordFeatures, text_rows

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer splits a text before it looks for pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The pattern's white space (not Python's, which has 0x1C to 0x1F too). No match of the pattern goes on from another character into it.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_RUN = re.compile(f"[{_SPACE}]*")
#: Runs of white space from this length on aren't left to the pattern, whose search goes as deep as a run is long.
LONG_RUN = 10_000


def read_encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens_of(encoding, chunk: str) -> int:
    """Tokens of white space and the word after it, either may be missing. The pattern takes a run before a word as one match but for its last character, a run at the end as a whole."""
    run = _RUN.match(chunk).end()
    if run < LONG_RUN:
        return len(encoding.encode_ordinary(chunk))
    end = run - 1 if run < len(chunk) else run
    return len(encoding._encode_single_piece(chunk[:end])) + len(encoding.encode_ordinary(chunk[end:]))


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, n_tokens: as of the whole text encoded at once; chunks of white space and the word after it are cached. A null text has none. No shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = read_encoding(vocabulary)
        chunks = WordFeatures(lambda fresh: np.fromiter((tokens_of(encoding, w) for w in fresh), np.int64, len(fresh)))
        for batch in batches:
            out = [int(n.sum()) for (texts,) in text_rows(batch, "text") for n in chunks.rows([_CHUNK.findall(t) if t else [] for t in texts])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def pack_lengths(lengths: list[int], capacities: tuple[int, ...], overhead: int = 32) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order, each from 1 to the largest capacity: the bin and the offset of each, and the capacity of each bin."""
    capacities = tuple(sorted(capacities))
    left = sum(lengths)
    bins_with: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    some = 0  # bit r: a bin has room r
    used: list[int] = []
    room: list[int] = []
    where, offset = [], []
    for n in lengths:
        left -= n
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = bins_with[r].pop()
            if not bins_with[r]:
                some ^= 1 << r
        else:  # what follows is no longer than this one and may fill the rest
            r = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / (n + min(c - n, left)), c))
            b = len(used)
            used.append(0)
            room.append(r)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        if r > n:
            bins_with[r - n].append(b)
            some |= 1 << (r - n)
    return where, offset, [next(c for c in capacities if c >= n) for n in used]


def _pack_shard(capacities: tuple[int, ...], overhead: int, shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    where, offset, sizes = pack_lengths(shard["n_tokens"].tolist(), capacities, overhead)
    shard["bin_id"] = shard["shard"] * 2**32 + np.array(where, np.int64)
    shard["bin_capacity"] = np.array(sizes, np.int64)[where]
    shard["bin_offset"] = np.array(offset, np.int64)
    return shard[["doc_id", "piece", "piece_start", "n_tokens", "bin_id", "bin_capacity", "bin_offset"]]


def pack(lengths: DataFrame, *, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), overhead: int = 32, shard_rows: int = 20_000) -> DataFrame:
    """From doc_id, n_tokens: doc_id, piece (from 0), piece_start, n_tokens, bin_id, bin_capacity, bin_offset.

    Shards are dealt by a hash of document and piece; there are as many as it takes for about shard_rows
    pieces each, so that a task's memory doesn't depend on the input. A document without tokens gets one row of no tokens
    and no bin. Null ids and repeated rows are pieces like others. An empty table gives an empty one.
    """
    top, ids = max(capacities), lengths.schema["doc_id"].dataType.simpleString()
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    pieces = lengths.select("doc_id", n.alias("all"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(top).cast("long"))).alias("piece", "piece_start"))
    pieces = pieces.select("doc_id", F.col("piece").cast("long").alias("piece"), "piece_start", F.least(F.lit(top).cast("long"), F.col("all") - F.col("piece_start")).alias("n_tokens"))
    total = pieces.agg(F.count("*").alias("n")).first().n
    shards = max(1, -(-total // shard_rows))
    dealt = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    schema = f"doc_id {ids}, piece long, piece_start long, n_tokens long, bin_id long, bin_capacity long, bin_offset long"

    def packed_shard(shard: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(capacities, overhead, shard)

    packed = dealt.groupBy("shard").applyInPandas(packed_shard, schema)
    none = F.lit(None).cast("long")
    return packed.unionByName(pieces.where("n_tokens = 0").select("doc_id", "piece", "piece_start", "n_tokens", none.alias("bin_id"), none.alias("bin_capacity"), none.alias("bin_offset")))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, **options) -> DataFrame:
    """pack() of the token counts of whole texts; the counts are written once, as packing reads them twice."""
    from .scratch import materialize

    return pack(materialize(count_tokens(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary)), **options)
