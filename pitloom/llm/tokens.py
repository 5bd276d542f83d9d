"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word's hash is a polynomial over its bytes, a sequence's hash a polynomial over its words' hashes, both
modulo 2^64 and then mixed; prefix sums give the hash of any stretch in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_classes(separators: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


#: Words are what lies between these bytes: space and 0x09 to 0x0D.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Or between all ASCII characters that are neither letters nor digits.
NOT_ALPHANUMERIC = bytes(b for b in range(128) if not chr(b).isalnum())


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole result."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as have been asked for."""

    def __init__(self, base: int) -> None:
        self._base = (base | 1) % 2**64
        self._up = self._down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self._up) < n:
            k = len(self._up)
            self._up = np.concatenate([self._up, self._up * np.uint64(pow(self._base, k, 2**64))])
            self._down = np.concatenate([self._down, self._down * np.uint64(pow(self._base, -k, 2**64))])
        return self._up[:n], self._down[:n]


@dataclass
class Words:
    """Words of some texts in order: their bytes are data[begin:end], those of text r are first[r] to first[r + 1]."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: pa.Array, inside: np.ndarray) -> Words:
    """A null text has no words."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    is_in = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= ~is_in[:-1]
    after[:-1] |= ~is_in[1:]
    begin, end = np.flatnonzero(is_in & before), np.flatnonzero(is_in & after) + 1
    return Words(data, begin, end, np.searchsorted(begin, at))


class Hasher:
    """One of a family of hash functions, chosen by its seed, for words and for sequences of words."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self._bytes = rng.integers(0, 2**64, 256, np.uint64)
        self._byte_powers, self._word_powers = (Powers(int(x)) for x in rng.integers(0, 2**64, 2, np.uint64))

    def words(self, w: Words) -> np.ndarray:
        up, down = self._byte_powers.upto(len(w.data))
        sums = np.zeros(len(w.data) + 1, np.uint64)
        np.cumsum(self._bytes[w.data] * up, out=sums[1:])
        return mixed((sums[w.end] - sums[w.begin]) * down[w.begin] + (w.end - w.begin).astype(np.uint64))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Prefix sums, for stretch()."""
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self._word_powers.upto(len(hashes))[0], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from begin to end, none of them empty."""
        return mixed((sums[end] - sums[begin]) * self._word_powers.upto(len(sums))[1][begin] + (end - begin).astype(np.uint64))


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about `most` bytes of text together, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` values its smallest one and that one's place, the leftmost of equal ones."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = values[: len(values) - step], values[step:]
        take = right < left
        values, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        span += step
    return values, at
