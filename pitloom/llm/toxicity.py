"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (hashed into rows of one embedding table) and of itself,
so that unseen inflections and misspellings share vectors with seen words. A text is the average of its words' embeddings, which passes a
linear softmax over {clean, toxic}. The average is weighted, so that one insult isn't thinned out by a long text: a word's weight
is a bounded exponential of a linear function of its own embedding, learned together with table and softmax.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .words import WordFeatures, map_texts, shipped


#: A longer run of characters without white space (as in scripts without spaces) counts as several words of so many characters.
LONG = 24


def words_of(text: str | None, longest: int) -> list[str]:
    """All words of a text, in order. Parts of a long one overlap, so that no n-gram of up to `longest` characters is lost between them."""
    if not text:
        return []
    words = text.lower().split()
    if all(len(w) <= LONG for w in words):
        return words
    return [w[at : at + LONG + longest - 1] for w in words for at in (range(0, max(1, len(w) - longest + 1), LONG) if len(w) > LONG else (0,))]


#: Weights of words lie between exp(-BOUND) and exp(BOUND).
BOUND = 6.0


@dataclass
class BagModel:
    buckets: int
    shortest: int
    longest: int
    #: What each bucket adds to the difference of the two softmax inputs, once embedded.
    scores: np.ndarray
    #: What each bucket adds to the logarithm of a word's weight, before it is bounded and divided by the word's features.
    weights: np.ndarray
    bias: float

    def features(self, word: str) -> list[int]:
        bare = word.strip("\"'.,;:!?()[]{}<>*#%$&-_|/\\~`+=«»“”‘’…¿¡")
        framed = f"<{bare}>"
        out = [zlib.crc32(framed.encode("utf-8", "surrogatepass")) % self.buckets]
        for n in range(self.shortest, self.longest + 1):
            out += [zlib.crc32(framed[i : i + n].encode("utf-8", "surrogatepass")) % self.buckets for i in range(len(framed) - n + 1)]
        return out

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its features' scores and their number, both times its weight."""
        out = np.zeros((len(words), 2))
        if words:
            bags = [self.features(w) for w in words]
            size = np.fromiter(map(len, bags), np.int64, len(bags))
            flat = np.fromiter((f for b in bags for f in b), np.int64, int(size.sum()))
            begin = np.cumsum(size) - size
            out[:, 0] = np.add.reduceat(self.scores[flat], begin)
            out[:, 1] = size
            out *= np.exp(BOUND * np.tanh(np.add.reduceat(self.weights[flat], begin) / size / BOUND))[:, None]
        return out

    def logit(self, rows: np.ndarray) -> float:
        """Of a text's words; without words the bias alone."""
        if not len(rows):
            return self.bias
        score, size = rows.sum(axis=0)
        return float(score / size) + self.bias


def sample_labels(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", rows_per_class: int = 2500) -> DataFrame:
    """id_col, label_col of at most rows_per_class labels of each class, the first by a hash of the id: so few that their join with
    the documents can broadcast them. Null ids and labels are left out."""
    known = labels.select(id_col, label_col).dropna()
    mixed = F.xxhash64(F.col(id_col))
    chosen = [known.where(c).orderBy(mixed, id_col).limit(rows_per_class) for c in (F.col(label_col) == 1, F.col(label_col) != 1)]
    return chosen[0].unionByName(chosen[1])


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = 2500, bytes_per_class: int = 48 << 20, **options) -> BagModel:
    """Fit on a bounded sample of labelled rows: about rows_per_class of each class, chosen by a hash
    of the id, and of those so many, in order of the hash, as have bytes_per_class of text together. Null labels are left out; a null text counts as
    empty. A document with two labels is learned once with each."""
    train = train.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(label_col) == 1).cast("int").alias("y")).where("y is not null")
    sizes = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(rows_per_class / max(1, sizes.get(1, 1)))).otherwise(F.lit(rows_per_class / max(1, sizes.get(0, 1))))
    mix = F.xxhash64("id")
    chosen = materialize(train.where(mix.cast("double") / F.lit(2.0**64) + 0.5 < share).select("id", "text", "y", mix.alias("mix")))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy("mix", "id", "text").rowsBetween(Window.unboundedPreceding, -1))
    got = chosen.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.octet_length("text") <= bytes_per_class).select("id", "text", "y").toPandas().sort_values(["id", "y", "text"], kind="stable")
    return fit_texts(list(got["text"]), got["y"].to_numpy(), **options)


@dataclass
class _Bags:
    """Texts as words, words as features."""

    #: Of all words, one after the other, and how many each has.
    features: np.ndarray
    size: np.ndarray
    #: Of all texts, one after the other, and how many each has.
    words: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.begin, self.text_begin = np.cumsum(self.size) - self.size, np.cumsum(self.lengths) - self.lengths
        self.word = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.text = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)


def loss_and_gradients(bags: _Bags, y: np.ndarray, share: np.ndarray, table: np.ndarray, weight: np.ndarray, attention: np.ndarray, bias: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Cross entropy of the texts, each times its share, and its gradients by the four tensors."""
    difference = weight[1] - weight[0]
    score = np.add.reduceat((table @ difference)[bags.features], bags.begin)
    bound = np.tanh(np.add.reduceat((table @ attention)[bags.features], bags.begin) / bags.size / BOUND)
    factor = np.exp(BOUND * bound)
    total = np.add.reduceat((factor * bags.size)[bags.words], bags.text_begin)
    mean = np.add.reduceat((factor * score)[bags.words], bags.text_begin) / total
    logit = mean + bias[1] - bias[0]
    g = share * (1 / (1 + np.exp(-np.clip(logit, -700, 700))) - y)
    each = (g / total)[bags.text]
    by_score = factor * np.bincount(bags.words, each, len(bags.size))
    by_factor = by_score * score - factor * bags.size * np.bincount(bags.words, each * mean[bags.text], len(bags.size))
    by_factor *= (1 - bound**2) / bags.size
    by_score, by_factor = (np.bincount(bags.features, x[bags.word], len(table)) for x in (by_score, by_factor))
    toward = by_score @ table
    loss = float((share * (np.logaddexp(0, logit) - y * logit)).sum())
    return loss, [np.outer(by_score, difference) + np.outer(by_factor, attention), np.vstack([-toward, toward]), by_factor @ table, np.array([-g.sum(), g.sum()])]


def fit_texts(texts: list[str], labels: np.ndarray, *, buckets: int = 1 << 18, dim: int = 8, shortest: int = 3, longest: int = 6, rounds: int = 200, rate: float = 0.5, decay: float = 1e-3, least_texts: int = 3, seed: int = 7) -> BagModel:
    """Full-batch gradient steps with momentum and weight decay on embedding table, softmax weights,
    the words' weights and bias together. A step is scaled by the largest gradient of its tensor, so that features of few
    texts move little.

    Features in fewer than least_texts texts keep no vector: they would only memorise.
    """
    model = BagModel(buckets, shortest, longest, np.zeros(buckets), np.zeros(buckets), 0.0)
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t, longest)), np.int32) for t in texts]
    y = np.asarray(labels, float)
    some = [k for k, i in enumerate(ids) if len(i)]
    if not some or len(set(y[some])) < 2:  # nothing to tell apart
        model.bias = 4.0 if len(y) and y.mean() > 0.5 else -4.0
        return model
    ids, y = [ids[k] for k in some], y[some]
    flat, size = array("i"), np.zeros(len(number), np.int64)
    for k, w in enumerate(number):
        found = model.features(w)
        flat.extend(found)
        size[k] = len(found)
    number.clear()
    used, flat = np.unique(np.frombuffer(flat, np.int32), return_inverse=True)
    bags = _Bags(flat.astype(np.int32), size, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
    in_texts = np.zeros(len(used), np.int64)
    for i in ids:
        in_texts[np.unique(np.concatenate([bags.features[bags.begin[w] : bags.begin[w] + size[w]] for w in np.unique(i)]))] += 1
    common = (in_texts >= least_texts).astype(float)[:, None]
    rng = np.random.default_rng(seed)
    tensors = [common * rng.normal(0, 0.1, (len(used), dim)), rng.normal(0, 0.1, (2, dim)), np.zeros(dim), np.zeros(2)]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    moments: list = [[np.zeros_like(p), np.zeros(1)] for p in tensors]
    for step in range(1, rounds + 1):
        _, gradients = loss_and_gradients(bags, y, share, *tensors)
        gradients[0] *= common
        for p, grad, (m, v) in zip(tensors, gradients, moments, strict=True):
            m += 0.1 * (grad - m)
            np.maximum(0.99 * v, np.abs(grad).max(), out=v)
            p *= 1 - rate * decay * (p is tensors[0])
            p -= rate * (m / (1 - 0.9**step)) / (v + 1e-12)
    table, weight, attention, bias = tensors
    model.scores[used] = table @ (weight[1] - weight[0])
    model.weights[used] = table @ attention
    model.bias = float(bias[1] - bias[0])
    return model


def score(docs: DataFrame, model: BagModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then score double (0 to 1) and predicted int (score >= 0.5).

    A null or empty text gets the score of no words, the bias alone. Repeated rows get the same score
    each, other columns are ignored, an empty table gives an empty one. No shuffle.
    """
    held = shipped(docs.sparkSession, model)

    def make():
        m = held()
        features = WordFeatures(m.word_rows)

        def of(texts: list) -> list[tuple]:
            logits = np.array([m.logit(rows) for rows in features.rows([words_of(t, m.longest) for t in texts])])
            p = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
            return list(zip(p.tolist(), (p >= 0.5).astype(int).tolist(), strict=True))

        return of

    return map_texts(docs, keep, text_col, [("score", pa.float64(), "double"), ("predicted", pa.int32(), "int")], make)
