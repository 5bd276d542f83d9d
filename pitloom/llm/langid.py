"""Language identification with segmentation-marginalised unigrams.

Each language has its own probabilities over the pieces of one fixed public vocabulary. A word's
likelihood is the sum over all its segmentations into pieces, found by the forward algorithm; the
probabilities come from expectation-maximisation over the same lattices (forward-backward).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .words import WordFeatures, map_texts, shipped, text_rows

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"
#: Runs of letters up to this length share lattices with others of their length; each longer one is summed by itself, in logarithms.
_SHARED = 24
_UNSEEN = 1e-7
#: Words times languages whose lattices a task holds at a time, about.
_AT_ONCE = 100_000


def read_pieces(path: str) -> list[str]:
    """All pieces of a sentencepiece model that are letters only, lower-cased, without duplicates, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = dict.fromkeys(model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return [p for p in pieces if _LETTERS.fullmatch(p.removeprefix(_START)) or p == _START]


def stretches(token: str) -> list[str]:
    """The lattices' inputs for one white-space token: its runs of letters, lower-cased, whole."""
    token = token.lower()
    if not token.isalpha():  # numerals such as ² are word characters, but no letters
        token = "".join(c if c.isalpha() else " " for c in token)
    return [_START + run for run in _LETTERS.findall(token)]


@dataclass
class Lattices:
    """Stretches of one length n; ids[w, c] is the piece of stretch w from spans[c][0] to spans[c][1], or
    -1 if the vocabulary has none. Spans are in order of their ends."""

    which: np.ndarray
    n: int
    spans: list[tuple[int, int]]
    ids: np.ndarray


@dataclass
class UnigramModel:
    langs: list[str]
    pieces: dict[str, int]
    #: One row for each piece, then the row of an unknown letter; one column for each language.
    probs: np.ndarray

    def lattices(self, words: list[str]) -> list[Lattices]:
        """Of the words that share them."""
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) <= _SHARED:
                by_length.setdefault(len(w), []).append(k)
        get, longest, out = self.pieces.get, max(map(len, self.pieces), default=1), []
        for n, which in by_length.items():
            spans = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - longest), j)]
            ids = np.fromiter((get(w[i:j], -1) for w in map(words.__getitem__, which) for i, j in spans), np.int32, len(which) * len(spans)).reshape(len(which), len(spans))
            for c, (i, j) in enumerate(spans):
                if j - i == 1:  # a single letter always has a piece
                    ids[:, c][ids[:, c] < 0] = len(self.pieces)
            out.append(Lattices(np.array(which), n, spans, ids))
        return out

    def _padded(self) -> np.ndarray:
        return np.vstack([self.probs, np.zeros(len(self.langs))])  # -1 finds the last row

    def forward(self, lat: Lattices, padded: np.ndarray) -> np.ndarray:
        """alpha[j]: for each stretch and language, the summed probability of all segmentations of the first j letters."""
        alpha = np.zeros((lat.n + 1, len(lat.which), len(self.langs)))
        alpha[0] = 1
        for c, (i, j) in enumerate(lat.spans):
            alpha[j] += alpha[i] * padded[lat.ids[:, c]]
        return alpha

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        out, padded = np.zeros((len(words), len(self.langs))), self._padded()
        for at in range(0, len(words), 20_000):
            for lat in self.lattices(words[at : at + 20_000]):
                out[at + lat.which] = np.log(np.maximum(self.forward(lat, padded)[-1], 1e-300))
        with np.errstate(divide="ignore"):
            logs = np.log(padded)
        for k, w in enumerate(words):
            if len(w) > _SHARED:
                sums = None
                for at in range(0, len(w), 1 << 16):  # a part of the word at a time
                    sums = self._sums(self._ids(w, at, min(len(w), at + (1 << 16))), logs, sums)
                out[k] = np.maximum(sums[-1], -690.0 * len(w))
        return out

    def _ids(self, word: str, low: int = 0, high: int | None = None) -> np.ndarray:
        """[j, k]: the piece that ends after letter low + j and has k + 1 letters, or -1."""
        get, longest, high = self.pieces.get, max(map(len, self.pieces), default=1), len(word) if high is None else high
        ids = np.fromiter((get(word[j - k : j + 1], -1) if k <= j else -1 for j in range(low, high) for k in range(longest)), np.int32, (high - low) * longest).reshape(high - low, longest)
        ids[:, 0][ids[:, 0] < 0] = len(self.pieces)  # a single letter always has a piece
        return ids

    def _sums(self, ids: np.ndarray, logs: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each number of letters from 0 (or from the end of the part before), the logarithm of the summed probability of all segmentations of so many, by language."""
        n, longest = ids.shape
        sums = np.full((n + longest, len(self.langs)), -np.inf)  # row longest - 1 is no letters
        sums[longest - 1] = 0
        if before is not None:
            sums[longest - min(longest, len(before)) : longest] = before[-longest:]
        for j in range(n):
            sums[j + longest] = np.logaddexp.reduce(sums[j : j + longest][::-1] + logs[ids[j]], axis=0)
        return sums[longest - 1 :]

    def _long_counts(self, word: str, weight: np.ndarray, logs: np.ndarray, total: np.ndarray) -> None:
        """Adds the expected uses of pieces in one long word."""
        ids = self._ids(word)
        n, longest = ids.shape
        forward = self._sums(ids, logs)
        back = np.full((n + longest, len(self.langs)), -np.inf)
        back[n] = 0
        for i in range(n - 1, -1, -1):  # pieces that begin at letter i end after letter i + k
            k = np.arange(min(longest, n - i))
            back[i] = np.logaddexp.reduce(back[i + 1 + k] + logs[ids[i + k, k]], axis=0)
        for k in range(longest):
            j = np.arange(k, n)
            some = j[ids[j, k] >= 0]
            use = np.exp(forward[some - k] + logs[ids[some, k]] + back[some + 1] - forward[-1]) * weight
            np.add.at(total, ids[some, k], np.nan_to_num(use))

    def token_scores(self, tokens: list[str], seen: WordFeatures | None = None) -> np.ndarray:
        """For each token, the log-likelihoods by language and the number of its letters."""
        runs = [stretches(t) for t in tokens]
        flat = [w for r in runs for w in r]
        if seen:
            scores = seen.rows([flat])[0]
        else:
            scores = self.log_likelihoods(flat)
        owner = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, runs), np.int64, len(runs)))
        out = np.zeros((len(tokens), len(self.langs) + 1))
        np.add.at(out, owner, np.column_stack([scores.reshape(len(flat), len(self.langs)), np.fromiter(map(len, flat), float, len(flat))]))
        return out

    def expected_counts(self, lattices: list[Lattices], weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language; weights: count of each stretch by language."""
        padded, size = self._padded(), len(self.probs)
        total = np.zeros_like(self.probs)
        for lat in lattices:
            alpha = self.forward(lat, padded)
            beta = np.zeros_like(alpha)
            beta[-1] = weights[lat.which] / np.maximum(alpha[-1], 1e-300)
            pieces, uses = [], []
            for c in range(len(lat.spans) - 1, -1, -1):
                i, j = lat.spans[c]
                ok = np.flatnonzero(lat.ids[:, c] >= 0)
                ids = lat.ids[ok, c]
                use = padded[ids] * beta[j, ok]
                beta[i, ok] += use
                use *= alpha[i, ok]
                pieces.append(ids)
                uses.append(use)
            ids, use = np.concatenate(pieces), np.concatenate(uses)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(ids, use[:, k], size)
        return total

    def expected_counts_of_long(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """The same for the words that share no lattice."""
        total = np.zeros_like(self.probs)
        with np.errstate(divide="ignore"):
            logs = np.log(self._padded())
        for k, w in enumerate(words):
            if len(w) > _SHARED:
                self._long_counts(w, weights[k], logs, total)
        return total


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = DEFAULT_VOCABULARY, rows_per_lang: int = 1000, max_langs: int = 512, rounds: int = 3) -> UnigramModel:
    """Fit on a bounded sample: about rows_per_lang rows of each language, chosen by a hash of the id.

    Rows with a null text or language are left out. The sample's words are counted by Spark and written once; each round of expectation-maximisation
    goes over them in tasks. What reaches the driver is bounded by pieces * number of languages (at most max_langs), however many words there are.
    """
    train = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(sizes)
    if not langs:
        return UnigramModel([], {}, np.zeros((1, 0)))
    share: Column = reduce(lambda c, lang: c.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_lang / sizes[lang]))), langs[1:], F.when(F.col("lang") == langs[0], F.lit(min(1.0, rows_per_lang / sizes[langs[0]]))))
    chosen = train.where(F.xxhash64("id").cast("double") / F.lit(2.0**64) + 0.5 < share)
    known = {p: k for k, p in enumerate(read_pieces(vocabulary))}
    model = UnigramModel(langs, known, np.full((len(known) + 1, len(langs)), 1 / (len(known) + 1)))
    words = materialize(word_counts(chosen, langs))
    for _ in range(rounds):
        use = np.zeros_like(model.probs)
        found = expected_uses(words, model).toPandas()
        use[found["piece"], found["lang"]] = found["use"]
        model.probs = (use + 0.02) / (use.sum(axis=0) + 0.02 * len(use))
        model.probs[-1] = _UNSEEN
    return model


def word_counts(texts: DataFrame, langs: list[str]) -> DataFrame:
    """word (a stretch of letters), uses: its count in each language that has it, as (lang, n) with the language's place in langs. texts: text, lang."""
    column = {lang: k for k, lang in enumerate(langs)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for texts, langs in text_rows(batch, "text", "lang"):
                for text, lang in zip(texts, langs, strict=True):
                    counts.setdefault(lang, Counter()).update(text.split())
        for lang, c in counts.items():
            runs: Counter = Counter()
            for token, n in c.items():
                for w in stretches(token):
                    runs[w] += n
            yield pa.RecordBatch.from_pydict({"lang": pa.array([column[lang]] * len(runs), pa.int32()), "word": pa.array(list(runs), pa.string()), "n": pa.array(list(runs.values()), pa.int64())})

    summed = texts.select("text", "lang").mapInArrow(counted, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return summed.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("uses")).sortWithinPartitions("word")


def expected_uses(words: DataFrame, model: UnigramModel) -> DataFrame:
    """piece, lang (their places in the model), use: expected uses of the pieces in all words, where there are any.

    Tasks add up what their words use; what the tasks found is added in ascending order, so that the sums don't hang on which ended first.
    """
    held = shipped(words.sparkSession, model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held()
        total, step = np.zeros_like(m.probs), max(1, _AT_ONCE // len(m.langs))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                some, lists = part.column("word").to_pylist(), part.column("uses")
                weights, uses = np.zeros((len(some), len(m.langs))), lists.flatten()
                weights[np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy()), uses.field("lang").to_numpy()] = uses.field("n").to_numpy()
                total += m.expected_counts(m.lattices(some), weights) + m.expected_counts_of_long(some, weights)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], names=["piece", "lang", "use"])

    found = words.mapInArrow(of, "piece int, lang int, use double")
    return found.groupBy("piece", "lang").agg(F.aggregate(F.sort_array(F.collect_list("use")), F.lit(0.0), lambda a, x: a + x).alias("use"))


def identify(docs: DataFrame, model: UnigramModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then lang_pred string and score double (the posterior, 0 to 1).

    Null texts, empty ones and those without letters get `und` and 0, as does every text if the
    model was fitted on no rows. Ties go to the language that sorts first. Other columns are ignored;
    repeated rows get the same answer each; an empty table gives an empty one. No shuffle.
    """
    held = shipped(docs.sparkSession, model)

    def make():
        m = held()
        runs = WordFeatures(m.log_likelihoods)
        tokens = WordFeatures(lambda fresh: m.token_scores(fresh, runs))

        def of(texts: list) -> list[tuple]:
            out = []
            for rows in tokens.rows([t.split() if t else [] for t in texts]):
                total = rows.sum(axis=0)
                if not m.langs or total[-1] == 0:
                    out.append(("und", 0.0))
                    continue
                best = int(total[:-1].argmax())
                out.append((m.langs[best], float(1 / np.exp(total[:-1] - total[best]).sum())))
            return out

        return of

    return map_texts(docs, keep, text_col, [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double")], make)
