"""Training of the language model in tasks."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from pitloom.llm import langid


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(41)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 14)))
    made = [(k, " ".join(word("aeilmnorst" if k % 2 else "bdeghkuwyz") for _ in range(1500)), "ab"[k % 2]) for k in range(40)]
    return [*made, (40, "x" * 70 + " one", "b"), (41, None, "a"), (42, "lost words", None), (43, "12 ²", "c")]


def test_training_in_tasks_is_training_on_all_words(spark, rows):
    got = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7))
    counts = Counter((w, lang) for _, text, lang in rows if text and lang for t in text.split() for w in langid.stretches(t))
    words = sorted({w for w, _ in counts})
    weights = np.array([[counts[w, lang] for lang in "abc"] for w in words], float)
    pieces = {p: k for k, p in enumerate(langid.read_pieces(langid.DEFAULT_VOCABULARY))}
    model = langid.UnigramModel(["a", "b", "c"], pieces, np.full((len(pieces) + 1, 3), 1 / (len(pieces) + 1)))
    lattices = model.lattices(words)
    for _ in range(3):
        use = model.expected_counts(lattices, weights) + model.expected_counts_of_long(words, weights)
        model.probs = (use + 0.02) / (use.sum(axis=0) + 0.02 * len(use))
        model.probs[-1] = langid._UNSEEN
    assert got.langs == ["a", "b", "c"] and got.pieces == pieces
    np.testing.assert_allclose(got.probs, model.probs, rtol=1e-9)


def test_driver_holds_no_words_in_training(spark, rows):
    """The driver held a lattice for each of the 60,000 words."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    docs.count()
    tracemalloc.start()
    try:
        langid.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        docs.unpersist()
    assert peak < 25 << 20
