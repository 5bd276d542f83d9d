"""The toxicity model against finite differences and against a direct evaluation of its definition."""

import numpy as np

from pitloom.llm import toxicity


def _small(seed=3):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 5, 9)
    lengths = rng.integers(1, 8, 6)
    bags = toxicity._Bags(rng.integers(0, 12, size.sum()), size, rng.integers(0, 9, lengths.sum()), lengths)
    y = np.array([0, 1, 1, 0, 1, 0], float)
    return bags, y, rng.random(6), [rng.normal(0, 1, shape) for shape in ((12, 3), (2, 3), (3,), (2,))]


def test_gradients_against_finite_differences():
    bags, y, share, tensors = _small()
    _, gradients = toxicity.loss_and_gradients(bags, y, share, *tensors)
    for tensor, gradient in zip(tensors, gradients, strict=True):
        for at in np.ndindex(tensor.shape):
            kept, ends = tensor[at], []
            for step in (1e-5, -1e-5):
                tensor[at] = kept + step
                ends.append(toxicity.loss_and_gradients(bags, y, share, *tensors)[0])
            tensor[at] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - gradient[at]) < 1e-7


def test_scores_against_a_direct_evaluation():
    texts = ["you are awful awful", "a fine day it is", "awfully fine!", "such a day", "awful", "fine"] * 3
    model = toxicity.fit_texts(texts, np.array([1, 0, 1, 0, 1, 0] * 3), rounds=20)
    for text in [*texts[:6], "unseen wörds", "", "  ", "awful " + "fine day " * 500]:
        above = below = 0.0
        for word in text.lower().split():
            features = model.features(word)
            weight = np.exp(toxicity.BOUND * np.tanh(np.mean([model.weights[f] for f in features]) / toxicity.BOUND))
            above += weight * sum(model.scores[f] for f in features)
            below += weight * len(features)
        want = model.bias + (above / below if below else 0.0)
        assert abs(model.logit(model.word_rows(toxicity.words_of(text, model.longest))) - want) < 1e-9


def test_one_insult_in_a_long_text():
    rng = np.random.default_rng(4)
    plain = [f"word{k}" for k in range(300)]
    clean = [" ".join(rng.choice(plain, 60)) for _ in range(200)]
    toxic = [f"{t} you horrible scumbag" for t in clean[:60]]
    model = toxicity.fit_texts(clean + toxic, np.array([0] * 200 + [1] * 60))
    long = [" ".join(rng.choice(plain, 2000)) for _ in range(10)]
    of = lambda t: model.logit(model.word_rows(toxicity.words_of(t, model.longest)))
    assert all(of(t) < 0 < of(f"{t} you horible scumbags {t}") for t in long)
