"""Legal inputs that are long in one way or another: right results for all rows, in seconds."""

import random
import time

import numpy as np
import pytest

import corpus_pipeline
from pitloom.llm import decontaminate, html, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def encoding():
    return packing.read_encoding(packing.DEFAULT_VOCABULARY)


def test_runs_of_white_space_are_counted_as_the_pattern_does(encoding):
    for n in (1, 2, 9_999, 10_000, 10_001, 25_000):
        for white in (" ", "\n", "　", " \n", "\t "):
            for word in ("", "word", "é", "1", "!?"):
                chunk = (white * n)[:n] + word
                assert packing.tokens_of(encoding, chunk) == len(encoding.encode_ordinary(chunk)), (n, white, word)


def test_a_million_spaces(spark, encoding):
    """The other rows of the table are counted too."""
    texts = [" " * 1_000_000 + "word", "a" + "\n" * 2_000_000, "one two  three", None]
    began = time.monotonic()
    got = {r.doc_id: r.n_tokens for r in packing.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[2] == len(encoding.encode_ordinary(texts[2])) and got[3] == 0
    assert got[0] == len(encoding._encode_single_piece(" " * 999_999)) + 1 and got[1] == 1 + len(encoding._encode_single_piece("\n" * 2_000_000))
    assert time.monotonic() - began < 60


def test_the_pipeline_keeps_them(spark, tmp_path):
    words = [f"plain{k} words of an english text that are unlike those of the others number {k * 7}" for k in range(4)]
    texts = [words[0] + " " * 1_000_000 + "end", "\n" * 800_000 + words[1], words[2], words[3]]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that nothing here has in it at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {0, 1, 2, 3}


def test_stray_end_tags_take_no_longer_than_others():
    page = "<article><p>" + "Some text of the article that is long enough to be kept as it stands here. " * 3 + "</p></article>"
    for more in ("<div>" * 100_000 + "</td>" * 100_000, "<p><div>" + "<li>" * 100_000 + "</p>" * 100_000, "<div>" * 100_000 + "</div>" * 100_000):
        began = time.monotonic()
        found = html.blocks(page + more + page)
        assert time.monotonic() - began < 20
        assert [b.text.startswith("Some text") for b in found] == [True, True]


def _blocks_by_search(tags):
    """Open blocks after each tag, by looking through all of them for each end tag."""
    open_, out = [], []
    for tag in tags:
        if tag[0] == "/":
            for k in range(len(open_) - 1, -1, -1):
                if open_[k] == tag[1:]:
                    del open_[k:]
                    break
                if tag[1:] not in html._CONTAINERS and open_[k] in html._CONTAINERS:
                    break
        else:
            while open_ and open_[-1] not in html._CONTAINERS and (tag in html._CONTAINERS or open_[-1] in ("p", tag, *html._HEADINGS)):
                open_.pop()
            open_.append(tag)
        out.append(open_[-1] if open_ else "")
    return out


def test_wrong_tags_nest_as_by_search():
    rng = random.Random(1)
    names = [t for t in ("div", "p", "li", "ul", "td", "section", "h2", "blockquote", "main", "article") if t in html._BLOCKS]
    for _ in range(300):
        tags = [rng.choice(["", "/"]) + rng.choice(names) for _ in range(rng.randint(1, 50))]
        page = "".join(f"<{t}>w{k} " for k, t in enumerate(tags))
        assert [b.tag for b in html.blocks(page)] == _blocks_by_search(tags)


def test_hits_that_are_left_out_are_on_diagonals_of_others():
    """Of two or three words, so that nearly everything repeats."""
    rng = np.random.default_rng(5)
    for kinds in (1, 2, 3):
        texts = [rng.integers(1, kinds + 1, n).astype(np.uint64) for n in (40, 7, 0, 90)]
        items = [rng.integers(1, kinds + 1, n).astype(np.uint64) for n in (5, 13, 30, 21)] + [np.array([1, 2] * 8, np.uint64)]
        seeds = decontaminate.Seeds.of(np.arange(len(items)), items)
        words, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for salt, mask in seeds.masks():
            hashes = decontaminate.seed_hashes(words, mask, salt)
            row = np.searchsorted(first, np.arange(len(hashes)), "right") - 1
            want = {(int(row[a]), k, a - p) for k, t in enumerate(items) if (salt, mask) in decontaminate.masks_for(len(t)) for p, h in enumerate(decontaminate.seed_hashes(t, mask, salt)) for a in np.flatnonzero(hashes == h).tolist()}
            got = [(int(row[a]), int(i), int(a - p)) for block in seeds.hits(hashes, seeds.filter(), first) for a, i, p in zip(*block, strict=True)]
            assert set(got) == want


@pytest.mark.parametrize("size", [16 << 20, 0])
def test_a_million_equal_words(spark, size):
    """Against an item of a thousand of them; two words in turn; and the table's other rows."""
    some = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "ha " * 1_000_000), (2, "x " + some), (3, "ho hum " * 200_000), (4, "none of these")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "ha " * 1_000), (8, some), (9, "ho hum " * 300), (10, "ha ha ha ha ha ho")], "item_id long, text string")
    began = time.monotonic()
    got = {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_tokens, r.n_equal) for r in decontaminate.overlaps(docs, items, broadcast_bytes=size).collect()}
    assert got == {(1, 7): (0, 0, 1_000, 1_000), (1, 10): (0, 0, 6, 5), (2, 8): (1, 0, 40, 40), (3, 9): (0, 0, 600, 600)}
    assert time.monotonic() - began < 120


def test_the_best_of_diagonals_is_that_of_looking_at_all():
    rng = np.random.default_rng(6)
    for _ in range(300):
        doc, item = (rng.integers(0, rng.integers(1, 4), rng.integers(1, 60)).astype(np.uint64) for _ in range(2))
        diagonals = np.arange(-len(item) + 1, len(doc))
        rng.shuffle(diagonals)
        found = [(x[2], x[1], -(x[0] + int(d)), x[0]) for d in diagonals if (x := decontaminate.best_overlap(doc, item, int(d)))]
        assert decontaminate.best_of_diagonals(doc, item, diagonals) == max(found, default=None)
