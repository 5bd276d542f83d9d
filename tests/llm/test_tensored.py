"""Near-duplicates against brute force over all pairs of sets."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitloom.llm import tensored

DOCS = "doc_id long, text string, id string, n long, digest string, key string"


def set_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words[i : i + 3]) for i in range(len(words) - 2)] or ([tuple(words)] if words else []))


def brute(rows, percent=85):
    """(doc_id, n, component_id, kept) of all rows: links between rows, names by search."""
    sets = [set_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[top(i)] = top(j)
    names = {}
    for k, (i, _) in enumerate(rows):
        names.setdefault(top(k), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in names.items()}
    return sorted(((i, len(sets[k]), c := least[top(k)] if sets[k] else i, i is not None and i == c) for k, (i, _) in enumerate(rows)), key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def rows_of(seed, families=25):
    rng = random.Random(seed)
    pool = [f"w{k}é" if k % 5 == 0 else f"W{k}" for k in range(400)]
    out = []
    for _ in range(families):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 150))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            out.append(rng.choice([" ", "\n", "\t  "]).join(edited(rng, words, rng.randint(0, max(1, len(words) // 15)))))
    out += [out[3], out[3].lower(), "", None, " \t", "one", "One", "one two", "two one", "a b c a b c a b c"]
    rng.shuffle(out)
    return [(k if rng.random() < 0.95 else rng.choice([None, 1]), t) for k, t in enumerate(out)]


def found(spark, rows, parts=3, **options):
    docs = spark.createDataFrame([(i, t, "x", 9, "y", "z") for i, t in rows], DOCS).repartition(parts)
    return sorted((tuple(r) for r in tensored.near_duplicates(docs, **options).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = rows_of(seed)
    want = brute(rows)
    assert found(spark, rows) == want
    assert len({c for _, _, c, _ in want}) < len(rows) - 20


def test_large_keys_in_blocks_agree(spark):
    """Families that share most of a frame, so that keys hold several components; with `small` 2 keys go to blocks."""
    rng = random.Random(5)
    frame = [f"f{k}" for k in range(90)]
    rows = []
    for family in range(12):
        body = frame + [f"b{family}_{k}" for k in range(18)]
        rows += [(len(rows) + k, " ".join(edited(rng, body, k % 3))) for k in range(5)]
    want = brute(rows)
    assert 1 < len({c for _, _, c, _ in want}) < len(rows)
    assert found(spark, rows, small=2) == found(spark, rows) == want


def test_the_threshold_is_exact():
    """17 of 20 shingles is alike, 16 of 20 isn't, whatever side is larger."""
    a = np.arange(20, dtype=np.uint64)
    for size, yes in ((17, True), (16, False)):
        b = a[:size]
        assert tensored.alike(a, b, 85) == tensored.alike(b, a, 85) == yes
        block = pd.DataFrame({"digest": [b"a", b"b"], "component": [b"a", b"b"], "side": [0, 1], "hashes": [a.view(np.int64), b.view(np.int64)]})
        assert len(tensored.block_links(block, 85)) == yes


def test_sets_and_bands():
    sets = tensored.ShingleSets(3)
    texts = ["a b c a b c", "A B C A B C", "a b", "b a", "a", "", None, "a b c d", "x\x0by\x1cz w"]
    got = sets.of(texts)
    assert [len(x) for x in got] == [len(set_of(t)) for t in texts]
    assert (got[0] == got[1]).all() and got[2] != got[3]
    # what pairs of hashes bring together at the threshold, by the number of minhashes that were computed
    rng = np.random.default_rng(1)
    halves, met = tensored.Halves(), 0
    for _ in range(200):
        a = rng.integers(0, 2**63, 370).astype(np.uint64)
        b = np.concatenate([a[:340], rng.integers(0, 2**63, 30).astype(np.uint64)])
        x, y = halves.of(a), halves.of(b)
        met += bool((x[:12] == y[:12]).any() and (x[12:] == y[12:]).any())
    assert met == 200 and len(halves._salt) == 72


def test_a_large_group_of_copies(spark):
    """Copies of one text are one set; near copies of another are compared with one text, not with each other."""
    base = " ".join(f"n{k}" for k in range(200))
    rows = [(k, "the same words in every row of this group") for k in range(3000)] + [(3000 + k, base.replace(f"n{k} ", f"m{k} ")) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = tensored.near_duplicates(docs).groupBy("component_id").count().collect()
    assert {(r.component_id, r["count"]) for r in got} == {(0, 3000), (3000, 150)}
    made = tensored.sketches(docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("text_hash")), 3)
    assert made.select("digest").distinct().count() == 151


def test_long_texts_and_empty_tables(spark):
    long = " ".join(f"t{k}" for k in range(150_000))
    got = found(spark, [(1, long), (2, long + " end"), (3, "x" * 3_000_000), (4, "x y")])
    assert [r[2] for r in got] == [1, 1, 3, 4]
    assert found(spark, []) == []


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(found.apply(k).shuffleWriteBytes() for k in range(found.size()))


def test_texts_without_candidates_are_not_shuffled(spark):
    """All texts used to be shuffled to find those that have candidates."""
    rng = random.Random(43)
    lone = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(2000))) for k in range(300)]
    base = lone[7][1].split()
    rows = [*lone, (300, lone[7][1]), (None, " ".join([*base[:-3], "a", "b", "c"])), (7, lone[7][1]), (7, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    before = shuffled_bytes(spark)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were too many candidates
    try:
        got = sorted((tuple(r) for r in tensored.near_duplicates(docs).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == brute(rows)
    assert shuffled_bytes(spark) - before < sum(len(t) for _, t in rows) / 4


@pytest.mark.parametrize("most", [1 << 15, 1 << 28])
def test_chosen_texts_are_exact(spark, monkeypatch, most):
    """Whatever the filter of bits lets through."""
    monkeypatch.setattr(tensored, "MOST_BITS", most)
    ids = [None, *range(-20_000, 20_000)]
    texts = spark.createDataFrame([(i, 0 if i is None else i * 7919) for i in [*ids, None, 5, 6]], "id long, text_hash long").withColumn("text", F.lit("x"))
    reps = spark.createDataFrame([(0 if i is None else i * 7919, i) for i in ids if i is None or i % 5 == 0], "h long, i long")
    got = [r.id for r in tensored.chosen_texts(texts, reps).collect()]
    assert sorted(got, key=str) == sorted((i for i in ids if i is None or i % 5 == 0), key=str)
