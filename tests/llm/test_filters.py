"""The filter audit against a direct simulation of every order."""

import re
from collections import Counter
from itertools import permutations

import pytest

from pitloom.llm import filters

SCHEMA = "doc_id long, text string, source string, n long, part string, digest string"
LONG = " ".join(f"w{k}" for k in range(60))


def fails_of(text: str, doc_id, rows) -> dict[str, bool]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows),
    }


def simulated(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = [(source or "", fails_of(text or "", i, rows), i in good, i in toxic) for i, text, source, *_ in rows]
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                alone = sum(d[1][x] and sum(d[1].values()) == 1 for d in mine)
                out[part, order, step] = [len(left), len(gone), sum(d[1][x] for d in mine) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, x] += len(gone)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, LONG + " $", "a"), (4, None, "a"), (5, "", None), (6, "SHOUT " * 70, "a"), (7, "x y " * 40, "b"), (None, LONG, "a"), (None, "", ""),
    (8, LONG.upper(), None), (9, "short &", "b"), (1, "another text of an id that repeats", "a"), (10, "\x85".join(f"v{k}" for k in range(80)), "c"), (11, "ä" * 300_000, "c"), (12, "ä" * 300_000, "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (6, 1, 1), (7, 0, 1), (None, 1, 1), (12, 1, 0), (99, 1, 1)]


def test_every_order_and_step(spark):
    docs = spark.createDataFrame([(*r, 5, "other", "z") for r in ROWS], SCHEMA)
    labels = spark.createDataFrame([(*r, "b") for r in LABELS], "doc_id long, quality int, toxic int, source string")
    found = filters.audit(filters.measured(docs, labels))
    assert {tuple(r) for r in found.collect()} == simulated(ROWS, LABELS)
    assert dict(found.dtypes)["step"] == "int" and found.count() == 4 * 600


def test_states_are_shared_and_released(spark):
    """All 120 orders come from 32 states, on whose survivors removals are counted."""
    rows = filters.measured(spark.createDataFrame([(*r, 5, "", "") for r in ROWS], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    seen, held = {}, spark.sparkContext._jsc.getPersistentRDDs().size()
    made = filters.walk(rows, filters.filters(), lambda state, edges: seen.setdefault(state, edges.agg({"present": "sum"}).first()[0]))
    assert made == 32 and sorted(seen) == list(range(32))
    assert seen[0] == len(ROWS) and all(seen[s | 1 << k] is None or seen[s | 1 << k] <= seen[s] for s in seen for k in range(5))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filters.audit(filters.measured(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_a_group_of_copies_is_dealt_out(spark):
    """The copies of one text aren't joined by their text alone."""
    docs = spark.range(20_000).selectExpr("id as doc_id", f"if(id % 3 = 0, '{LONG}', concat('{LONG} ', id)) as text", "'s' as source")
    rows = filters.measured(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert rows.where("copied").selectExpr("sum(n)").first()[0] == 6666


@pytest.mark.parametrize("text", ["", "A", "a b a b", "Ab#", "é É", "\x0b\x0c\x1c\x85", "　 x"])
def test_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n_words, distinct, upper, chars, symbol, _ = filters.measures(text)
    assert (n_words, distinct, upper, chars, symbol) == (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), bool(re.search("[#$%&*|]", text)))
