"""Conversation repair against a search over all edits, one conversation at a time."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitloom.llm import conversations as cv
from pitloom.llm.queries import op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos long"
GRAMMAR = re.compile("(s?(ua)+)?")
PREFIX = re.compile("(s?(ua)*u?)?")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        out += [(c, t, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def searched(rows):
    """Cheapest edits by Dijkstra over (cost, letters), with the grammar as a regular expression."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while heap:
        cost, letters, i, initials, lines = heapq.heappop(heap)
        tail = (i, initials[-1:], "s" in initials, len(initials) > 0)
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, letters, lines
        if tail in seen:
            continue
        seen.add(tail)
        options = [(5, "I", 0, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            options.append((2, "D", 1, None, None))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                options += [(more, "K", 1, role, f"{role}:{text}")] + [(1 + more, "R", 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for price, letter, step, role, line in options:
            now = initials if role is None else initials + role[:1]
            if role is None or role and PREFIX.fullmatch(now):
                heapq.heappush(heap, (cost + price, letters + letter, i + step, now, lines if line is None else (*lines, line)))


def expected(source, rows):
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role, text))
    out = {}
    for c in {r[0] for r in source}:
        mine, seen = [], set()
        count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        turns = [t for there, t, *_ in groups[c] if there]
        for _, _, role, text in sorted(groups[c]):
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            mine.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, lines = searched(mine)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def made(seed, n=60, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        texts = ["Yes.", "no", "Why?", "", " \n", "é!", None, "Well. ", "a.b", "cut"]
        for t in range(rng.randint(0, longest)):
            turn = rng.choice([t, t, t, t + 1, None])
            rows.append((c if rng.random() < 0.97 else None, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umbrella"]), rng.choice(texts)))
    return rows


def found(spark, rows, **options):
    reports, repaired = cv.repair(rows, **options)
    joined = reports.join(cv.hashes(repaired), "key", "left")
    return {r.key: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256 or hashlib.sha256(b"").hexdigest()) for r in joined.collect()}


def test_every_conversation_against_a_search(spark, tmp_path):
    rows = made(1)
    of(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows, damaged(rows))
    assert None in got and any("R" in v[6] for v in got.values())


def test_rows_of_conversations_that_span_chunks(spark):
    """Chunks of four rows and nodes of two give trees of several levels; one conversation holds most rows."""
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"Text {t}.", "same.", "cut", ""])) for t in range(400)] + made(3, n=10)
    want = {cv_key(c): v for c, v in expected(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]).items()}
    assert found(spark, of(spark, rows).repartition(5), chunk_bits=2, fan_bits=1) == want
    assert found(spark, of(spark, rows)) == want


def cv_key(c):
    return "" if c is None else f"={c}"


def test_equal_rows_of_one_turn_are_dealt_out(spark):
    same = spark.range(30_000).selectExpr("1L as conv_id", "5L as turn", "'user' as role", "'Again.' as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would go to one task
    try:
        placed = cv.in_order(same.repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("pos", 33)).count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 15_000
    assert cv.faults(placed).where("fault = 0").count() == 1


def test_matrices_agree_with_walks():
    rng = np.random.default_rng(4)
    for _ in range(50):
        codes = rng.integers(0, 16, rng.integers(1, 30)).tolist()
        whole = reduce(cv._product, [cv.chunk_costs(codes[:k]) for k in (len(codes),)])
        forward, backward = cv.both_costs(codes, [0, *[cv._NEVER] * 3], cv._END)
        total = min(f + b for f, b in zip(forward[0], backward[0], strict=True))
        assert total == min(int(whole[0, q]) + cv._END[q] for q in range(4))
        assert all(min(f + b for f, b in zip(x, y, strict=True)) == total for x, y in zip(forward, backward, strict=True))
        letters, state, _ = cv.walk(codes, forward, backward, 0, True)
        assert state in (0, 3) and len(letters.replace("I", "")) == len(codes)


def test_fixed_cases(spark):
    cases = {
        1: ([("user", "Hi."), ("assistant", "Yes.")], 0, "KK"), 2: ([("assistant", "Yes.")], 2, "D"), 3: ([("user", "Hi."), ("user", "Ho."), ("assistant", "Yes.")], 2, "DKK"), 4: ([("user", "Hi."), ("user", "Hi."), ("assistant", "Y!")], 2, "KDK"),
        5: ([("system", "Be."), ("user", "cut"), ("assistant", "Y.")], 3, "RDK"), 6: ([("tool", "A."), ("bot", "B?")], 2, "RR"), 7: ([("system", "S.")], 2, "D"),
    }
    rows = [(c, t, r, x) for c, (turns, _, _) in cases.items() for t, (r, x) in enumerate(turns)]
    got = found(spark, of(spark, rows))
    assert {k: (v[5], v[6]) for k, v in got.items()} == {cv_key(c): (cost, audit) for c, (_, cost, audit) in cases.items()}


def test_long_texts_and_empty_tables(spark):
    long = "word " * 200_000
    got = found(spark, of(spark, [(1, 1, "user", long + "." + " " * 100_000), (1, 2, "assistant", long)]))
    assert got["=1"][:6] == (0, 0, 0, 1, 0, 4)
    assert found(spark, of(spark, [])) == {}


@pytest.mark.parametrize("codes", [[], [3], [4, 8, 12]])
def test_rows_that_can_only_go(codes):
    forward, backward = cv.both_costs(codes, [0, *[cv._NEVER] * 3], cv._END)
    assert cv.walk(codes, forward, backward, 0, True)[0] == "D" * len(codes)
