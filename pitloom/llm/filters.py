"""Audit of how quality filters interact, by permutation-trie execution.

The orders in which filters can run form a trie. It is walked depth first: a filter is applied to the persisted survivors of the state above, and
what it removes is counted on them. A state depends on the set of filters that ran, not on their order, so each of the 2^k sets is made once and all orders
that lead to it share it. A state's survivors are released when the states below it are done, so at most k + 1 are held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from itertools import permutations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, scratch_dir
from .words import map_texts

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = re.compile(r"[#$%&*|]")


def measures(text: str | None) -> tuple[int, int, int, int, bool, bytes]:
    """Words, distinct words, capitals A to Z, code points, whether a symbol occurs, and SHA-256. A null text is an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    return len(words), len(set(words)), len(raw) - len(raw.translate(None, _UPPER)), len(text), _SYMBOLS.search(text) is not None, hashlib.sha256(raw).digest()


_MEASURES = [("n_words", pa.int64(), "long"), ("n_distinct", pa.int64(), "long"), ("n_upper", pa.int64(), "long"), ("n_chars", pa.int64(), "long"), ("has_symbol", pa.bool_(), "boolean"), ("digest", pa.binary(), "binary")]


def filters() -> dict[str, Column]:
    """The failure conditions over measured rows, by letter. E needs the table: `copied` is true where a smaller id has the same text."""
    return {
        "A": F.col("n_words") < 50,
        "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"),
        "C": 100 * F.col("n_upper") > 5 * F.col("n_chars"),
        "D": F.col("has_symbol"),
        "E": F.col("copied"),
    }


def measured(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, the measures of the text, copied, good, toxic, n (equal rows), written as a table.

    Texts are read once and not shuffled. The first holder of a text is found by its smallest id; a join on (text, id) marks it, so that no
    group of copies meets in a task. Equal rows count as one row with a number. A null part is the empty string; a null id is no smaller than
    any and has no label; a document is good (toxic) if any of its labels says so.
    """
    found = map_texts(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text")), ("id", "part"), "text", _MEASURES, lambda: lambda texts: [measures(t) for t in texts])
    of_text = [name for name, _, _ in _MEASURES if name != "digest"]
    rows = materialize(found.groupBy("id", "part", "digest").agg(*(F.first(c).alias(c) for c in of_text), F.count(F.lit(1)).alias("n")))
    firsts = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    whole = rows.join(firsts, ["digest", "id"], "left").join(named, "id", "left")
    no = F.lit(False)
    return materialize(whole.select("part", *of_text, (F.col("id").isNotNull() & F.col("is_first").isNull()).alias("copied"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n"))


def _edges(survivors: DataFrame, left: dict[str, Column]) -> DataFrame:
    """part, present, and for each filter that hasn't run: what it removes here."""
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = [f for letter, fails in left.items() for f in (n(fails).alias(f"removed_{letter}"), n(fails & F.col("good")).alias(f"good_{letter}"), n(fails & F.col("toxic")).alias(f"toxic_{letter}"))]
    return survivors.groupBy("part").agg(F.sum("n").alias("present"), *counts)


def walk(rows: DataFrame, failing: dict[str, Column], found: Callable[[int, DataFrame], None]) -> int:
    """Depth-first over the trie; found(state, edges) is called once for each set of filters (bit k: the k-th has run), with its counts by part still
    to be computed. Returns the number of states made."""
    letters = list(failing)
    done: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        done.add(state)
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = {x: failing[x] for k, x in enumerate(letters) if not state >> k & 1}
        found(state, _edges(held, left))
        for k, x in enumerate(letters):
            if x in left and state | 1 << k not in done:
                visit(state | 1 << k, held.where(~F.coalesce(failing[x], F.lit(False))))
        held.unpersist()

    visit(0, rows)
    return len(done)


def audit(rows: DataFrame, failing: dict[str, Column] | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for every part, order of
    the filters and step. An empty table gives an empty one.

    rows: part, good, toxic, n and what the conditions mention (see measured). Counts are those of the trie's edges, written to the shared folder
    state by state; what is kept is counted on the next state's survivors. shapley is the sum over all orders, not their mean.
    """
    failing = failing or filters()
    letters = list(failing)
    folder = scratch_dir(rows.sparkSession)
    zeros = [f"{what}_{x}" for x in letters for what in ("removed", "good", "toxic")]

    def write(state: int, edges: DataFrame) -> None:
        # one layout for all states: what has run already removes nothing
        edges.select("part", "present", *(F.col(c) if c in edges.columns else F.lit(0).cast("long").alias(c) for c in zeros)).write.parquet(f"{folder}/state={state}")

    states = walk(rows, failing, write)
    spark = rows.sparkSession
    counts = spark.read.schema("part string, present long, " + ", ".join(f"{c} long" for c in zeros) + ", state int").parquet(folder)
    assert states == 1 << len(letters)
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("letter"), *(F.col(f"{what}_{x}").alias(what) for what in ("removed", "good", "toxic"))) for x in letters)))
    edges = counts.select("part", "state", each.alias("e")).select("part", "state", "e.*")
    whole = counts.where("state = 0")
    parts = whole.select("part")
    totals = edges.where("state = 0").select("part", "letter", F.col("removed").alias("fails"))
    alone = F.coalesce(*(F.when(F.col("letter") == x, F.lit((1 << len(letters)) - 1 - (1 << k))) for k, x in enumerate(letters)))
    unique = edges.where(F.col("state") == alone).select("part", "letter", F.col("removed").alias("unique_fails"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters))))
    steps = parts.select("part", orders.alias("filter_order")).select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), F.lit(1 << k)).otherwise(0) for k, x in enumerate(letters)), F.lit(0))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    after = sum((F.when(F.instr("filter_order", x) <= F.col("step"), F.lit(1 << k)).otherwise(0) for k, x in enumerate(letters)), F.lit(0))
    steps = steps.select("part", "filter_order", "step", before.cast("int").alias("state"), after.cast("int").alias("next"), letter.alias("letter"))
    met = steps.join(edges, ["part", "state", "letter"], "left").join(counts.select("part", F.col("state").alias("next"), F.col("present").alias("kept")), ["part", "next"], "left")
    met = met.join(totals, ["part", "letter"], "left").join(unique, ["part", "letter"], "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows_ = met.select("part", "filter_order", "step", "letter", number("kept").alias("kept"), number("removed").alias("removed"), (number("fails") - number("removed")).alias("redundant"), number("unique_fails").alias("unique_fails"), number("good").alias("good_lost"), number("toxic").alias("toxic_lost"))
    shapley = rows_.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows_.join(shapley, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

