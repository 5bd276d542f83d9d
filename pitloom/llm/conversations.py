"""Repair of conversations whose turns are lost, blank, repeated, cut off or by the wrong role.

A conversation's edits are paths through a graph: nodes are (place between rows, what the roles so far allow), arcs keep, rerole or delete the next row or insert one. Minimum
costs from the start and to the end, both ways, tell which arcs lie on a cheapest path; a walk over these tight arcs alone takes the least letter at each step.

A conversation may hold a large part of the table. Rows are put in order by ranges, not by conversation, and cut into chunks of at most 4,096; a chunk is a small matrix of
costs between the states at its ends. These matrices are combined in a tree, and the costs at each chunk's ends come back down it; so do the states through which the walk passes.
Every group that meets in a task is bounded. Only the hash of a whole conversation is one stream by definition: it is computed over sorted rows as they pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Costs of edits, and of leaving a truncated row in.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_WHITE = " \t\n\x0b\x0c\r"
_NEVER = 1 << 50
#: Initials of roles (3: any other), faults of rows.
_S, _U, _A = range(3)
_ROLE = {_U: "user", _A: "assistant"}
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
#: Role initials must give (s?(ua)+)?. States: nothing yet, after s, after u, after a. From a state and an initial to the next state.
_NEXT = ({_S: 1, _U: 2}, {_U: 2}, {_A: 3}, {_U: 2})
_FINAL = (0, 3)
#: Rows of a chunk and children of a node, as powers of two.
CHUNK_BITS, FAN_BITS = 12, 10


def _arcs(code: int) -> list[list[tuple[str, int, int, str | None]]]:
    """For each state: letter, next state, cost and new role of what can be done with a row. code: 4 x fault + initial."""
    initial, fault = code & 3, code >> 2
    out = []
    for state, allowed in enumerate(_NEXT):
        arcs = [("D", state, DELETE, None)]
        if fault not in (_BLANK, _DUPLICATE):
            more = TRUNCATED if fault == _TRUNCATED else 0
            if initial in allowed:
                arcs.append(("K", allowed[initial], KEEP + more, None))
            arcs += [("R", to, REROLE + more, _ROLE[x]) for x, to in allowed.items() if x in _ROLE]
        out.append(arcs)
    return out


_ROW_ARCS = [_arcs(code) for code in range(16)]
_INSERTS = [[("I", to, INSERT, _ROLE[x]) for x, to in allowed.items() if x in _ROLE] for allowed in _NEXT]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheapest ways through both (min-plus product of the last two axes)."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), _NEVER)


def _matrix(arcs) -> np.ndarray:
    out = np.full((4, 4), _NEVER, np.int64)
    for state, those in enumerate(arcs):
        for _, to, cost, _ in those:
            out[state, to] = min(out[state, to], cost)
    return out


_IDENTITY = np.where(np.eye(4, dtype=bool), 0, _NEVER).astype(np.int64)
#: Any number of inserted rows: four states need three steps at most.
_STAR = _product(_product(one := np.minimum(_IDENTITY, _matrix(_INSERTS)), one), one)
_THROUGH = np.array([_product(_STAR, _matrix(arcs)) for arcs in _ROW_ARCS])
_AHEAD = _THROUGH.tolist()
_END = [int(min(_STAR[q, x] for x in _FINAL)) for q in range(4)]


def chunk_costs(codes: Sequence[int]) -> np.ndarray:
    """4 x 4: the cheapest edits of these rows from each state to each."""
    found = _THROUGH[np.asarray(codes, np.int64)]
    while len(found) > 1:
        odd = found[-1:] if len(found) % 2 else found[:0]
        found = np.concatenate([_product(found[0 : len(found) - 1 : 2], found[1::2]), odd])
    return found[0] if len(found) else _IDENTITY


def both_costs(codes: Sequence[int], enter: Sequence[int], leave: Sequence[int]) -> tuple[list[list[int]], list[list[int]]]:
    """For each place: the least cost of reaching each state there from the start, and of the end from there."""
    at = list(enter)
    forward = [at]
    for code in codes:
        t = _AHEAD[code]
        at = [min(at[0] + t[0][q], at[1] + t[1][q], at[2] + t[2][q], at[3] + t[3][q], _NEVER) for q in range(4)]
        forward.append(at)
    star = _STAR.tolist()
    forward = [[min(v[p] + star[p][q] for p in range(4)) for q in range(4)] for v in forward]
    at = list(leave)
    backward = [at]
    for code in reversed(codes):
        at = [min(t[0] + at[0], t[1] + at[1], t[2] + at[2], t[3] + at[3], _NEVER) for t in _AHEAD[code]]
        backward.append(at)
    return forward, backward[::-1]


def walk(codes: Sequence[int], forward, backward, state: int, last: bool) -> tuple[str, int, list[tuple[int, str, str | None]]]:
    """Letters, the state at the end, and (row, letter, new role) of edits, along tight arcs from a state at the first row; inserted rows stand before the row of their number.
    `last`: no rows follow, so that rows may be inserted at the end.

    The walk holds the set of states that equal letters lead to. A state admits one new role and one initial for each letter, so the set never has more than one.
    """
    total = min(f + b for f, b in zip(forward[0], backward[0], strict=True))
    letters, edits, frontier, i, n = [], [], {state: None}, 0, len(codes)
    while i < n or last:
        ahead: dict[str, dict[int, str | None]] = {}
        for q in frontier:
            for letter, to, cost, role in _INSERTS[q]:
                if forward[i][q] + cost + backward[i][to] == total:
                    ahead.setdefault(letter, {}).setdefault(to, role)
            if i < n:
                for letter, to, cost, role in _ROW_ARCS[codes[i]][q]:
                    if forward[i][q] + cost + backward[i + 1][to] == total:
                        ahead.setdefault(letter, {}).setdefault(to, role)
        if not ahead:  # the end, or not on a cheapest path
            break
        letter = min(ahead)
        frontier = ahead[letter]
        letters.append(letter)
        edits.append((i, letter, next(iter(frontier.values()))))
        i += letter != "I"
    return "".join(letters), min(frontier) if i == n else -1, edits


# -- rows in order ----------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one fault for five of twenty rows, by the CRC-32 of conv_id:turn: lost, emptied, without its full stops, repeated, by the user.
    A null is one space; conv_id and turn stay null."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", written("role").alias("role"), written("text").alias("text"), fate.alias("fate")).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def key_of(conv_id) -> F.Column:
    """A name for each id, a null one too."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def in_order(rows: DataFrame) -> DataFrame:
    """key, pos, turn, role, text, digest, written as a table. pos grows along a conversation's rows by turn (nulls first), role, the first 64 characters and the SHA-256 of role and text.

    Rows are dealt out by ranges of that order and a number, so that neither a conversation nor equal rows of one turn need a task of their own; rows that differ in the
    number alone are equal.
    """
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = rows.select(key_of(F.col("conv_id")).alias("key"), "turn", "role", "text", F.left("text", F.lit(64)).alias("head"), digest.alias("digest"), F.monotonically_increasing_id().alias("salt"))
    order = ["key", "turn", "role", "head", "digest"]
    placed = keyed.repartitionByRange(*order, "salt").sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    return materialize(placed.select("key", "pos", "turn", "role", "text", "digest"))


def faults(placed: DataFrame) -> DataFrame:
    """key, pos, turn, initial (0 s, 1 u, 2 a, 3 any other or none), fault (0 none, 1 blank, 2 duplicate, 3 truncated): the first that a row has.

    Which of equal rows is the first is found by their least place and marked by a join on places, which are all different.
    """
    firsts = placed.groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    bare = F.rtrim("text", F.lit(_WHITE))
    initial = F.coalesce(*(F.when(F.left("role", F.lit(1)) == x, k) for k, x in enumerate("sua")), F.lit(3))
    rows = placed.select("key", "pos", "turn", initial.alias("initial"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ends"))
    fault = F.when(F.col("blank"), _BLANK).when(F.col("is_first").isNull(), _DUPLICATE).when(~F.col("ends"), _TRUNCATED).otherwise(0)
    return rows.join(firsts, "pos", "left").select("key", "pos", "turn", "initial", fault.alias("fault"))


# -- a scan over chunks -----------------------------------------------------------------------------------------------


def _rows(df: DataFrame, schema: str, of: Callable[[dict], list[dict]]) -> DataFrame:
    """Small rows from small rows; `of` makes them in the task."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = [x for row in batch.slice(at, 512).to_pylist() for x in of(row)]
                if out:
                    yield pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in out], schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(mapped, schema)


def scan(nodes: DataFrame, combine: Callable[[list], list], spread: Callable[[list, list, list], list], enter: list[int], leave: list[int], *, fan_bits: int = FAN_BITS) -> DataFrame:
    """key, node, enter, leave for each node: what comes from the nodes before it, and from those after.

    nodes: key, node (its place), element (numbers). combine(elements) is one element for all in order; spread(enter, leave, elements) gives the (enter, leave) of each. Nodes meet by
    2^fan_bits at most: while a key has more, their parents are made; then the way goes down again.
    """
    levels = []
    now = nodes
    while (now.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > 1 << fan_bits:
        lists = now.groupBy("key", F.shiftright("node", fan_bits).alias("node")).agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("child"), "element"))).alias("children"))
        lists = materialize(lists)
        levels.append(lists)
        now = materialize(_rows(lists, "key string, node long, element array<long>", lambda r: [{"key": r["key"], "node": r["node"], "element": combine([c["element"] for c in r["children"]])}]))
    schema = "key string, node long, enter array<long>, leave array<long>"

    def below(r: dict) -> list[dict]:
        ends = spread(r["enter"], r["leave"], [c["element"] for c in r["children"]])
        return [{"key": r["key"], "node": c["child"], "enter": a, "leave": b} for c, (a, b) in zip(r["children"], ends, strict=True)]

    top = now.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("child"), "element"))).alias("children"))
    numbers = lambda x: F.array(*(F.lit(v).cast("long") for v in x))
    out = _rows(top.select("key", "children", numbers(enter).alias("enter"), numbers(leave).alias("leave")), schema, below)
    for lists in reversed(levels):
        out = _rows(lists.join(out, ["key", "node"]).select("key", "children", "enter", "leave"), schema, below)
    return out


def _combine_costs(elements: list[list[int]]) -> list[int]:
    """An element: 16 costs, then the last row's initial."""
    found = np.array([e[:16] for e in elements], np.int64).reshape(-1, 4, 4)
    whole = found[0]
    for m in found[1:]:
        whole = _product(whole, m)
    return [*whole.ravel().tolist(), elements[-1][16]]


def _spread_costs(enter: list[int], leave: list[int], elements: list[list[int]]) -> list[tuple[list[int], list[int]]]:
    """enter: 4 costs from the start, then the initial before. leave: 4 costs to the end, then 1 if nothing follows."""
    found = [np.array(e[:16], np.int64).reshape(4, 4) for e in elements]
    ahead, before = [list(enter)], np.array(enter[:4], np.int64)
    for m, e in zip(found[:-1], elements[:-1], strict=True):
        before = np.minimum((before[:, None] + m).min(axis=0), _NEVER)
        ahead.append([*before.tolist(), e[16]])
    behind, after = [list(leave)], np.array(leave[:4], np.int64)
    for m in found[:0:-1]:
        after = np.minimum((m + after[None, :]).min(axis=1), _NEVER)
        behind.append([*after.tolist(), 0])
    return list(zip(ahead, behind[::-1], strict=True))


def _combine_states(elements: list[list[int]]) -> list[int]:
    """An element: the state at the end for each state at the start, -1 off the cheapest paths."""
    whole = list(range(4))
    for e in elements:
        whole = [e[q] if q >= 0 else -1 for q in whole]
    return whole


def _spread_states(enter: list[int], leave: list[int], elements: list[list[int]]) -> list[tuple[list[int], list[int]]]:
    at, out = enter[0], []
    for e in elements:
        out.append(([at], []))
        at = e[at]
    return out


# -- the whole repair -------------------------------------------------------------------------------------------------


def repair(rows: DataFrame, *, chunk_bits: int = CHUNK_BITS, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """Two tables. Reports: key, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation that has rows. Repaired rows: key, pos and sub (their order), edit
    (K, R or I), turn (NULL if inserted), role, text.

    rows: conv_id, turn, role, text; other columns are ignored. A null conv_id is a conversation of its own, null turns come first, a null role or text is one space. Rows with one turn
    stand by role and text. A role without characters has no initial: it can't be kept. An empty table gives empty ones.
    """
    space = F.lit(" ")
    placed = in_order(rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")))
    marked = materialize(faults(placed))
    n = lambda k: F.sum((F.col("fault") == k).cast("long"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = marked.groupBy("key").agg(gaps.alias("gaps"), n(_BLANK).alias("blank"), n(_DUPLICATE).alias("duplicate"), n(_TRUNCATED).alias("truncated"))
    entry = F.struct("pos", (F.col("fault") * 4 + F.col("initial")).alias("code"))
    chunks = marked.groupBy("key", F.shiftright("pos", chunk_bits).alias("node")).agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    chunks = materialize(chunks.select("key", "node", F.col("rows.pos").alias("places"), F.col("rows.code").alias("codes")))
    costs = _rows(chunks.select("key", "node", "codes"), "key string, node long, element array<long>", lambda r: [{"key": r["key"], "node": r["node"], "element": [*chunk_costs(r["codes"]).ravel().tolist(), r["codes"][-1] & 3]}])
    ends = scan(materialize(costs), _combine_costs, _spread_costs, [0, _NEVER, _NEVER, _NEVER, -1], [*_END, 1], fan_bits=fan_bits)
    met = materialize(chunks.join(ends, ["key", "node"]))

    def passed(r: dict) -> list[dict]:
        forward, backward = both_costs(r["codes"], r["enter"][:4], r["leave"][:4])
        total = min(f + b for f, b in zip(forward[0], backward[0], strict=True))
        to = [walk(r["codes"], forward, backward, q, False)[1] if r["enter"][q] + backward[0][q] == total else -1 for q in range(4)]
        return [{"key": r["key"], "node": r["node"], "element": to}]

    def edited(r: dict) -> list[dict]:
        forward, backward = both_costs(r["codes"], r["enter"][:4], r["leave"][:4])
        letters, _, edits = walk(r["codes"], forward, backward, r["state"], bool(r["leave"][4]))
        initials = [c & 3 for c in r["codes"]]
        pairs = zip([r["enter"][4], *initials], initials, strict=False)
        illegal = sum(p >= 0 and (p, q) not in ((_S, _U), (_U, _A), (_A, _U)) for p, q in pairs)
        total = min(f + b for f, b in zip(forward[0], backward[0], strict=True))
        places = [*r["places"], r["places"][-1]]
        kept = [{"pos": places[i], "sub": k, "edit": e, "role": role} for k, (i, e, role) in enumerate(edits) if e != "D"]
        return [{"key": r["key"], "node": r["node"], "letters": letters, "illegal": illegal, "cost": total, "edits": kept}]

    states = scan(materialize(_rows(met, "key string, node long, element array<long>", passed)), _combine_states, _spread_states, [0], [], fan_bits=fan_bits)
    whole = met.join(states.select("key", "node", F.get("enter", F.lit(0)).alias("state")), ["key", "node"])
    done = materialize(_rows(whole, "key string, node long, letters string, illegal long, cost long, edits array<struct<pos: long, sub: int, edit: string, role: string>>", edited))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "letters"))), lambda x: x["letters"]), "")
    reports = counts.join(done.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), audit.alias("audit")), "key")
    edits = done.select(F.explode("edits").alias("e")).select("e.pos", "e.sub", "e.edit", F.col("e.role").alias("new_role"))
    inserted = F.col("edit") == "I"
    repaired = edits.join(placed.drop("digest"), "pos").select(
        "key", "pos", "sub", "edit", F.when(~inserted, F.col("turn")).alias("turn"), F.coalesce("new_role", "role").alias("role"), F.when(inserted, F.lit("")).otherwise(F.col("text")).alias("text")
    )
    return reports, repaired


def hashes(repaired: DataFrame) -> DataFrame:
    """key, repaired_sha256 of a conversation's role:text, joined by newlines. Rows pass sorted; a conversation is never held."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if key != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["key", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["key", "repaired_sha256"])

    return repaired.repartition("key").sortWithinPartitions("key", "pos", "sub").select("key", "role", "text").mapInArrow(of, "key string, repaired_sha256 string")
