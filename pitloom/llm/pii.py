"""Personal data: base patterns, and terms that reveal them by information theory.

A protected entity is a value that a base pattern finds. The corpus tells how strongly a term reveals it: of the n_t documents with
the term, n_te have the entity too, and they have d different texts. The chance that a document with the term has the entity is estimated as
n_te / n_t, shrunk by d / (d + 1), so that copies of one text are no evidence and rare entities count with what little there is. The term's pointwise
mutual information with the entity is the entity's content, -log2 of its share of the documents, less -log2 of that chance: what is left secret.
A term that leaves at most `generalise` bits of some entity secret gives way to its class (name, number, code, word), one that leaves at
most `remove` bits goes, wherever they stand in any document. A term that one text alone has, together with an entity, leaves one bit.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .words import shipped, text_rows

KINDS = ("email", "ip", "card", "phone")
#: The kind of spans that the statistics add.
TERM, TERM_REMOVED = "term", "term_removed"
_AT_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match can only start where a run of digits does: what fails there fails further in too. Possessive, so that long runs cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W_]{3,}")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """At most 255; leading zeros, however many, count for nothing."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each @ leftwards over the local part, no further than the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        right = _AT_RIGHT.match(text, at + 1) if begin < at else None
        if right:
            done = right.end()
            yield begin, done
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, in order of kind, then start. A null text counts as empty."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def _disjoint(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the text that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def terms_of(text: str) -> set[str]:
    return set(map(str.lower, _TERM.findall(text)))


def hashed(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63


class Told:
    """Hashes of terms that reveal something, and which of them are to be removed."""

    def __init__(self, terms, removed) -> None:
        terms, removed = np.asarray(terms, np.int64), np.asarray(removed, bool)
        order = np.argsort(terms)
        self.terms, self.removed = terms[order], removed[order]

    def kinds(self, terms: set[str]) -> dict[str, str]:
        """Of those among the terms that are told."""
        if not len(self.terms) or not terms:
            return {}
        words = list(terms)
        marks = np.fromiter(map(hashed, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.terms, marks), len(self.terms) - 1)
        return {words[k]: TERM_REMOVED if self.removed[at[k]] else TERM for k in np.flatnonzero(self.terms[at] == marks).tolist()}


def term_spans(text: str | None, known: Told, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each known term outside of base spans."""
    told = known.kinds(terms_of(text)) if text else {}
    if not told:
        return []
    starts, ends = _disjoint(base)
    out = []
    for m in _TERM.finditer(text):
        kind = told.get(m[0].lower())
        if kind:
            before = bisect_left(starts, m.end()) - 1  # the last base span that starts before the term's end
            if before < 0 or ends[before] <= m.start():
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def _texts_with_entities(rows: DataFrame) -> DataFrame:
    """digest, copies, entities, terms (hashes): one row for each different text with an entity."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, entities, terms = [], [], []
            for marks, texts in text_rows(batch, "digest", "text"):
                for mark, text in zip(marks, texts, strict=True):
                    if text and (spans := base_spans(text)):
                        digests.append(mark)
                        entities.append(list({hashed(entity(k, text[a:b])) for k, a, b in spans}))
                        terms.append(list({hashed(t) for t in terms_of(text)}))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64()))], names=["digest", "entities", "terms"])

    found = rows.select("digest", "text").mapInArrow(of, "digest string, entities array<long>, terms array<long>")
    return found.groupBy("digest").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))


def _document_frequencies(rows: DataFrame) -> DataFrame:
    """term (hash), n: parts of the number of documents that have it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"term": pa.array([hashed(t) for t in counts], pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for batch in batches:
            for (texts,) in text_rows(batch, "text"):
                for text in texts:
                    if text:
                        counts.update(terms_of(text))
                if len(counts) > 300_000:
                    yield flush()
        yield flush()

    return rows.select("text").mapInArrow(of, "term long, n long")


def revealing_terms(docs: DataFrame, *, text_col: str = "text", generalise: float = 1.0, remove: float = 0.16) -> DataFrame:
    """term (hash), kind (`term` or `term_removed`), secret (bits that the term leaves of the entity it reveals most): terms that leave few.

    All counts are over all documents and whole texts. generalise may be at most one bit: pairs of a term and an entity are only made where
    each stands in two different texts or more, since a term with one such text leaves a bit or more.
    """
    if not 0 <= remove <= generalise <= 1:
        raise ValueError("0 <= remove <= generalise <= 1")
    least = 2.0**-generalise
    rows = docs.select(F.col(text_col).alias("text"), F.md5(F.col(text_col).cast("binary")).alias("digest"))
    texts = materialize(_texts_with_entities(rows))
    used = texts.select("digest", "copies", F.explode("terms").alias("term"))
    near = used.groupBy("term").agg(F.sum("copies").alias("with_any"), F.count("*").alias("texts"))
    n_t = _document_frequencies(rows).groupBy("term").agg(F.sum("n").alias("n_t"))
    # a chance of `least` or more needs at least that share of the term's documents to have any entity
    known = materialize(near.join(n_t, "term").where(F.col("with_any") >= F.col("n_t") * least - 1e-9))
    alone = known.where("texts = 1").select("term", (F.col("with_any") / F.col("n_t") / 2).alias("chance"))
    often = texts.select("digest", F.explode("entities").alias("entity"))
    repeated = often.groupBy("entity").agg(F.count("*").alias("m")).where("m > 1").select("entity")
    several = used.join(known.where("texts > 1").select("term", "n_t"), "term")
    together = several.join(often.join(repeated, "entity"), "digest").groupBy("term", "entity").agg(F.sum("copies").alias("n_te"), F.count("*").alias("d"), F.max("n_t").alias("n_t"))
    chance = F.col("n_te") / F.col("n_t") * F.col("d") / (F.col("d") + 1)
    pairs = together.select("term", chance.alias("chance")).groupBy("term").agg(F.max("chance").alias("chance"))
    secret = F.greatest(-F.log2("chance"), F.lit(0.0))
    told = alone.unionByName(pairs).select("term", secret.alias("secret")).where(F.col("secret") <= generalise + 1e-9)
    return told.select("term", F.when(F.col("secret") <= remove, F.lit(TERM_REMOVED)).otherwise(F.lit(TERM)).alias("kind"), "secret")


def _with_terms(docs: DataFrame, text_col: str, broadcast_terms: int, options: dict) -> tuple[DataFrame, object]:
    """docs, perhaps with `__told`, and what gives a task the kinds by hash: revealing terms are broadcast up to broadcast_terms, else they meet the texts by a shuffle."""
    told = materialize(revealing_terms(docs, text_col=text_col, **options))
    if told.count() <= broadcast_terms:
        got = told.select("term", (F.col("kind") == TERM_REMOVED).alias("removed")).toPandas()
        return docs.withColumn("__told", F.lit(None).cast("array<struct<term:bigint,removed:boolean>>")), shipped(docs.sparkSession, Told(got["term"], got["removed"]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for marks, texts in text_rows(batch, "digest", "text"):
                each = [[hashed(t) for t in terms_of(x)] if x else [] for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array([m for m, x in zip(marks, each, strict=True) for _ in x], pa.string()), pa.array([t for x in each for t in x], pa.int64())], names=["digest", "term"])

    mark = F.md5(F.col(text_col).cast("binary"))
    met = docs.select(mark.alias("digest"), F.col(text_col).alias("text")).mapInArrow(of, "digest string, term long").join(told, "term")
    by_text = met.groupBy("digest").agg(F.collect_set(F.struct("term", (F.col("kind") == TERM_REMOVED).alias("removed"))).alias("__told"))
    return docs.withColumn("__digest", mark).join(by_text.withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest"), None


def _known(told: list | None, held: Told | None) -> Told:
    return held or Told([t["term"] for t in told or ()], [t["removed"] for t in told or ()])


def all_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_terms: int = 1_000_000, **options) -> DataFrame:
    """doc_id, spans (base), terms: both array<struct<kind,start,end>>; one row for each row.

    A null text counts as empty. Equal or null ids are rows like others. Other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    met, held = _with_terms(rows, "text", broadcast_terms, options)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        known = held() if held else None
        spans_of = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            base, terms = [], []
            for texts, told in text_rows(batch, "text", "__told"):
                for text, more in zip(texts, told, strict=True):
                    found = base_spans(text)
                    base.append(spans_of(found))
                    terms.append(spans_of(term_spans(text, _known(more, known), found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(terms, kind)], names=["doc_id", "spans", "terms"])

    span = "array<struct<kind:string,start:int,end:int>>"
    return met.select("doc_id", "text", "__told").mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {span}, terms {span}")


def sanitize(docs: DataFrame, *, text_col: str = "text", broadcast_terms: int = 1_000_000, **options) -> DataFrame:
    """All columns of docs, with personal data in the text replaced: base spans by their kind in angle brackets, terms by
    their class, or by nothing where they reveal too much. A null text stays null."""
    names = list(docs.columns)
    met, held = _with_terms(docs, text_col, broadcast_terms, options)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held() if held else None
        for batch in batches:
            out = [replaced(text, _known(more, known)) for texts, told in text_rows(batch, text_col, "__told") for text, more in zip(texts, told, strict=True)]
            at = batch.schema.get_field_index(text_col)
            columns = [pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.select(*names, "__told").mapInArrow(of, docs.schema)


def term_class(term: str) -> str:
    """What a term is generalised to."""
    if term.isdigit():
        return "<NUMBER>"
    if any(c.isdigit() for c in term):
        return "<CODE>"
    return "<NAME>" if term[0].isupper() else "<WORD>"


def replaced(text: str | None, known: Told) -> str | None:
    """Overlapping spans are replaced as one, by the kind of the one that starts first (the longest of those)."""
    if text is None:
        return None
    base = base_spans(text)
    spans = sorted([(a, -b, f"<{k.upper()}>") for k, a, b in base] + [(a, -b, term_class(text[a:b]) if k == TERM else "") for k, a, b in term_spans(text, known, base)])
    out, done = [], 0
    for a, b, by in spans:
        if a >= done:
            out += [text[done:a], by]
        done = max(done, -b)
    return "".join([*out, text[done:]])
