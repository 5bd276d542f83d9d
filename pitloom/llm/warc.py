"""WARC derivatives: each response record gives a metadata record and a plain-text conversion record that refer to it.

Both name the response in WARC-Refers-To with its URI and date; the metadata record preserves the response's
WARC and HTTP headers and its digests. Record ids follow from the response's, so that a repeated run gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import all_text
from .words import text_rows

VERSION = "WARC/1.0"
_HREF = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.IGNORECASE)
_LENGTH = re.compile(r"[0-9]{1,18}")
#: What every record begins with, and what follows.
_MARK = b"WARC/"
_VERSION = re.compile(rb"[0-9]+\.[0-9]+\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
RESPONSE = "record_id string, target_uri string, warc_date string, warc_headers string, http_headers string, payload binary, block_digest string, payload_digest string, complete boolean"
DERIVED = "warc_type string, record_id string, refers_to string, refers_to_target_uri string, refers_to_date string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, block string"
_DERIVED_NAMES = [c.split()[0] for c in DERIVED.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A uuid made from a hash of the parts."""
    h = bytearray(hashlib.sha1("\0".join(parts).encode("utf-8", "surrogatepass")).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x50, h[8] & 0x3F | 0x80
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def fields(lines: str) -> list[tuple[str, str]]:
    """name, value of header lines; continued lines are joined, lines without a colon left out."""
    out: list[tuple[str, str]] = []
    for line in lines.replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def decoded(payload: bytes, http_headers: str | None) -> str:
    """By the charset that the headers or the page's first 1024 bytes name; else UTF-8. What doesn't decode becomes U+FFFD."""
    named = _CHARSET.search(http_headers or "") or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def _unchunked(body: bytes) -> bytes:
    """Of a chunked body; what breaks the rules is left as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body if not out else b"".join([*out, body[at:]])
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _inflated(body: bytes, window: int) -> bytes | None:
    """All gzip members, or one zlib or raw deflate stream; None if it is none. A stream that breaks off gives what it has."""
    out, rest = [], body
    try:
        while rest:
            one = zlib.decompressobj(window)
            out += [one.decompress(rest), one.flush()]
            rest = one.unused_data if window > 16 else b""
    except zlib.error:
        return b"".join(out) if out else None
    return b"".join(out)


def entity_body(payload: bytes, http: str) -> bytes:
    """The payload without its transfer and content encodings (chunked, gzip, deflate); unknown ones stay."""
    by = {n.lower(): v.lower() for n, v in fields(http)}
    if "chunked" in by.get("transfer-encoding", ""):
        payload = _unchunked(payload)
    for coding in reversed([c.strip() for c in by.get("content-encoding", "").split(",")]):
        for window in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            got = _inflated(payload, window)
            if got is not None:
                payload = got
                break
    return payload


def derive(source: dict) -> tuple[tuple, tuple]:
    """The metadata and the conversion record of one response, as in DERIVED."""
    payload, http = source["payload"] or b"", source["http_headers"] or ""
    uri, date, refers = source["target_uri"], source["warc_date"], source["record_id"]
    html = decoded(entity_body(payload, http), http)
    kind = next((v for n, v in fields(http) if n.lower() == "content-type"), "text/html")
    text = all_text(html) if "html" in kind.lower() else html if kind.lower().startswith("text/") else ""
    about = [("source-block-digest", source["block_digest"] or digest(http.encode("utf-8", "surrogatepass") + b"\r\n" + payload)), ("source-payload-digest", source["payload_digest"] or digest(payload))]
    about += [(f"source-warc-{n.lower()}", v) for n, v in fields(source["warc_headers"] or "")]
    first = http.split("\n", 1)[0].strip()
    about += [("source-http-status", first)] if first.startswith("HTTP/") else []
    about += [(f"source-http-{n.lower()}", v) for n, v in fields(http.split("\n", 1)[-1])]
    for link in dict.fromkeys(m[1] or m[2] or m[3] or "" for m in _HREF.finditer(html)):
        try:
            about.append(("outlink", urljoin(uri or "", link.replace("&amp;", "&"))))
        except ValueError:  # no URL
            about.append(("outlink", link))
    block = "".join(f"{n}: {' '.join(v.split())}\r\n" for n, v in about)
    out = []
    for type_, mime, body in (("metadata", "application/warc-fields", block), ("conversion", "text/plain", text)):
        data = body.encode("utf-8", "surrogatepass")
        out.append((type_, record_id(type_, refers or "", uri or ""), refers, uri, date, uri, date, mime, len(data), digest(data), body))
    return out[0], out[1]


def derivatives(responses: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in `keep`, then those of DERIVED: two rows for each response, metadata first.

    Null payloads and headers count as empty, missing digests are computed, other nulls stay null. Repeated rows give repeated
    records with equal ids. Other columns are ignored. An empty table gives an empty one. No shuffle.
    """
    needed = ["record_id", "target_uri", "warc_date", "warc_headers", "http_headers", "payload", "block_digest", "payload_digest"]
    part = responses.select(*keep, *(F.col(c).alias(f"__{c}") for c in needed))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[: len(keep)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                out = [r for (*values,) in text_rows(rows, *(f"__{c}" for c in needed), size=512) for x in zip(*values, strict=True) for r in derive(dict(zip(needed, x, strict=True)))]
                twice = pa.array([k for k in range(rows.num_rows) for _ in range(2)], pa.int64())
                columns = [rows.column(k).take(twice) for k in range(len(keep))]
                columns += [pa.array([r[k] for r in out], pa.int64() if n == "content_length" else pa.string()) for k, n in enumerate(_DERIVED_NAMES)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *_DERIVED_NAMES])

    return part.mapInArrow(of, ", ".join(x for x in (kept, DERIVED) if x))


def responses_of_pages(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Pages (url, html) as the responses that they would have come in; ids follow from address and text."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    x = F.sha1(F.concat(F.coalesce(F.col("url"), F.lit("")).cast("binary"), F.lit("\0").cast("binary"), body))
    uuid = F.concat(F.lit("<urn:uuid:"), F.substring(x, 1, 8), F.lit("-"), F.substring(x, 9, 4), F.lit("-5"), F.substring(x, 14, 3), F.lit("-a"), F.substring(x, 18, 3), F.lit("-"), F.substring(x, 21, 12), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    none = F.lit(None).cast("string")
    return pages.select(*keep, uuid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.lit("WARC-Type: response\r\n").alias("warc_headers"), http.alias("http_headers"), body.alias("payload"), none.alias("block_digest"), none.alias("payload_digest"), F.lit(True).alias("complete"))


def write(records: DataFrame, path: str) -> None:
    """Records of derivatives() as WARC files, one in each partition, by Spark's own writer. A record ends with two line ends, which are its line separator."""
    lines = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri"), ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    head = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("") for n, c in lines]
    records.select(F.concat(F.lit(f"{VERSION}\r\n"), *head, F.lit("\r\n"), F.coalesce("block", F.lit(""))).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


class Framer:
    """Puts together the records of one file from what lies between its marks, in order: a mark inside a block or a header starts no record."""

    def __init__(self) -> None:
        self._head: bytes | None = None  # of the record that is open
        self._parts: list[bytes] = []
        self._need = self._got = 0

    def add(self, part: bytes) -> Iterator[tuple]:
        if self._head is not None and self._got < self._need:
            self._take(_MARK + part)
        elif self._head is None and self._parts and not (self._parts[-1].endswith(b"\n") and _VERSION.match(part)):
            self._parts = [b"".join([*self._parts, _MARK, part])]  # a mark inside a header
            self._open()
        else:
            yield from self.end()
            if _VERSION.match(part):
                self._parts = [part]
                self._open()
            elif part.strip():
                yield _record(None, part, False)
        if self._head is not None and self._got >= self._need:
            yield from self.end()

    def _open(self) -> None:
        found = _HEAD_END.search(self._parts[0])
        if not found:
            return
        whole = self._parts[0]
        self._head, block = whole[: found.start()], whole[found.end() :]
        length = {n.lower(): v for n, v in fields(self._head.decode("utf-8", "replace"))}.get("content-length", "")
        if not _LENGTH.fullmatch(length):
            block = block.removesuffix(b"\r\n\r\n")
        self._parts, self._got, self._need = [], 0, int(length) if _LENGTH.fullmatch(length) else len(block)
        self._take(block)

    def _take(self, data: bytes) -> None:
        self._parts.append(data)
        self._got += len(data)

    def end(self) -> Iterator[tuple]:
        """What is open, complete or not."""
        if self._head is not None:
            yield _record(self._head, b"".join(self._parts)[: self._need], self._got >= self._need)
        elif self._parts:
            yield _record(None, b"".join(self._parts), False)
        self._head, self._parts, self._need, self._got = None, [], 0, 0


def _record(head: bytes | None, block: bytes, whole: bool) -> tuple:
    lines = head.decode("utf-8", "replace") if head is not None else None
    by = {n.lower(): v for n, v in fields(lines or "")}
    http, payload = None, block
    if by.get("warc-type") == "response":
        http, _, payload = block.partition(b"\r\n\r\n")
        http = (http + b"\r\n").decode("latin-1")
    return by.get("warc-type"), by.get("warc-record-id"), by.get("warc-target-uri"), by.get("warc-date"), lines, http, payload, by.get("warc-block-digest") or digest(block), by.get("warc-payload-digest") or digest(payload), whole


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of uncompressed or gzipped WARC files of any version, framed by their Content-Length: warc_type, then as in RESPONSE.

    For records other than responses, http_headers is null and the payload is the whole block. complete is false
    where the block is shorter than its Content-Length says; what lies beyond it is left out. A record without a Content-Length reaches to the
    next one. What is no record has a null type and isn't complete. A file that is one split is framed as it is read; the
    parts of larger uncompressed ones are brought together first, as a mark inside a block may lie in another split than the block's beginning.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["warc_type", *(c.split()[0] for c in RESPONSE.split(", "))]
        kinds = {"payload": pa.binary(), "complete": pa.bool_()}

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds.get(n, pa.string())) for k, n in enumerate(names)], names=names)

        framer, file = Framer(), None
        for batch in batches:
            for values, files in text_rows(batch, "value", "file", size=64):
                out = []
                for data, name in zip(values, files, strict=True):
                    if name != file:
                        out += framer.end()
                        file = name
                    out += framer.add(data)
                yield batch_of(out)
        yield batch_of(list(framer.end()))

    parts = spark.read.option("lineSep", _MARK.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("cut"), F.monotonically_increasing_id().alias("n"))
    schema = f"warc_type string, {RESPONSE}"
    whole = parts.where("not cut").select("value", "file").mapInArrow(of, schema)
    together = parts.where("cut").repartition("file").sortWithinPartitions("file", "at", "n").select("value", "file")
    return whole.unionByName(together.mapInArrow(of, schema))
