"""WARC: metadata and plain-text conversion records derived from response records.

A response record gives two derivatives, each a WARC 1.1 record of its own:

* ``conversion`` (text/plain): the visible text of the HTML payload;
* ``metadata`` (application/warc-fields): title, language, length of text, number of links, the
  source's HTTP status and headers, and the identifier and digest of the conversion.

Both name the response in ``WARC-Refers-To``, with its target URI and date, and carry the digest
of their own block; the metadata record preserves the source's payload and block digests.
Identifiers are version-5 UUIDs of the source record's identifier and the derivative's type, so a
second run, or a task that is run again, gives the same records.

Defined cases: a null URL is an empty target URI; null or empty HTML is an empty payload and gives
an empty conversion; markup that is never closed ends with the text; repeated rows give repeated
records with equal identifiers; an empty table gives no records; other columns are ignored.  Markup
is read in one pass whose time grows with its length, whatever is left open.  In files, header names
may be in any case and values may go on over lines; bytes that are no record are reported as rows.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import small_batches

DATE = "2024-01-01T00:00:00Z"  # of responses that are built from rows without a date

# Elements that begin and end a line, and elements whose text is not shown.
_BREAKING = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th title tr ul".split()
_HIDDEN = "script style template noscript".split()

_BREAKS = frozenset(_BREAKING)
_BEGIN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*)|[/!?])")
_PLAIN_TAG = re.compile(r"[^>\"']*+>")
_SPECIAL = re.compile(r"[>\"']")
_CLOSING = {t: re.compile(rf"</{t}\s*+>", re.I) for t in (*_HIDDEN, "title")}
_BLANKS = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"\bhref\s*+=", re.I)


class _Tags:
    """Ends of the tags of one text.  Quoted values may hold ``>``; a tag with a quote that is never
    closed ends at its first ``>``, or with the text.  A quote from which no end was found is
    remembered, so all tags together read the text a bounded number of times."""

    def __init__(self, markup: str):
        self.markup = markup
        self.hopeless: set[int] = set()

    def end(self, at: int) -> int:
        """Behind the tag whose name ends at ``at``."""
        if m := _PLAIN_TAG.match(self.markup, at):
            return m.end()
        path, here = [], at
        while m := _SPECIAL.search(self.markup, here):
            if m[0] == ">":
                return m.end()
            if m.start() in self.hopeless:
                break
            path.append(m.start())
            close = self.markup.find(m[0], m.end())
            if close < 0:
                break
            here = close + 1
        self.hopeless.update(path)
        first = self.markup.find(">", at)
        return first + 1 if first >= 0 else len(self.markup)


@dataclass
class Page:
    """What one pass over a page's markup finds."""

    text: str
    title: str
    language: str
    links: int


def read_page(markup: str) -> Page:
    """Visible text (one line a block element, blanks collapsed, entities decoded), text of the first
    title, language of the ``html`` element, and number of ``a`` elements with ``href``."""
    markup = markup.replace("\n", " ")
    tags = _Tags(markup)
    out: list[str] = []
    title, language, links = None, "", 0
    at, n = 0, len(markup)
    while m := _BEGIN.search(markup, at):
        out.append(markup[at : m.start()])
        if m[1]:
            end = markup.find("-->", m.end())
            at = end + 3 if end >= 0 else n
            continue
        name = (m[3] or "").lower()
        if name in _HIDDEN and not m[2]:
            end = markup.find(">", m.end())
            close = _CLOSING[name].search(markup, end) if end >= 0 else None
            at = close.end() if close else n
            out.append(" ")
            continue
        at = tags.end(m.end()) if name else (markup.find(">", m.end()) + 1 or n)
        if name in _BREAKS:
            out.append("\n")
        if m[2]:
            continue
        if name == "a":
            links += _HREF.search(markup, m.end(), at) is not None
        elif name == "html" and not language:
            found = _LANG.search(markup, m.end(), at)
            language = found[1] if found else ""
        elif name == "title" and title is None:
            close = _CLOSING["title"].search(markup, at)
            title = read_page(markup[at : close.start()]).text if close else ""
    out.append(markup[at:])
    return Page(_shown("".join(out)), title or "", language, links)


def _shown(text: str) -> str:
    if "&" in text:
        text = entities.unescape(text)
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip(" \n")


def plain_text(markup: str) -> str:
    """Visible text of a page."""
    return read_page(markup).text


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


@dataclass(frozen=True)
class Record:
    kind: str
    record_id: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def serialize(self) -> bytes:
        lines = [("WARC-Type", self.kind), ("WARC-Record-ID", self.record_id), *self.headers.items(), ("Content-Length", str(len(self.block)))]
        head = "WARC/1.1\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in lines) + "\r\n"
        return head.encode() + self.block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


class Broken(NamedTuple):
    """What cannot be read as a record."""

    at: int
    reason: str


#: Names of the headers that are read here, whatever their case in a file.
_NAMES = {x.lower(): x for x in "WARC-Type WARC-Record-ID WARC-Target-URI WARC-Date WARC-Payload-Digest WARC-Block-Digest WARC-Refers-To Content-Type Content-Length".split()}


def _headers(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last is not None:  # goes on the line before
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = _NAMES.get(name.strip().lower(), name.strip())
            out[last] = value.strip()
    return out


def records(data: bytes) -> Iterator[Record | Broken]:
    """Records of uncompressed WARC bytes; after bytes that are none, the next one that follows an
    empty line."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        reason, end = None, data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at):
            reason = "no record"
        elif end < 0:
            reason = "headers without end"
        else:
            headers = _headers(data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
            size = headers.pop("Content-Length", "")
            kind, record_id = headers.pop("WARC-Type", ""), headers.pop("WARC-Record-ID", "")
            if not (size.isascii() and size.isdigit()):
                reason = "no content length"
            elif not kind or not record_id:
                reason = "no type or identifier"
            elif end + 4 + int(size) > len(data):
                reason = "cut off"
        if reason is None:
            yield Record(kind, record_id, headers, data[end + 4 : end + 4 + int(size)])
            at = end + 4 + int(size)
            continue
        yield Broken(at, reason)
        after = data.find(b"\r\n\r\nWARC/", at)
        at = after + 4 if after >= 0 else len(data)


def parse(data: bytes) -> Iterator[Record]:
    """Records of uncompressed WARC bytes that have no others."""
    for r in records(data):
        if isinstance(r, Broken):
            raise ValueError(f"{r.reason} at byte {r.at}")
        yield r


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def response(page_id, url: str | None, markup: str | None, date: str = DATE) -> Record:
    """The response record of a row of pages."""
    payload = (markup or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = {
        "WARC-Target-URI": url or "",
        "WARC-Date": date,
        "WARC-Payload-Digest": digest(payload),
        "WARC-Block-Digest": digest(block),
        "Content-Type": "application/http; msgtype=response",
    }
    return Record("response", _urn(f"{page_id} {url or ''} {headers['WARC-Payload-Digest']}"), headers, block)


def derivatives(source: Record) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response."""
    head, _, payload = source.block.partition(b"\r\n\r\n")
    status, *http = head.decode("latin-1").split("\r\n")
    markup = payload.decode("utf-8", "replace")
    page = read_page(markup)
    linked = {"WARC-Refers-To": source.record_id} | {k: source.headers[k] for k in ("WARC-Target-URI", "WARC-Date") if k in source.headers}
    linked = linked | {f"WARC-Refers-To-{k[5:]}": v for k, v in linked.items() if k in ("WARC-Target-URI", "WARC-Date")}

    def record(kind: str, block: bytes, content_type: str) -> Record:
        return Record(kind, _urn(f"{source.record_id} {kind}"), linked | {"WARC-Block-Digest": digest(block), "Content-Type": content_type}, block)

    conversion = record("conversion", page.text.encode(), "text/plain; charset=utf-8")
    fields = [
        ("title", page.title),
        ("language", page.language),
        ("text-characters", str(len(page.text))),
        ("links", str(page.links)),
        ("conversion-id", conversion.record_id),
        ("conversion-digest", conversion.headers["WARC-Block-Digest"]),
        ("source-payload-digest", source.headers.get("WARC-Payload-Digest") or digest(payload)),
        ("source-block-digest", source.headers.get("WARC-Block-Digest") or digest(source.block)),
        ("source-status", status),
        *((f"source-header-{k.strip().lower()}", v.strip()) for k, _, v in (h.partition(":") for h in http)),
    ]
    block = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode()
    return record("metadata", block, "application/warc-fields"), conversion


SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, block_digest string,"
    " source_payload_digest string, content_length long, record_crc32 long, block string, record binary"
)


def _rows(page_id, source: Record) -> Iterator[dict]:
    for r in derivatives(source):
        data = r.serialize()
        yield {
            "page_id": page_id,
            "warc_type": r.kind,
            "record_id": r.record_id,
            "refers_to": r.headers["WARC-Refers-To"],
            "target_uri": r.headers.get("WARC-Target-URI", ""),
            "warc_date": r.headers.get("WARC-Date"),
            "block_digest": r.headers["WARC-Block-Digest"],
            "source_payload_digest": source.headers.get("WARC-Payload-Digest"),
            "content_length": len(r.block),
            "record_crc32": zlib.crc32(data),
            "block": r.block.decode(),
            "record": data,
        }


def _batched(rows: Iterator[dict], most: int = 8 << 20):
    """Arrow batches of about ``most`` bytes of records."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(","))])
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 2 * len(r["record"])
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def derive_pages(pages: DataFrame) -> DataFrame:
    """Two records (``SCHEMA``) of every row ``page_id, url, html``."""
    small_batches(pages.sparkSession, 500)

    def run(batches):
        def rows():
            for b in batches:
                for p, u, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    yield from _rows(p, response(p, u, h))

        yield from _batched(rows())

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def _broken_row(b: Broken) -> dict:
    return dict.fromkeys(x.split()[0] for x in SCHEMA.split(", ")) | {"warc_type": "broken", "block": b.reason, "content_length": b.at, "record": b""}


def derive_files(spark: SparkSession, path: str, by_record: bool = False) -> DataFrame:
    """Two records of every response in WARC files (plain, or gzip with any number of members), and a
    row of type ``broken`` for what cannot be read: its place and the reason.  ``page_id`` is null.

    A file is held whole, unless ``by_record``: then files of any size are read a record at a time
    (plain ones by many tasks), and a payload that itself holds an empty line and a record's first
    line counts as cut off there."""
    small_batches(spark, 500)
    if by_record:
        read = spark.read.option("lineSep", "\r\n\r\nWARC/").text(path).select(F.col("value").cast("binary").alias("content"))
    else:
        read = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        def rows():
            for b in batches:
                for data in b.column(0).to_pylist():
                    if by_record and data.strip():
                        # An empty block's end may have gone with the separator; more bytes do no harm.
                        data = (data if data.startswith(b"WARC/") else b"WARC/" + data) + b"\r\n\r\n"
                    for r in records(data if by_record else _unzipped(data)):
                        if isinstance(r, Broken):
                            yield _broken_row(r)
                        elif r.kind == "response":
                            yield from _rows(None, r)

        yield from _batched(rows())

    return read.mapInArrow(run, SCHEMA)


def _unzipped(data: bytes) -> bytes:
    """The bytes of all gzip members up to the first that cannot be read."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            out += [member.decompress(data), member.flush()]
        except zlib.error:
            break
        if not member.eof:
            break
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def query(pages: DataFrame) -> DataFrame:
    return derive_pages(pages).drop("record")
