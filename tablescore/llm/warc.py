"""Web archive derivatives: for each response a metadata record and a plain-text conversion record.

Both refer to the response by its identifier, target and date, and carry its payload digest; the
metadata block keeps the response's own WARC and HTTP headers, with title and links. Identifiers are
derived from the response's, so a rerun gives the same records. Digests are SHA-1 in base 32, blocks
are bytes, and record_bytes() and parse() are each other's inverse.

A null html is an empty payload, a null url a record without target; rows that repeat are records of
their own with equal identifiers. Pages are processed whole, in time linear in their length. An empty
table gives an empty one. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_entities
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.0"

RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("block_digest", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("block", T.BinaryType()),
])
#: WARC names of the columns, in the order in which they are written.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "page_id": "X-Page-ID",
}

#: A comment's start; a declaration or other tag without a name; a tag with its name, what stands in it, and its end if it has one.
#: Quotes count after an equals sign only, where a value in them may hold any character; nothing here is tried twice.
TOKEN = re.compile(r"""<(?:(!--)|([!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)(>?))""")
ATTRIBUTE = re.compile(r"""([^\s/=>][^\s/=>]*+)(?:\s*+(=)\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
#: Elements that are hidden with all up to their end tag; the first two run to the end of the page without one.
HIDDEN = ("script", "style", "noscript", "template")
#: What a head can hold; its end tag may be left out.
IN_HEAD = frozenset(("base", "basefont", "bgsound", "link", "meta", "title", "noframes", *HIDDEN))
ENDS = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>", re.I) for n in (*HIDDEN, "title", "noframes")}
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
BLANKS, LINES = re.compile(r"[^\S\n]+"), re.compile(r"\s*\n\s*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def href(body: str) -> str | None:
    """The value of the first attribute of that name in what stands in a tag."""
    for m in ATTRIBUTE.finditer(body):
        if m[1].lower() == "href":
            return html_entities.unescape(m[3] or m[4] or m[5] or "") if m[2] else None
    return None


def scan(page: str) -> tuple[str, str | None, list[str]]:
    """Visible text, title and links of a page, in one pass over its tags.

    Comments, heads and hidden elements are left out. A head ends at the first text or element that it cannot hold, as
    in a browser; comments, scripts, styles and tags without an end run to the end of the page. Block elements
    end a line, blanks collapse, character references are resolved. The title is the first that has an end tag.
    """
    out: list[str] = []
    links: dict[str, None] = {}
    title, at, head, search = None, 0, False, TOKEN.search
    endless: set[str] = set()

    def past(name: str) -> re.Match | None:
        """The next end tag of that name; it is sought once where there is none."""
        found = None if name in endless else ENDS[name].search(page, at)
        if not found:
            endless.add(name)
        return found

    while True:
        m = search(page, at)
        if not m or m.start() > at:
            text = page[at : m.start()] if m else page[at:]
            head = head and not text.strip()
            if not head:
                out.append(text.replace("\n", " "))
        if not m:
            break
        at = m.end()
        if m[1]:
            at = page.find("-->", at) + 3
            if at < 3:
                break
            continue
        if m[2]:
            continue
        if not m[6]:
            break
        name = m[4].lower()
        if name == "head":
            head = not m[3]
            continue
        head = head and name in IN_HEAD
        if not m[3]:
            if name in HIDDEN or (head and name == "noframes"):
                if end := past(name):
                    at = end.end()
                elif name in ("script", "style"):
                    break
                continue
            if name == "title" and (title is None or head) and (end := past(name)):
                title = page[at : end.start()] if title is None else title
                if head:
                    at = end.end()
            elif name == "a" and not head and (link := href(m[5])) is not None:
                links[link] = None
        if name in BREAKS and not head:
            out.append("\n")
    text = BLANKS.sub(" ", "".join(out))
    if "&" in text:
        text = html_entities.unescape(text)
    if title is not None:
        title = html_entities.unescape(TOKEN.sub("", title)).strip()
    return LINES.sub("\n", BLANKS.sub(" ", text)).strip(), title, list(links)


def plain_text(page: str) -> str:
    return scan(page)[0]


def split_http(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("iso-8859-1").split("\r\n")
    return lines[0], [[n.strip(), v.strip()] for n, _, v in (x.partition(":") for x in lines[1:])], payload


def response(page_id: int | None, url: str | None, page: str | None) -> dict:
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return {
        "page_id": page_id, "record_type": "response", "record_id": identifier("response", str(page_id), url or "", hashlib.sha256(payload).hexdigest()), "refers_to": None, "target_uri": url, "date": DATE,
        "content_type": "application/http; msgtype=response", "block_digest": digest(block), "payload_digest": digest(payload), "block": block,
    }


def derivatives(r: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    status, headers, payload = split_http(r["block"] or b"")
    page = payload.decode("utf-8", "replace")
    text, title, links = scan(page)
    meta = {
        "refers-to": r["record_id"], "target-uri": r["target_uri"], "date": r["date"], "payload-digest": r["payload_digest"], "block-digest": r["block_digest"],
        "warc-headers": [[HEADERS[k], str(r[k])] for k in HEADERS if r[k] is not None], "http-status": status, "http-headers": headers,
        "title": title, "links": links,
    }
    out = []
    for kind, mime, block in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False).encode("utf-8", "surrogatepass")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass"))):
        own = identifier(kind, r["record_id"] or "")
        out.append({"page_id": r["page_id"], "record_type": kind, "record_id": own, "refers_to": r["record_id"], "target_uri": r["target_uri"], "date": r["date"], "content_type": mime, "block_digest": digest(block), "payload_digest": r["payload_digest"], "block": block})
    return out


def record_bytes(r: dict) -> bytes:
    head = [VERSION, *(f"{HEADERS[k]}: {r[k]}".encode("utf-8", "surrogatepass") for k in HEADERS if r[k] is not None), b"Content-Length: %d" % len(r["block"])]
    return b"\r\n".join(head) + b"\r\n\r\n" + r["block"] + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, gzipped or not; ends at the first byte that begins no record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    names = {v.lower(): k for k, v in HEADERS.items()}
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = dict(x.split(":", 1) for x in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:] if ":" in x)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        n = int(fields.get("content-length", 0))
        r = dict.fromkeys(HEADERS) | {names[k]: v for k, v in fields.items() if k in names}
        r["page_id"] = int(r["page_id"]) if r["page_id"] is not None else None
        yield r | {"block": data[end + 4 : end + 4 + n]}
        at = end + 4 + n
        while data.startswith(b"\r\n", at):
            at += 2


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in RECORD.names], names=RECORD.names)


def responses(pages: DataFrame) -> DataFrame:
    """A response record for each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "html", 4 << 20):
                yield batch_of([response(*r) for r in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses in records; others are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "block", 4 << 20):
                yield batch_of([d for r in part.to_pylist() for d in derivatives(r)])

    return records.where("record_type = 'response'").select(*RECORD.names).mapInArrow(run, RECORD)


def archived(records: DataFrame, compress: bool = True) -> DataFrame:
    """(record_id, warc): each record as bytes of a WARC file, a gzip member of its own if compressed; any concatenation is a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "block", 4 << 20):
                out = [record_bytes(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("record_id"), pa.array([gzip.compress(x, mtime=0) if compress else x for x in out], pa.binary())], names=["record_id", "warc"])

    return records.select(*RECORD.names).mapInArrow(run, "record_id string, warc binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under path, each file by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = []
                for r in parse(data):
                    rows.append(r)
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
