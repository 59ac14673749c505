"""WARC derivatives: response records become linked metadata records and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: Ids are derived from what a record is made of, so that a task that runs again makes the same records.
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "newsquery/warc")

# Elements whose content is no text, and those that part lines.
SILENT = frozenset("script style noscript template head svg math iframe object canvas".split())
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of one record: its named fields, the block, and the two line ends that follow it."""
    fields = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)
    return b"".join([f"{VERSION}\r\n".encode(), *(f"{k}: {clean(v)}\r\n".encode() for k, v in fields), b"\r\n", block, b"\r\n\r\n"])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record in a row of records; ValueError where the row goes on with none."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = re.sub(rb"\r\n[ \t]+", b" ", data[at:end]).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if not fields.get("content-length", "").isdecimal():
            raise ValueError(f"record at byte {at} has no length")
        n = int(fields["content-length"])
        start = end + 4
        block = data[start : start + n]
        if len(block) != n or data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} ends early")
        yield fields, block
        at = start + n + 4


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """All of ``records``."""
    return list(records(data))


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, payload) of an HTTP message; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def unchunked(payload: bytes) -> bytes:
    """The content of a chunked message; ValueError for one that breaks off."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = payload[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError(f"no chunk at byte {at}")
        n, start = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if len(payload) < start + n:
            raise ValueError(f"chunk at byte {at} ends early")
        out.append(payload[start : start + n])
        at = start + n + 2


def _inflated(payload: bytes, coding: str) -> bytes:
    """All members of gzip data, or deflate data with or without its wrapper."""
    out = []
    while payload:
        wrapped = 31 if coding == "gzip" else 15 if payload[0] & 15 == 8 and (payload[0] << 8 | payload[1] if len(payload) > 1 else 1) % 31 == 0 else -15
        inflate = zlib.decompressobj(wrapped)
        out.append(inflate.decompress(payload) + inflate.flush())
        if not inflate.eof:
            raise ValueError(f"{coding} data ends early")
        payload = inflate.unused_data if coding == "gzip" and inflate.unused_data.startswith(b"\x1f\x8b") else b""
    return b"".join(out)


def decoded(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content codings (chunked, gzip, deflate); ValueError for others and for damaged data.

    A payload that is stored decoded under headers that still say otherwise is taken as it is.
    """
    named = lambda name: [c.strip().lower() for k, v in headers if k.lower() == name for c in v.split(",") if c.strip()]
    if "chunked" in named("transfer-encoding") and re.match(rb"[0-9A-Fa-f]+[ \t]*(?:;[^\r\n]*)?\r\n", payload):
        payload = unchunked(payload)
    for coding in reversed([c for c in [*named("content-encoding"), *(c for c in named("transfer-encoding") if c != "chunked")] if c != "identity"]):
        coding = coding.removeprefix("x-")
        if coding not in ("gzip", "deflate"):
            raise ValueError(f"content coding {coding} is not known")
        if coding == "gzip" and payload and not payload.startswith(b"\x1f\x8b"):
            continue
        try:
            payload = _inflated(payload, coding)
        except zlib.error as e:
            raise ValueError(f"{coding} data: {e}") from e
    return payload


def text_kind(headers: list[tuple[str, str]], payload: bytes) -> str:
    """`markup`, `plain`, or empty for what is no text; content without a type is judged by its first bytes."""
    declared = next((v for k, v in headers if k.lower() == "content-type"), "").partition(";")[0].strip().lower()
    if not declared:
        head = payload[:1024]
        return "" if b"\0" in head else "markup" if head.lstrip()[:1] == b"<" else "plain"
    if declared in ("text/html", "text/xml") or re.fullmatch(r"application/(?:[\w.-]+\+)?x(?:ht)?ml", declared):
        return "markup"
    return "plain" if declared.startswith("text/") or re.fullmatch(r"application/(?:[\w.-]+\+)?json", declared) else ""


class _Text(HTMLParser):
    """Title, language, links and visible text; unclosed and misnested elements are borne."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent: list[str] = []
        self.title: list[str] = []
        self.in_title = False
        self.lang = ""
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "html" and own.get("lang"):
            self.lang = own["lang"]
        if tag == "a" and own.get("href"):
            self.links.append(own["href"])
        if tag == "title":
            self.in_title = True
        elif tag == "body":
            self.silent.clear()  # a head that was never closed ends here
        elif tag in SILENT and tag not in VOID:
            self.silent.append(tag)
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.silent:
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.out.append(data)


def html_text(html: str) -> tuple[str, str, str, list[str]]:
    """(text, title, language, links): lines of visible text with single spaces, without empty lines."""
    parser = _Text()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):  # markup that the parser gives up on: what was read so far counts
        pass
    lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    squeeze = lambda x: re.sub(r"\s+", " ", x).strip()
    return "\n".join(x for x in lines if x), squeeze("".join(parser.title)), squeeze(parser.lang), parser.links


def _charset(headers: list[tuple[str, str]], payload: bytes) -> str:
    declared = next((v for k, v in headers if k.lower() == "content-type"), "")
    found = re.search(r"charset=[\"']?([\w.-]+)", declared, re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w.-]+)", payload[:4096].decode("latin-1"), re.I)
    name = found[1] if found else "utf-8"
    try:
        "".encode(name)
        b"".decode(name)
        return name
    except LookupError:
        return "utf-8"


def response(url: str, html: str | None, date: str) -> bytes:
    """A response record around a page for which only the address and the payload were kept."""
    payload = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [("WARC-Record-ID", record_id("response", url, digest(payload), date)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http;msgtype=response")]
    return record("response", headers, block)


def derive(source: bytes) -> list[dict]:
    """The metadata record of each response in ``source``, and of textual ones the conversion record; records of other types give none.

    Both refer to the response by WARC-Refers-To and keep its target, its date (as WARC-Refers-To-Date) and its
    payload digest. The metadata block lists the source's status line and header fields, both digests, title,
    language and links. The conversion block is the text in UTF-8, read from the payload without its transfer and
    content codings; markup gives its visible text, other text is as it is. A payload that can't be decoded gives a
    metadata record with ``error``, and so does a row of records where it breaks off: those before it are kept.
    """
    out = []
    try:
        for fields, block in records(source):
            if fields.get("warc-type") == "response":
                out += _derived(fields, block)
    except ValueError as e:
        out.append({"error": str(e)})
    return out


def _derived(fields: dict[str, str], block: bytes) -> list[dict]:
    status, headers, payload = split_http(block)
    content, error = b"", None
    try:
        content = decoded(headers, payload)
    except ValueError as e:
        error = str(e)
    kind = text_kind(headers, content) if error is None else ""
    text, title, lang, links = "", "", "", []
    if kind == "markup":
        text, title, lang, links = html_text(content.decode(_charset(headers, content), "replace"))
    elif kind == "plain":
        text = content.decode(_charset(headers, content), "replace")
    own = fields.get("warc-record-id") or record_id("response", fields.get("warc-target-uri", ""), digest(block))
    target, date = fields.get("warc-target-uri", ""), fields.get("warc-date", "")
    kept = [("WARC-Refers-To", own), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Target-URI", target)]
    source_digest = fields.get("warc-payload-digest") or digest(payload)
    about = [("status", status), *((f"header-{k.lower()}", v) for k, v in headers), ("source-block-digest", fields.get("warc-block-digest") or digest(block)), ("source-payload-digest", source_digest)]
    about += [("title", title), ("language", lang), ("outlinks", str(len(links))), *(("outlink", x) for x in links)]
    body = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in about).encode()
    meta_id, text_id, plain = record_id("metadata", own), record_id("conversion", own), text.encode()
    made = [("metadata", meta_id, "application/warc-fields", body, [("WARC-Concurrent-To", text_id)] if kind else [])]
    if kind:
        made.append(("conversion", text_id, "text/plain; charset=utf-8", plain, [("WARC-Concurrent-To", meta_id), ("WARC-Payload-Digest", digest(plain))]))
    out = []
    for which, rid, content_type, data, links_to in made:
        linked = [("WARC-Record-ID", rid), *kept, *links_to, ("Content-Type", content_type)]
        out.append({"record_type": which, "record_id": rid, "refers_to": own, "target_uri": target, "source_payload_digest": source_digest, "block_digest": digest(data), "content_length": len(data), "title": title, "language": lang, "text": text if which == "conversion" else None, "record": record(which, linked, data), "error": error if which == "metadata" else None})
    return out


_SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, title string, language string, text string, record binary, error string"


def build_derivatives(records: DataFrame, id_col: str, record_col: str = "record", rows: int = 64) -> DataFrame:
    """(id, the columns of a derivative, error) for frames of WARC records as bytes, one or several in a row each.

    One narrow stage, ``rows`` sources at a time. Null and empty bytes give nothing; where bytes go on with no WARC
    record there is one row with ``error`` and nulls behind the derivatives of the good records before, so that none is
    lost silently. Null ids are kept, and rows that repeat
    give equal derivatives with equal record ids.
    """
    schema = pa.schema([(id_col, pa.int64()), *((n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _SCHEMA.split(", ")))])

    empty = dict.fromkeys(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                out = []
                for i, data in zip(*(whole.slice(at, rows).column(k).to_pylist() for k in (0, 1))):
                    out += [empty | d | {id_col: i} for d in derive(data or b"")]
                yield pa.RecordBatch.from_pylist(out, schema)

    frame = records.select(F.col(id_col).cast("long").alias(id_col), F.col(record_col).cast("binary").alias("__record"))
    return frame.mapInArrow(run, f"{id_col} long, {_SCHEMA}")


def pages_to_responses(pages: DataFrame, date: datetime, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record) of response records around pages; null addresses and null pages count as empty."""
    stamp = date.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(u or "", h, stamp) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], [id_col, "record"])

    frame = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias("__url"), F.col(html_col).cast("string").alias("__html"))
    return frame.mapInArrow(run, f"{id_col} long, record binary")
