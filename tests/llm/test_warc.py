import base64
import gzip
import hashlib
import random
import re
import zlib
from datetime import datetime, timezone

import pytest

from newsquery.llm import warc

DATE = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
PAGE = "<html lang=fr><head><title>A &amp; B</title><style>p{}</style><body><nav><a href='/x'>Nav</a></nav><p>One<br>two <b>three</b><script>var t='</p>'</script><p>été &lt;4&gt;<!-- no --><div>unclosed"


def test_text_of_bad_markup():
    text, title, lang, links = warc.html_text(PAGE)
    assert text.split("\n") == ["Nav", "One", "two three", "été <4>", "unclosed"]
    assert (title, lang, links) == ("A & B", "fr", ["/x"])
    assert warc.html_text("")[0] == "" and warc.html_text("<<<>< & plain")[0]


def test_records_round_trip():
    sources = [warc.response("http://a.example/1", PAGE, "2024-01-02T03:04:05Z"), warc.response("http://b.example/", None, "2024-01-02T03:04:05Z")]
    made = warc.derive(b"".join(sources))
    assert [d["record_type"] for d in made] == ["metadata", "conversion"] * 2
    (source, block), *_ = warc.parse(sources[0])
    for d in made[:2]:
        [(fields, own)] = warc.parse(d["record"])
        assert fields["warc-refers-to"] == source["warc-record-id"] == d["refers_to"]
        assert fields["warc-target-uri"] == "http://a.example/1" and fields["warc-date"] == "2024-01-02T03:04:05Z"
        assert fields["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(own).digest()).decode() == d["block_digest"]
        assert int(fields["content-length"]) == len(own) == d["content_length"]
    meta, plain = (warc.parse(d["record"])[0] for d in made[:2])
    assert meta[0]["warc-concurrent-to"] == plain[0]["warc-record-id"] and plain[0]["warc-concurrent-to"] == meta[0]["warc-record-id"]
    assert plain[1].decode() == made[1]["text"] and made[1]["text"].startswith("Nav\nOne")
    _, headers, payload = warc.split_http(block)
    assert f"source-payload-digest: {warc.digest(payload)}".encode() in meta[1]
    assert b"header-content-type: text/html; charset=utf-8" in meta[1] and b"status: HTTP/1.1 200 OK" in meta[1]
    assert warc.derive(b"".join(sources)) == made


def test_foreign_records():
    block = "HTTP/1.0 200 OK\r\ncontent-type: text/html; charset=iso-8859-1\r\nX-A: b\r\n\r\n<p>caf\xe9".encode("latin-1")
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nwarc-target-uri: http://c/\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    other = warc.record("request", [("WARC-Record-ID", "<urn:x:2>")], b"GET /")
    made = warc.derive(other + head + block + b"\r\n\r\n")
    assert [d["refers_to"] for d in made] == ["<urn:x:1>"] * 2 and made[1]["text"] == "café"
    assert b"header-x-a: b" in made[0]["record"]
    with pytest.raises(ValueError):
        warc.parse(b"no record\r\n\r\n")


def test_frames(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE, "x"), (2, None, None, "x"), (None, "http://b/", "", "x"), (1, "http://a/", PAGE, "x"), (5, "http://l/", "<p>" + "word " * 300000, "x")], "page_id long, url string, html string, record string")
    got = warc.build_derivatives(warc.pages_to_responses(pages, DATE), "page_id").collect()
    assert len(got) == 10 and all(r["error"] is None for r in got)
    assert len({r["record_id"] for r in got if r["page_id"] == 1}) == 2
    assert max(r["content_length"] for r in got) == 300000 * 5 - 1
    bad = spark.createDataFrame([(7, bytearray(b"junk")), (8, None), (9, bytearray())], "page_id long, record binary")
    assert [(r["page_id"], r["error"]) for r in warc.build_derivatives(bad, "page_id").collect()] == [(7, "no WARC record at byte 0")]
    assert warc.build_derivatives(warc.pages_to_responses(pages.limit(0), DATE), "page_id").collect() == []


def http(headers, payload, **fields):
    block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + payload
    return warc.record("response", [("WARC-Record-ID", "<urn:x:1>"), ("WARC-Target-URI", "http://a.example/"), ("WARC-Date", "2024-01-02T03:04:05Z"), *fields.items()], block)


def chunked(data, size):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(b"%x;x=y\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


@pytest.mark.parametrize("size", [1, 7, 10000])
@pytest.mark.parametrize("coding", ["", "gzip", "deflate", "raw deflate", "x-gzip"])
def test_codings_give_the_plain_page(coding, size):
    page = PAGE.encode()
    raw = zlib.compressobj(wbits=-15)
    coded = {"": page, "gzip": gzip.compress(page[:30]) + gzip.compress(page[30:]), "x-gzip": gzip.compress(page), "deflate": zlib.compress(page), "raw deflate": raw.compress(page) + raw.flush()}[coding]
    headers = [("Content-Type", "text/html; charset=utf-8"), *([("Content-Encoding", coding.removeprefix("raw "))] if coding else [])]
    plain = warc.derive(http(headers[:1], page))
    for transfer, payload in (([], coded), ([("Transfer-Encoding", "chunked")], chunked(coded, size))):
        made = warc.derive(http(headers + transfer, payload))
        assert [d["text"] for d in made] == [d["text"] for d in plain]
        assert made[0]["source_payload_digest"] == warc.digest(payload) and made[0]["error"] is None


def test_only_text_is_converted():
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" * 20
    for headers, payload, want in [
        ([("Content-Type", "image/png")], png, None),
        ([], png, None),
        ([("Content-Type", "application/pdf")], b"%PDF-1.7", None),
        ([("Content-Type", "text/plain; charset=latin-1")], "a <b> \xe9".encode("latin-1"), "a <b> \xe9"),
        ([("Content-Type", "application/json")], b'{"a": 1}', '{"a": 1}'),
        ([], b" <p>x</p>", "x"),
        ([("Content-Type", "application/xhtml+xml")], b"<p>x</p>", "x"),
    ]:
        made = warc.derive(http(headers, payload))
        assert [d["record_type"] for d in made] == ["metadata"] + ["conversion"] * (want is not None)
        assert made[-1]["text"] == want
        assert all(warc.parse(d["record"]) for d in made)


@pytest.mark.parametrize(("headers", "payload"), [([("Content-Encoding", "gzip")], gzip.compress(b"x" * 999)[:-9]), ([("Content-Encoding", "br")], b"abc"), ([("Transfer-Encoding", "chunked")], b"ff\r\nshort"), ([("Content-Encoding", "deflate")], b"\xff\xff\xff")])
def test_damaged_payloads_are_named(headers, payload):
    [made] = warc.derive(http([("Content-Type", "text/html"), *headers], payload))
    assert made["record_type"] == "metadata" and made["error"]


def test_good_records_of_a_damaged_row_are_kept(spark):
    good = http([("Content-Type", "text/plain")], b"good")
    rows = [(1, good + good[:-20]), (2, good + b"garbage"), (3, b"garbage" + good), (4, good), (None, good), (5, None), (6, b""), (7, good.replace(b"Content-Length", b"Content-Size"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, record binary, error string")
    got = {}
    for r in warc.build_derivatives(df, "page_id").collect():
        got.setdefault(r["page_id"], []).append((r["record_type"], r["error"] is not None))
    both = [("metadata", False), ("conversion", False)]
    assert got == {1: [*both, (None, True)], 2: [*both, (None, True)], 3: [(None, True)], 4: both, None: both, 7: [(None, True)]}


def test_text_against_a_plain_reading():
    """Visible text of simple pages, cut out by patterns."""
    rng = random.Random(3)
    for _ in range(200):
        words = lambda: " ".join(rng.choice(["one", "two", "&amp;", "é", "3 &lt; 4", "<b>bold</b>", "<i>it</i>"]) for _ in range(rng.randint(1, 6)))  # noqa: E731, B023
        lines = [rng.choice(["<p>%s</p>", "<div>%s</div>", "<li>%s", "<h2>%s</h2>", "<script>var x = '%s'</script>", "<!-- %s -->", "<style>%s</style>"]) % words() for _ in range(rng.randint(0, 8))]
        seen = [re.sub(r"<[^>]*>", "", x).replace("&amp;", "&").replace("&lt;", "<") for x in lines if not x.startswith(("<script", "<!--", "<style"))]
        assert warc.html_text("<html><body>" + "\n".join(lines) + "</body></html>")[0] == "\n".join(seen)
