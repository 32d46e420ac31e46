"""Nearest vectors and WARC derivatives."""

import gzip
import html.parser
import os
import re
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import ann, warc
from tidemark.llm.common import scratch
from tidemark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_nearest(vectors, k, step):
    best = {}
    for q in (v for v in vectors if v % step == 0):
        scored = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        best[q] = scored[:k]
    return best


def as_dict(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    return found


def test_codes_estimate_within_the_bound():
    rng = np.random.default_rng(0)
    data, query = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    centre, turn = data.mean(axis=0), ann.rotation(64, 1)
    code, length, scalar = ann.encode(data, centre, turn)
    signs = np.unpackbits(code, axis=1, count=64).astype(float) * 2 - 1
    unit = (query - centre) / np.linalg.norm(query - centre)
    guess = signs @ (unit @ turn) / (8 * scalar)
    true = (data - centre) @ unit / length
    bound = np.sqrt(1 - scalar**2) / scalar * ann.EPSILON / np.sqrt(63)
    assert abs((guess - true).mean()) < 0.01 and (np.abs(guess - true) <= bound).mean() > 0.99


def test_query_has_full_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = plain_nearest({r.vec_id: np.array(r.embedding, np.float64) for r in rows}, 10, 100)
    got = as_dict(QUERIES["op10_nearest_vectors"](spark, sf).collect())
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.99
    for q, found in got.items():
        exact = {i: s for s, i in want[q]}
        assert all(s == pytest.approx(exact[i], rel=1e-12) for s, i in found if i in exact)


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)], 0) for i in range(300)]
    rows += [(i, [1.0] * 8, 0) for i in range(300, 420)]  # ties
    rows = [r for r in rows if any(r[1])]
    good = {r[0]: np.array(r[1], np.float64) for r in rows}
    rows += rows[:50]  # repeated rows
    rows += [(1000, None, 0), (1100, [0.0] * 8, 0), (1200, [1.0, None] * 4, 0), (1300, [float("nan")] * 8, 0), (1400, [float("inf")] * 8, 0), (1500, [1.0], 0), (None, [1.0] * 8, 0)]
    index = ann.build(spark.createDataFrame(rows, SCHEMA).repartition(7))
    got = as_dict(ann.search(index, index.rows.filter("vec_id % 10 = 0"), 10, block=16).collect())
    assert got == plain_nearest(good, 10, 10)


def test_few_and_no_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 0), (100, [1.0, 3.0], 0)], SCHEMA)
    index = ann.build(rows)
    assert as_dict(ann.search(index, index.rows).collect()) == {0: [(1.0, 100)], 100: [(1.0, 0)]}
    assert ann.build(rows.limit(0)) is None
    assert ann.search(index, index.rows.limit(0)).count() == 0


# --- WARC -------------------------------------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:1}</style></head><body><script>var t='</p>';</script>"
    "<!-- gone --><h1>Caf&eacute;</h1><p>one <b>two</b>\n three<br>four &lt;5 < 6</p></body></html>"
)


def test_html_to_text():
    assert warc.html_to_text(PAGE) == "Café\none two three\nfour <5 < 6"
    assert warc.html_to_text("") == "" and warc.html_to_text("<p") == "" and warc.html_to_text("<!-- open") == ""
    assert warc.html_to_text("<script>open") == "" and warc.html_to_text("a<br/>b") == "a\nb"


def pages(spark):
    rows = [(1, "http://a/1", PAGE), (2, None, "<p>x"), (3, "http://a/3", None), (4, "http://a/4", ""), (None, "u\r\nX: y", "t"), (1, "http://a/1", PAGE), (5, "http://a/5", "<p>" + "long " * 40000)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, headers string, block int").repartition(3)


def test_records_survive_files(spark):
    path = scratch(spark, "w")
    records = warc.responses_of_pages(pages(spark), "2024-01-01T00:00:00Z")
    files = warc.write_records(records, path).collect()
    key = lambda r: (r.record_id, r.headers, bytes(r.block))
    assert sorted(map(tuple, records.collect()), key=str) == sorted(map(tuple, warc.read_records(spark, path).collect()), key=str)
    assert sum(f.records for f in files) == 7 and len({key(r) for r in records.collect()}) == 6
    assert warc.write_records(records.limit(0), scratch(spark, "w")).count() == 0


def test_plain_files_and_damage():
    rows = [warc.record("response", "<urn:uuid:1>", b"a\r\n\r\nWARC/1.1", "application/http", {"WARC-Date": "d"})]
    packed = warc.serialise(rows[0][6], rows[0][7])
    assert list(warc.parse(packed * 2)) == list(warc.parse(gzip.decompress(packed) * 2)) == [rows[0][6:]] * 2
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nno end"))


def test_derivatives_are_linked(spark):
    records = warc.responses_of_pages(pages(spark), "2024-01-01T00:00:00Z").collect()
    for r in records:
        meta, text = warc.derived(r.headers, bytes(r.block))
        m, t, s = (warc.fields_of(h) for h in (meta[6], text[6], r.headers))
        assert meta[1] == "metadata" and text[1] == "conversion" and meta[2] == text[2] == r.record_id
        assert t["warc-concurrent-to"] == m["warc-record-id"] and meta[0] != text[0]
        for by, row in ((m, meta), (t, text)):
            assert by.get("warc-target-uri") == s.get("warc-target-uri") and by["warc-date"] == s["warc-date"]
            assert by["warc-source-payload-digest"] == s["warc-payload-digest"]
            assert by["warc-block-digest"] == warc.digest(row[7]) and int(by["content-length"]) == len(row[7])
        notes = meta[7].decode()
        assert f"source-block-digest: {s['warc-block-digest']}\r\n" in notes and f"conversion-record: {text[0]}\r\n" in notes
        assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in notes
        page = bytes(r.block).partition(b"\r\n\r\n")[2].decode()
        assert text[7].decode() == warc.html_to_text(page)


def test_other_records():
    image = warc.record("response", "<urn:uuid:2>", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG", "application/http", {})
    assert [r[1] for r in warc.derived(*image[6:])] == ["metadata"]
    assert warc.derived(*warc.record("request", "<urn:uuid:3>", b"", "x", {})[6:]) == []
    bare = warc.record("response", "<urn:uuid:4>", b"", "application/http", {})
    assert [r[1] for r in warc.derived(*bare[6:])] == ["metadata"]
    latin = warc.record("response", "<urn:uuid:5>", b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n\xe9", "application/http", {})
    assert warc.derived(*latin[6:])[1][7].decode() == "é"


def test_warc_query(spark, sf):
    source = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op8_warc_derivatives"](spark, sf).collect()
    assert len(rows) == 2 * len(source) and {r.page_id for r in rows} == source.keys()
    for r in rows:
        if r.warc_type == "conversion":
            assert r.block == warc.html_to_text(source[r.page_id].html) and r.target_uri == source[r.page_id].url


def test_head_and_custom_elements():
    text = warc.html_to_text
    assert text("<html><head><title>t</title><body><p>whole text here</body></html>") == "whole text here"
    assert text("<head><meta charset=utf-8><title>t</title><p>first<p>second") == "first\nsecond"
    assert text("<title>t</title>words") == "words" and text("<html><head>\n<body>words") == "words"
    assert text("<head-line>real words</head-line> and rest") == "real words and rest"
    assert text("<template-x>a</template-x> <style-x>b</style-x> <p-x>c</p-x> d") == "a b c d"
    assert text("<head><script>var s='</head>'; code()</script><title>t</title></head><body>words") == "words"
    assert text("<script>a</script-x>b</script >words") == "words" and text("<style/>p{}</style\n>words") == "words"
    assert warc.TITLE.search("<title-bar>no</title-bar><title lang=en>yes</title >")[1] == "yes"


def response(payload: bytes, *heads: str, kind="text/html; charset=utf-8"):
    head = "\r\n".join(["HTTP/1.1 200 OK", f"Content-Type: {kind}", *heads]).encode()
    return warc.record("response", "<urn:uuid:9>", head + b"\r\n\r\n" + payload, "application/http", {})


def chunked(data: bytes, size=7) -> bytes:
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(f"{len(p):x};note=1\r\n".encode() + p + b"\r\n" for p in parts) + b"0\r\nTrailer: x\r\n\r\n"


def test_encodings_are_undone():
    page = "<html><title>Tïtle</title><body><p>größe 日本</p>" + "<p>more</p>" * 3000
    plain, data = warc.html_to_text(page), page.encode()
    raw = zlib.compressobj(wbits=-15)
    cases = [
        (gzip.compress(data), ["Content-Encoding: gzip"]),
        (gzip.compress(data[:99]) + gzip.compress(data[99:]), ["Content-Encoding: X-GZIP"]),
        (zlib.compress(data), ["Content-Encoding: deflate"]),
        (raw.compress(data) + raw.flush(), ["Content-Encoding: deflate"]),
        (chunked(data), ["Transfer-Encoding: chunked"]),
        (chunked(gzip.compress(data)), ["Transfer-Encoding: chunked", "Content-Encoding: gzip"]),
        (chunked(zlib.compress(gzip.compress(data))), ["Content-Encoding: gzip, deflate", "transfer-encoding: Chunked"]),
        (data, ["Content-Encoding: gzip"]),  # undone by the crawler already
        (data, ["Transfer-Encoding: chunked"]),
        (data, ["Content-Encoding: identity"]),
    ]
    for payload, heads in cases:
        r = response(payload, *heads)
        meta, text = warc.derived(*r[6:])
        assert text[7].decode() == plain, heads
        notes = meta[7].decode()
        assert "title: Tïtle\r\n" in notes and f"source-payload-digest: {warc.digest(payload)}\r\n" in notes
        assert f"source-content-length: {len(payload)}\r\n" in notes
    assert [r[1] for r in warc.derived(*response(data, "Content-Encoding: br")[6:])] == ["metadata"]
    short = warc.derived(*response(gzip.compress(data)[:-500], "Content-Encoding: gzip")[6:])
    assert plain.startswith(short[1][7].decode()[:20]) and len(short) == 2
    assert warc.dechunked(b"5\r\nab") == b"ab" and warc.dechunked(b"") == warc.dechunked(b"zz\r\nab") == b""


def test_reader_is_linear():
    rows = [warc.serialise("WARC-Type: response\nContent-Length: 3000", bytes([i % 251]) * 1000 + os.urandom(2000)) for i in range(2000)]
    data = b"".join(rows * 4)  # about 16 MB
    began = time.process_time()
    assert sum(len(b) for _, b in warc.parse(data)) == 8000 * 3000
    assert time.process_time() - began < 3
    with pytest.raises(ValueError):
        list(warc.parse(data[:-100]))


def plain_text(page):
    """Text of a page by the standard library's parser, in the test's own words."""

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.silent = [], 0

        def handle_starttag(self, tag, attrs):
            self.silent += tag in ("script", "style", "title", "template", "noscript")
            self.out.append("\n" if tag in BREAKING else "")

        def handle_endtag(self, tag):
            self.silent -= tag in ("script", "style", "title", "template", "noscript")
            self.out.append("\n" if tag in BREAKING else "")

        def handle_data(self, data):
            if not self.silent:
                self.out.append(" ".join(data.split()) and re.sub(r"\s+", " ", data) or (" " if data else ""))

    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = "".join(reader.out).split("\n")
    return "\n".join(" ".join(line.split()) for line in lines if line.split())


BREAKING = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}


def test_query_against_a_parser(spark):
    sf = "/root/testdata/sf0.01"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = [r for r in QUERIES["op8_warc_derivatives"](spark, sf).collect() if r.warc_type == "conversion"]
    assert {r.page_id for r in rows} == source.keys()
    for r in rows:
        assert r.block == plain_text(source[r.page_id]), r.page_id
