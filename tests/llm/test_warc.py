"""WARC derivatives: links between records, digests, the text, and the round trip through files."""

from __future__ import annotations

import hashlib
import time
from html.parser import HTMLParser

from boresight.llm import queries as q
from boresight.llm import warc
from boresight.llm.warc import as_responses, derive, read_warc, visible_text, write_warc


class Shown(HTMLParser):
    """Words of a page by the library's parser."""

    def __init__(self) -> None:
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def letters(text: str) -> str:
    return "".join(text.split())


def test_whole_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    made = derive(as_responses(spark.read.parquet(f"{sf}/pages.parquet"))).collect()
    assert len(made) == 2 * len(pages) == q.op2_warc(spark, sf).count()
    by_page: dict = {}
    for r in made:
        by_page.setdefault(r.source_key, {})[r.warc_type] = r
        block = r.content.encode()
        assert r.block_digest == f"sha256:{hashlib.sha256(block).hexdigest()}" and r.content_length == len(block)
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and f"WARC-Block-Digest: {r.block_digest}" in r.header
        assert r.source_digest == f"sha256:{hashlib.sha256(pages[r.source_key].html.encode()).hexdigest()}"
    for page_id, pair in by_page.items():
        about, text = pair["metadata"], pair["conversion"]
        assert about.refers_to == text.refers_to and about.record_id != text.record_id
        assert f"conversion-record: {text.record_id}\r\n" in about.content
        assert "source-status: HTTP/1.1 200 OK\r\nsource-header: Content-Type: text/html; charset=utf-8\r\n" in about.content
        seen = Shown()
        seen.feed(pages[page_id].html)
        seen.close()
        assert letters("".join(seen.words)) == letters(text.content)
    assert len({r.record_id for r in made}) == len(made)


def test_text():
    assert visible_text("<p>a&nbsp;b<br>c</p><script>x<p></script>d<b>e</b>") == "a b\nc\nde"
    assert visible_text("") == "" and visible_text("<script>never closed") == ""
    assert visible_text("1 < 2 &amp;&amp; <!-- <p>no</p> -->ok") == "1 < 2 && ok"


def test_cases(spark, tmp_path):
    rows = [(1, None, None, 0), (2, "http://a/x y\r\nEvil: 1", "<a href='/b'>t</a>" + "w " * 50_000, 0), (3, "http://a/", "<p>x\r\n\r\ny</p>", 0), (3, "http://a/", "<p>x\r\n\r\ny</p>", 0)]
    made = derive(as_responses(spark.createDataFrame(rows, "page_id long, url string, html string, payload int")))
    found = made.collect()
    assert len(found) == 8 and not any("\r\nEvil" in r.header for r in found)
    assert {r.content for r in found if r.source_key == 1 and r.warc_type == "conversion"} == {""}
    write_warc(made, str(tmp_path / "out"))
    back = {(r.header["WARC-Record-ID"], bytes(r.block)) for r in read_warc(spark, str(tmp_path / "out")).collect()}
    assert back == {(r.record_id, r.content.encode()) for r in found}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert derive(as_responses(empty)).count() == 0


def test_hostile_pages_end_soon():
    """Codec names that decode no text, and broken markup on which a search of patterns takes the square of the length."""
    began = time.perf_counter()
    for name in ("undefined", "idna", "punycode", "base64", "no-such", "utf-16"):
        for headers, page in ((f"HTTP/1.1 200 OK\nContent-Type: text/html; charset={name}", b"<p>a\xff"), ("HTTP/1.1 200 OK", f"<meta charset={name}><p>a".encode() + b"\xff" * 3000)):
            assert len(warc.derivatives("<urn:x>", None, "", headers, page, None)) == 2
    for piece in ("<a x ", "<title>", "<html ", "<head>", "<script>", "<!-- ", "<a href='", "</", "<p>&amp;", "<meta ", "<a href=x>"):
        for end in ("", ">", "</title></head></script>-->"):
            warc.derivatives("<urn:x>", "http://a/", "", "HTTP/1.1 200 OK", (piece * (1_000_000 // len(piece)) + end).encode(), None)
    assert time.perf_counter() - began < 60
    assert warc.decoded(b"x" * 5000 + "<meta charset=latin-1>\xe9".encode("latin-1"), "").endswith("\xe9")
