import base64
import hashlib
import html
import time
from html.parser import HTMLParser

import pytest

from skewlens.llm import warc as w


class Reference(HTMLParser):
    """The standard library's parser, for well-formed pages."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.skip = [], [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.out.append("\n" if tag in w.BLOCK else "")
        self.skip += tag in w.RAW
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.out.append("\n" if tag in w.BLOCK else "")
        self.skip -= tag in w.RAW

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_given_pages_like_the_standard_parser(spark):
    n = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        ref = Reference(r.html)
        _, _, links, text = w.parse(r.html)
        if "<noscript" in r.html or "<template" in r.html:
            continue
        assert [html.unescape(x) for x in ref.links] == links
        assert text == ref.text(), r.page_id
        n += 1
    assert n > 10


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain", "plain"), ("a<b", "a"), ("a < b > c", "a < b > c"), ("<p>x<!-- never <p>y", "x"), ("<script>1<p>", ""),
    ("<p>one<br>two</p>three", "one\ntwo\nthree"), ("<p title='a>b'>x</p>", "x"), ("<p title='never ends>x</p>y", "x\ny"),
    ("a&amp;b &eacute; &#x41;", "a&b é A"), ("<title>t</title><STYLE>p{}</STYLE><P>x", "x"), ("<?xml version='1'?><!DOCTYPE html>x", "x"),
])
def test_markup(page, text):
    assert w.parse(page)[3] == text


@pytest.mark.parametrize("page", ["<" * 300_000, "<a '" * 100_000, "<!--" * 100_000, "<script>" * 50_000, "<p " * 100_000, "<a href=" * 60_000, "</" * 200_000])
def test_broken_markup_takes_linear_time(page):
    start = time.process_time()
    w.parse(page)
    assert time.process_time() - start < 5


def frame(spark, rows):
    return spark.createDataFrame([r + ("x", "y") for r in rows], "page_id bigint, url string, html string, block string, record_id string")


def test_records_are_linked(spark):
    page = '<html lang="fr"><title>T  t</title><p>Été</p><a href="/x?a=1&amp;b=2">l</a>'
    rows = [(1, "http://a.b/c", page), (2, None, None), (3, "http://x\r\nWARC-Type: evil", "x"), (1, "http://a.b/c", page)]
    sources = {(r.key, r.record_id): r for r in w.responses(frame(spark, rows)).collect()}
    got = w.derive(w.responses(frame(spark, rows))).collect()
    assert len(got) == 8
    for r in got:
        s = sources[r.key, r.refers_to]
        body = bytes(s.block).partition(b"\r\n\r\n")[2]
        assert (r.target_uri, r.date, r.payload_digest) == (s.target_uri, s.date, s.payload_digest)
        assert s.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.block_digest == w.digest(bytes(r.block)) and r.content_length == len(r.block)
        assert "\n" not in r.target_uri
    one = {r.record_type: bytes(r.block).decode() for r in got if r.key == 1}
    assert one["conversion"] == "Été\nl"
    assert "title: T t\r\n" in one["metadata"] and "outlink: /x?a=1&b=2\r\n" in one["metadata"] and "language: fr\r\n" in one["metadata"]
    assert "http-status: HTTP/1.1 200 OK\r\n" in one["metadata"]
    assert len({r.record_id for r in got}) == 6


def test_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = w.responses(pages).union(w.derive(w.responses(pages)))
    files = w.write_warc(records.repartition(3), f"file://{tmp_path}/w")
    assert len(files) == 3
    as_set = lambda df: {tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()}
    back = w.read_warc(spark, f"file://{tmp_path}/w")
    assert as_set(back) == as_set(records)
    assert as_set(w.derive(back)) == as_set(w.derive(w.responses(pages)))


def test_all_source_headers_are_preserved(spark, tmp_path):
    head = "HTTP/1.1 203 Odd\r\nServer: x y\r\nContent-Type: text/html\r\nETag: \"a:b\"\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2;\r\n  path=/\r\nX Odd Name: v"
    block = head.encode() + b"\r\n\r\n<title>t</title>x"
    more = ["WARC-IP-Address: 10.0.0.1", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>"]
    source = (*w.record(5, "response", None, "http://a", w.DATE, "application/http", "sha1:X", block)[:-1], "\r\n".join(more))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(w.packed(source))
    read = w.read_warc(spark, str(tmp_path / "in"))
    assert [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in read.collect()] == [source]
    w.write_warc(read, str(tmp_path / "again"))
    assert w.read_warc(spark, str(tmp_path / "again")).first().headers == "\r\n".join(more)
    meta = next(bytes(r.block).decode() for r in w.derive(read).collect() if r.record_type == "metadata").split("\r\n")
    for line in ["http-status: HTTP/1.1 203 Odd", "http-server: x y", "http-content-type: text/html", 'http-etag: "a:b"', "http-set-cookie: a=1",
                 "http-set-cookie: b=2; path=/", "http-x-odd-name: v", "source-warc-ip-address: 10.0.0.1", "source-warc-concurrent-to: <urn:a>",
                 "source-warc-concurrent-to: <urn:b>", "source-payload-digest: sha1:X"]:
        assert line in meta, line
    assert w.derive(read.drop("headers")).count() == 2


def test_empty(spark, tmp_path):
    assert w.derive(w.responses(frame(spark, []))).collect() == []
    (tmp_path / "none").mkdir()
    assert w.read_warc(spark, str(tmp_path / "none")).collect() == []
