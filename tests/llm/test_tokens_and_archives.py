import base64
import gzip
import hashlib
import json
import random
import time
from html.parser import HTMLParser

import pytest
import regex
from conftest import SMALL

from tablescore.llm import queries, tokens, warc


def brute(model, word):
    best = [0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            v = model.step.get(word[start:end])
            if v and (best[end] is None or best[start] + v < best[end]):
                best[end] = best[start] + v
    return best[-1]


def test_trie_equals_word_by_word():
    model = tokens.Unigram(tokens.read_ranks())
    r = random.Random(1)
    words = list({bytes(r.choices(b"abcdeinstr \xc3\xa9", k=r.randint(1, 12))) for _ in range(800)} | {b"a" * 300, b"\x00\xff"})
    assert model.values(words) == {w: brute(model, w) for w in words}


def test_counts(spark):
    rows = [(1, "the cat sat"), (2, None), (3, ""), (3, "  \n x's 123 é汉 "), (None, "the the"), (4, "lorem " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'?' as cost")
    model, mask = tokens.Unigram(tokens.read_ranks()), (1 << tokens.COUNT_BITS) - 1
    split = regex.compile(tokens.PATTERN)
    for r in tokens.count(df).collect():
        v = [brute(model, w.encode()) for w in split.findall(r.text or "")[:50_000]]
        assert (r.n_pretokens, r.n_tokens, r.cost) == (len(v), sum(x & mask for x in v), sum(x >> tokens.COUNT_BITS for x in v) / 1e6)
    assert tokens.count(df.limit(0)).count() == 0


def test_token_query(spark):
    """All columns, word by word without the trie."""
    model, mask = tokens.Unigram(tokens.read_ranks()), (1 << tokens.COUNT_BITS) - 1
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    split = regex.compile(tokens.PATTERN)
    known = {w: brute(model, w.encode()) for w in {w for x in texts.values() for w in split.findall(x or "")}}
    rows = queries.op9_token_counts(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        v = [known[w] for w in split.findall(texts[r.doc_id] or "")]
        assert (r.n_pretokens, r.n_tokens, r.cost) == (len(v), sum(x & mask for x in v), sum(x >> tokens.COUNT_BITS for x in v) / 1e6)


def test_pieces_come_from_the_vocabulary():
    model = tokens.Unigram({b"a": 5, b"b": 6, b"ab": 0, b"abc": 1, b"c": 7})
    assert model.values([b"abc", b"aab"]) == {b"abc": model.step[b"abc"], b"aab": model.step[b"a"] + model.step[b"ab"]}


PAGES = [
    (1, "http://x/é?a=1&b=2", '<html><head><title>T &amp; <b>t</b></title></head><body><script>x="</p>"</script><p>One&nbsp;<a href="/l">two</a><br>three<p>four</p><!-- no --><a href=\'m\'>5</a></body></html>'),
    (2, None, None), (None, "http://y", ""), (3, "http://z", "<p>unclosed <!-- comment"), (3, "http://z", "<p>unclosed <!-- comment"), (4, "http://w", "<" * 50_000 + "a" * 50_000),
]


def test_derivatives(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as block", "'x' as record_id")
    sources = warc.responses(df)
    rows = warc.derive(sources).collect()
    by_id = {r.record_id: r for r in sources.collect()}
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        s = by_id[r.refers_to]
        assert (r.target_uri, r.date, r.payload_digest) == (s.target_uri, s.date, s.payload_digest) and r.block_digest == warc.digest(bytes(r.block)) and r.record_id != s.record_id
    first = {r.record_type: bytes(r.block).decode() for r in rows if r.page_id == 1}
    assert first["conversion"] == "One two\nthree\nfour\n5"
    meta = json.loads(first["metadata"])
    assert (meta["title"], meta["links"], meta["http-status"]) == ("T & t", ["/l", "m"], "HTTP/1.1 200 OK")
    assert ["WARC-Target-URI", "http://x/é?a=1&b=2"] in meta["warc-headers"] and meta["http-headers"][0] == ["Content-Type", "text/html; charset=utf-8"]
    assert warc.derive(sources.limit(0)).count() == warc.derive(warc.derive(sources)).count() == 0


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    records = warc.responses(df).unionByName(warc.derive(warc.responses(df)))
    want = sorted((tuple(r) for r in records.collect()), key=str)
    packed = [bytes(r.warc) for r in warc.archived(records).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(packed[:7]))
    (tmp_path / "b.warc").write_bytes(b"".join(gzip.decompress(x) for x in packed[7:]))
    assert sorted((tuple(r) for r in warc.read_archives(spark, str(tmp_path)).collect()), key=str) == want


def test_archive_query(spark):
    rows = queries.op10_warc(spark, SMALL).collect()
    assert len(rows) == 2 * spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert {r.record_type for r in rows} == {"metadata", "conversion"} and len({r.record_id for r in rows}) == len(rows)


def test_a_head_without_an_end_tag_ends_where_the_body_begins():
    body = '<p>Hello <a href="/l">world</a></p></body></html>'
    heads = ["<title>t</title>", "<title>a <p> b</title><meta charset=utf-8>", "<script>x='<p>'</script><style>p{}</style>", "<!-- <p> --> <link rel=x href=y>\n<noscript><img></noscript>", ""]
    for head in heads:
        for start in ("<body>", "<body class=x>", "", "</head><body>", "</head>"):
            page = f"<html><head>{head}{start}{body}"
            r = warc.response(1, "http://x", page)
            meta, text = (d["block"].decode() for d in warc.derivatives(r))
            assert text == "Hello world" and json.loads(meta)["links"] == ["/l"], page
    assert warc.plain_text("<head><title>t</title>plain <b>text</b>") == "plain text"
    assert warc.plain_text("<p>a<script>b<p>c") == warc.plain_text("<p>a<style>b<p>c") == warc.plain_text("<head></head>a<!-- b") == "a"
    assert warc.plain_text("<p>a<noscript>b<p>c") == "ab\nc" and warc.plain_text("a<template>b</template>c<header>d</header>") == "ac\nd"
    for x in ("<head>", "<noscript>", "<head><title>", "<head ", "<template", "<!--", "<head><meta>"):
        warc.plain_text(x * 20_000)


@pytest.mark.parametrize(
    ("page", "text", "title", "links"),
    [
        ('<p title="a>b">Hello</p>', "Hello", None, []),
        ("<!-- <title>old</title> <a href=no> --><title>new</title>", "new", "new", []),
        ('<a data-href="x" href="y">t</a>', "t", None, ["y"]),
        ('<a-card href="q">t</a-card><A HREF=Q class=x>u</A>', "tu", None, ["Q"]),
        ("<a title='href=\"no\"' href='a>b'>t</a>", "t", None, ["a>b"]),
        ("<a href = x href=y>t<a href>u<a href=''>v", "tuv", None, ["x", ""]),
        ("<p it's>a</p><p x=it's>b</p>", "a\nb", None, []),
        ("<script>if (a<b) x='</p>'</script>a<style>p>q{}</style >b", "ab", None, []),
        ('<template><a href="no"><title>no</title></template><title>yes</title>', "yes", "yes", []),
        ("<script>var t='<title>no</title>'</script><head><title>a &lt; b</title></head>c", "c", "a < b", []),
        ("a < b <= c <3 &lt;p&gt;", "a < b <= c <3 <p>", None, []),
        ("a<br/>b<BR>c<div\nclass=x>d", "a\nb\nc\nd", None, []),
        ("a<p x='never closed>b</p>c", "a", None, []),
        ("a<!doctype html>b<?xml x?>c</>d</ 3>e<!", "abcde", None, []),
        ("a<svg><title>in a picture</title></svg>b", "ain a pictureb", "in a picture", []),
        ("<head><meta content='<p>'><title>t</title><link href=x></head><body>b", "b", "t", []),
        ("<title>never closed <p>a", "never closed\na", None, []),
    ],
)
def test_tags_as_a_browser_sees_them(page, text, title, links):
    assert warc.scan(page) == (text, title, links)


def test_scanning_is_linear():
    for x in ("<a href=\"", "<a href='x' ", "<a =", "<p>", "<title>", "<a href=x>", "<!", "</", "<a b", "= \"", "<head><p>", "<script", "<noscript>", "<noframes>", "<head><noframes>", "<!-->"):
        began = time.perf_counter()
        warc.scan(x * 100_000)
        assert time.perf_counter() - began < 5, x


HIDES = {"script", "style", "noscript", "template", "head"}
ENDS_A_LINE = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())


class Reader(HTMLParser):
    """Title, links and visible text of a page with all its end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.title, self.links, self.text, self.in_title = 0, None, [], [], False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDES
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        if tag == "a" and not self.hidden and (href := dict(attrs).get("href")) is not None:
            self.links.append(href)
        if tag in ENDS_A_LINE and not self.hidden:
            self.text.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.hidden -= tag in HIDES

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDES
        self.in_title = self.in_title and tag != "title"
        if tag in ENDS_A_LINE and not self.hidden:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.hidden:
            self.text.append(regex.sub(r"\s+", " ", data))


def test_derivatives_equal_a_parsers(spark):
    """Both records of every page of the small table, by a parser of its own."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(pages.select("page_id", "url", "html"))).collect()}
    digests = {(r.page_id, r.record_type): r for r in queries.op10_warc(spark, SMALL).collect()}
    pages = pages.collect()
    assert len(rows) == len(digests) == 2 * len(pages)
    for p in pages:
        want = Reader()
        want.feed(p.html or "")
        want.close()
        lines = [regex.sub(r"\s+", " ", x).strip() for x in "".join(want.text).split("\n")]
        text = "\n".join(x for x in lines if x)
        meta, conversion = (bytes(rows[p.page_id, k].block) for k in ("metadata", "conversion"))
        assert conversion.decode() == text, p.page_id
        got = json.loads(meta)
        assert (got["title"], got["links"]) == (want.title and want.title.strip(), list(dict.fromkeys(want.links))), p.page_id
        payload = "sha1:" + base64.b32encode(hashlib.sha1((p.html or "").encode()).digest()).decode()
        for kind, block in (("metadata", meta), ("conversion", conversion)):
            d = digests[p.page_id, kind]
            assert (d.content_length, d.block_sha256) == (len(block), hashlib.sha256(block).hexdigest())
            assert (d.target_uri, d.payload_digest, d.refers_to) == (p.url, payload, warc.response(p.page_id, p.url, p.html)["record_id"])
