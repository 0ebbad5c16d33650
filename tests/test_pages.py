"""The page reader against the standard library's parser on real and broken pages, and its time."""

import random
import re
import time
from html.parser import HTMLParser

from tradelens.functions import pages
from tradelens.operators import lines


class Plain(HTMLParser):
    """Pieces by events of another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.raw = [], "", False

    def cut(self):
        if self.held.split():
            self.out.append(" ".join(self.held.split()))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        self.raw = tag in pages.RAW_TAGS
        if tag in pages.BLOCK_TAGS:
            self.cut()

    def handle_endtag(self, tag):
        self.raw = False
        if tag in pages.BLOCK_TAGS:
            self.cut()

    def handle_data(self, data):
        if not self.raw:
            self.held += data
            if "\n" in data or len(data) > pages.LONG:
                self.cut()


def plain(html):
    p = Plain()
    p.feed(html)
    p.close()
    p.cut()
    return p.out


def test_pieces_of_real_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    assert len(rows) == 250
    for r in rows:
        assert pages.read(r.html)["pieces"] == plain(r.html), r.page_id


def test_pieces_of_made_pages():
    rng = random.Random(13)
    parts = ["<p>", "</p>", "<div class='a > b'>", "</div>", "<b>", "</b>", "text ", "&amp;", "&#1041;", "\n", "<br/>", "<span>", "</span>", "<td>", "x" * 500, "<a href='/x'>", "</a>", "<!-- <p>c</p> -->", "<script>var a = '<p>';</script>", "<style>p > a {}</style>", "<!doctype html>"]
    for _ in range(300):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pages.read(html)["pieces"] == plain(html), html


def test_broken_pages_take_linear_time():
    for html in ("<div>" * 20_000 + "ЕИК: 123456786" + "</div>" * 20_000, "<a href=\"" * 50_000, "<a '" * 50_000 + ">", "<" * 200_000, "<!--" * 50_000, "<script>" * 50_000):
        began = time.perf_counter()
        got = pages.read(html)["pieces"]
        assert time.perf_counter() - began < 1, html[:20]
        assert not html.startswith("<div>") or got == ["ЕИК: 123456786"]


def test_links():
    assert pages.read('<a href="/a">one <b>two</b></a><a>no</a><a href=" MailTo: x@y.example?b=c ">m</a>')["links"] == [{"href": "/a", "text": "one two"}, {"href": " MailTo: x@y.example?b=c ", "text": "m"}]
    assert pages.read(None) == {"pieces": [], "links": [], "mails": [], "phones": []}
    assert pages.read('<a href=" MailTo: x@y.example?b=c ">m')["mails"] == ["x@y.example"]


def test_pieces_of_the_reader_as_rows(spark):
    df = spark.createDataFrame([(1, "<div>a<div>b"), (2, None)], "page int, html string")
    got = lines.piece_rows(df, pages.page_parts("html")["pieces"]).collect()
    assert [(r.page, r.i, r.piece) for r in got] == [(1, 0, "a"), (1, 1, "b")]
    assert re.match("a", got[0].piece)
