"""What a page shows, by a reader of its tokens: pieces of text in order, links with their texts, mail and phone links.

markup.chunks does the same by regular expressions alone and stays on the JVM; it takes a page for well-formed. This reader
goes over a page once, from token to token, whatever is nested, left open or broken in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that end a piece of text where they open and close.
BLOCK_TAGS = frozenset("article aside br dd div dt footer h1 h2 h3 h4 h5 header hr li p section span td th tr".split())
#: Tags whose contents aren't text, up to their own end tag.
RAW_TAGS = ("script", "style")
#: Characters of a stretch of text that ends a piece.
LONG = 400

PAGE = "struct<pieces: array<string>, links: array<struct<href: string, text: string>>, mails: array<string>, phones: array<string>>"

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW_TAGS}


def _tag_end(html: str, at: int, spent: dict[str, int]) -> int:
    """Where the tag that is open at `at` ends: at the first > outside of quotes, or, where a quote stays open, at the first
    one. spent: the place after which a mark is known not to stand any more, so that no search is made twice."""
    i = at
    while m := _MARK.search(html, i):
        if m[0] == ">":
            return m.start()
        closed = -1 if spent.get(m[0], len(html)) <= m.end() else html.find(m[0], m.end())
        if closed < 0:
            spent[m[0]] = min(spent.get(m[0], len(html)), m.end())
            end = html.find(">", m.end())
            return end if end >= 0 else len(html)
        i = closed + 1
    return len(html)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text; open and close with a tag's name and attributes. Comments, declarations and the contents of
    scripts and styles are left out. Time in proportion to the page."""
    at, n, spent = 0, len(html), {}
    while at < n:
        here = html.find("<", at)
        if here < 0:
            yield "text", "", html[at:]
            return
        after = html[here + 1 : here + 2]
        if not (after.isalpha() and after.isascii()) and after not in ("/", "!", "?"):
            nxt = html.find("<", here + 1)
            yield "text", "", html[at : nxt if nxt >= 0 else n]
            at = nxt if nxt >= 0 else n
            continue
        if here > at:
            yield "text", "", html[at:here]
        if html.startswith("<!--", here):
            end = html.find("-->", here + 4)
            at = end + 3 if end >= 0 else n
        elif after in ("!", "?"):
            end = html.find(">", here)
            at = end + 1 if end >= 0 else n
        else:
            name = _NAME.match(html, here + (2 if after == "/" else 1))
            end = _tag_end(html, name.end() if name else here + 1, spent)
            at = end + 1
            if name is None:
                continue
            tag = name[0].lower()
            if after == "/":
                yield "close", tag, ""
                continue
            yield "open", tag, html[name.end() : end]
            if tag in RAW_TAGS and not html[name.end() : end].endswith("/"):
                stop = _RAW_END[tag].search(html, at)
                at = stop.start() if stop else n


def attribute(rest: str, name: str) -> str | None:
    """The last value that an opening tag gives an attribute; null without one."""
    out = None
    for m in _ATTRIBUTE.finditer(rest):
        if m[1].lower() == name:
            out = next((unescape(v) for v in m.groups()[1:] if v is not None), None)
    return out


def read(html: str | None) -> dict:
    """The parts of a page (PAGE)."""
    pieces, links, mails, phones = [], [], [], []
    held: list[str] = []
    link: tuple[str, list[str]] | None = None

    def cut():
        if text := " ".join("".join(held).split()):
            pieces.append(text)
        held.clear()

    for kind, tag, rest in tokens(html or ""):
        if kind == "text":
            data = unescape(rest)
            held.append(data)
            if link:
                link[1].append(data)
            if "\n" in data or len(data) > LONG:
                cut()
            continue
        if tag in BLOCK_TAGS:
            cut()
        if tag == "a" and kind == "open":
            href = attribute(rest, "href")
            link = None if href is None else (href, [])
            scheme, _, value = (href or "").strip().partition(":")
            value = value.partition("?")[0].strip()
            if value and scheme.strip().lower() in ("mailto", "tel"):
                (mails if scheme.strip().lower() == "mailto" else phones).append(value)
        elif tag == "a" and link:
            links.append({"href": link[0], "text": "".join(link[1]).strip()})
            link = None
    cut()
    return {"pieces": pieces, "links": links, "mails": mails, "phones": phones}


def page_parts(html: Column | str) -> Column:
    """The column's pages, each read once; a null page has empty parts."""
    import pyarrow as pa

    text = pa.list_(pa.string())
    link = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))
    kind = pa.struct([("pieces", text), ("links", link), ("mails", text), ("phones", text)])

    @F.arrow_udf(PAGE)
    def parts(column):
        return pa.array([read(x) for x in column.to_pylist()], kind)

    return parts(html)
