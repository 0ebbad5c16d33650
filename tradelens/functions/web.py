"""URLs, hosts and markup, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels under which shops register names.
SECOND_LEVEL = ("com.bg", "org.bg", "net.bg", "edu.bg", "gov.bg", "co.uk", "com.tr")


def host_of(url: Column) -> Column:
    """Lower-case host without www and port."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^https?://([^/:?#]+)", 1), r"^www\.", "")


def registrable(host: Column) -> Column:
    """The last two labels, or three below a two-level suffix; a www before and dots around don't count."""
    p = F.split(F.regexp_replace(F.lower(host), r"^\.+|\.+$|^\.*www\.", ""), r"\.")
    last = F.concat_ws(".", F.slice(p, F.greatest(F.size(p) - 1, F.lit(1)), 2))
    three = F.concat_ws(".", F.slice(p, F.greatest(F.size(p) - 2, F.lit(1)), 3))
    return F.when(last.isin(*SECOND_LEVEL), three).otherwise(last)


def url_error(url: Column) -> Column:
    """Why a URL is refused; null where it isn't. The first reason that holds."""
    host = F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]*)", 1)
    port = F.regexp_extract(url, r"^[a-zA-Z]+://[^/:?#]*:([0-9]+)", 1)
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "empty")
        .when(F.length(url) > 2048, "too_long")
        .when(url.rlike(r"[\x00-\x20]"), "whitespace")
        .when(~F.lower(url).rlike(r"^https?://"), "scheme")
        .when(url.rlike(r"^[a-zA-Z]+://[^/?#]*@"), "credentials")
        .when((port != "") & ~port.isin("80", "443"), "port")
        .when(host == "", "no_host")
        .when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip_address")
        .when(~host.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"), "host_shape")
    )


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port and no fragment, a path at least."""
    u = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_replace(F.regexp_extract(F.lower(u), r"^(https?://[^/?]+)", 1), r":(80|443)$", "")
    rest = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?]+(.*)$", 1)
    return F.concat(head, F.when(rest == "", "/").otherwise(rest))


def stripped(html: Column) -> Column:
    """Markup without scripts (but those of structured data), styles, drawings, templates, noscript parts and comments."""
    heavy = r"<script(?![^>]*ld\+json)[^>]*>.*?</script>|<style[^>]*>.*?</style>|<svg[^>]*>.*?</svg>|<noscript[^>]*>.*?</noscript>|<template[^>]*>.*?</template>|<!--.*?-->"
    return F.regexp_replace(html, f"(?is){heavy}", "")


def links(html: Column) -> Column:
    """Values of href attributes in any quotes, in order, each once; not those within the page."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), 1)
    bare = F.transform(found, lambda x: F.trim(F.regexp_replace(x, "^[\"']|[\"']$", "")))
    return F.array_distinct(F.filter(bare, lambda x: (x != "") & ~x.startswith("#")))


def anchors(html: Column) -> Column:
    """array<struct(href, text)> of links with their text, tags inside left out and white space collapsed."""
    whole = lambda n: F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"), n)
    rows = F.arrays_zip(whole(1).alias("href"), whole(2).alias("text"))
    return F.transform(rows, lambda r: F.struct(F.trim(r["href"]).alias("href"), F.trim(F.regexp_replace(F.regexp_replace(r["text"], "<[^>]*>", " "), r"\s+", " ")).alias("text")))


def same_site(page: Column, link: Column) -> Column:
    """Whether an absolute link is another page, by http, of the page's registrable domain."""
    return link.rlike("(?i)^https?://") & (registrable(host_of(link)) == registrable(host_of(page))) & (canonical(link) != canonical(page))


def abroad(asked: Column, landed: Column) -> Column:
    """Whether a visit ended at another registrable domain under another top level."""
    a, b = host_of(asked), host_of(landed)
    return (registrable(a) != registrable(b)) & (F.substring_index(a, ".", -1) != F.substring_index(b, ".", -1))


def excerpt(text: Column, most: int = 200) -> Column:
    """White space collapsed, cut to so many characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def window(text: Column, pattern: str, reach: int = 40) -> Column:
    """What stands around the pattern's first match, `reach` characters on either side; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, excerpt(F.substring(text, F.greatest(at - reach, F.lit(1)), F.least(at, F.lit(reach + 1)) + F.length(F.regexp_substr(text, F.lit(pattern))) + reach - 1), 10_000))


def emails_in(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), 1), lambda x: F.lower(x)))


def suffixes(host: Column) -> Column:
    """All ends of a host by labels, longest first."""
    p = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), "."))


def ascii_url(url: Column) -> Column:
    """The host in its ASCII form and other characters outside ASCII and spaces percent-encoded, by Arrow; null where the
    host has no such form."""
    from urllib.parse import quote, urlsplit, urlunsplit

    @F.pandas_udf("string")
    def encoded(urls):
        def one(u):
            try:
                p = urlsplit(u)
                host = (p.hostname or "").encode("idna").decode("ascii")
                net = host + (f":{p.port}" if p.port else "")
                return urlunsplit((p.scheme, net, quote(p.path, "/%:@!$&'()*+,;=-._~"), quote(p.query, "/%:@!$&'()*+,;=-._~?"), quote(p.fragment, "%")))
            except (UnicodeError, ValueError, TypeError, AttributeError):
                return None

        return urls.map(one)

    return encoded(url)
