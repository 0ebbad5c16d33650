"""Bounded walks over captured pages: the legal crawl of a domain's hosts, and the archive's copies where hosts refuse.

What a domain's walk can meet is found first, a join a depth; then each domain is one row that holds these pages, its
queue, what it has seen and its budgets, and its walk is one fold over that row. So pages are shuffled as often as there are
depths, not once a fetch, and no join of theirs goes through the driver: rows that follow from keys are many more than Spark
takes them for, which is why these joins are told to merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scoped, tasks_for, written

#: Fetches of a legal crawl, its depth, and links of a page that count.
FETCHES, DEPTH, LINKS = 14, 2, 30
#: Documents and lookups of the archive for a domain, and the last tier of links that are followed there.
DOCUMENTS, LOOKUPS, ARCHIVE_TIER = 6, 10, 1

_ENTRY = "struct<tier: int, at: int, depth: int, url: string, host: string>"
_LINK = "array<struct<tier: int, url: string>>"


def with_links(pages: DataFrame, links: DataFrame, most: int = LINKS) -> DataFrame:
    """pages (url, ...) with links: array<struct<tier, url>>, the first `most` by seq. links: page, url, tier, seq."""
    per = links.groupBy(F.col("page").alias("url")).agg(F.slice(F.sort_array(F.collect_list(F.struct("seq", F.col("tier").cast("int").alias("tier"), F.col("url").alias("link")))), 1, most).alias("l"))
    found = F.transform("l", lambda x: F.struct(x["tier"].alias("tier"), x["link"].alias("url")))
    return pages.join(per.hint("merge"), "url", "left").withColumn("links", F.coalesce(found, F.array().cast(_LINK))).drop("l")


def _links() -> Column:
    return F.coalesce("links", F.array().cast(_LINK))


def _host(url: Column) -> Column:
    """A URL's own host, in lower case; unlike web.host_of a www before counts."""
    return F.regexp_extract(F.lower(url), r"^https?://([^/:?#]+)", 1)


def _queued(links: Column, depth: Column | int, start: Column) -> Column:
    """Links as entries of a queue, in their order, from number `start` on."""
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.transform(links, lambda x, i: F.struct(x["tier"].cast("int").alias("tier"), (start + i).cast("int").alias("at"), depth.cast("int").alias("depth"), x["url"].alias("url"), _host(x["url"]).alias("host")))


def _begun(seeds: DataFrame, refused: DataFrame | None, visited: DataFrame | None) -> DataFrame:
    """domain, queue of the seeds (tier -1, in order), refused, seen."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("seq", "url"))), lambda x: F.struct(F.lit(-1).alias("tier"), x["url"].alias("url")))
    out = seeds.groupBy("domain").agg(entries.alias("l")).select("domain", _queued(F.col("l"), 0, F.lit(0)).cast(f"array<{_ENTRY}>").alias("queue"))
    for rows, column, name in ((refused, "host", "refused"), (visited, "url", "seen")):
        if rows is None:
            out = out.withColumn(name, F.array().cast("array<string>"))
        else:
            per = rows.groupBy("domain").agg(F.collect_set(column).alias(name))
            out = out.join(per.hint("merge"), "domain", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def _met(level: DataFrame, pages: DataFrame, depth: int, last: bool) -> DataFrame:
    """The level's (domain, url) that are held under `url`, at which depth; at the last one links lead nowhere."""
    out = level.join(pages.hint("merge"), "url").withColumn("depth", F.lit(depth))
    return out.withColumn("links", F.array().cast(_LINK)) if last else out


def _next(met: DataFrame) -> DataFrame:
    return met.select("domain", F.explode("links.url").alias("url")).distinct()


def _with_near(begun: DataFrame, near: DataFrame) -> DataFrame:
    """begun with near: the rows of its domain as an array, the least depth first."""
    per = near.groupBy("domain").agg(F.collect_list(F.struct("depth", *(c for c in near.columns if c not in ("domain", "depth")))).alias("near"))
    none = F.array().cast(per.schema["near"].dataType)
    return begun.join(per.hint("merge"), "domain", "left").withColumn("near", F.coalesce("near", none))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _walked(rows: DataFrame, start: list[Column], kind: str, step, most: Column) -> DataFrame:
    """rows with walk: the state (of the type `kind`, with a field `done`) after up to `most` steps of each domain."""
    fold = F.aggregate(F.sequence(F.lit(1), most), F.struct(*start).cast(kind), lambda s, _: F.when(s["done"], s).otherwise(step(s)))
    return rows.select("domain", fold.alias("walk"))


@scoped
def legal_crawl(seeds: DataFrame, pages: DataFrame, refused: DataFrame | None = None, visited: DataFrame | None = None, stop: str = "named", fetches: int = FETCHES, depth: int = DEPTH) -> DataFrame:
    """domain, nth, url, depth, state of each fetch, in order.

    seeds: domain, url, seq; pages: url, state (ok, refused, error), links (see with_links) and the column `stop`, which
    ends the domain's crawl after a page that was read. Seeds come first, in order, then links by tier, equal ones in the
    order found; pages at full depth give no links. An address that was seen, or whose host has refused, costs nothing;
    any other one costs a fetch, also where nothing was captured (error). Domains without a seed have no rows.
    """
    known = written(pages.where("url is not null").select("url", "state", F.coalesce(stop, F.lit(False)).alias("stop"), _links().alias("links")), "pages")
    level, near = seeds.select("domain", "url").distinct(), None
    for d in range(depth + 1):
        met = _met(level, known, d, d == depth)
        if d < depth:
            met = written(met, "reach")
            level = _next(met.where("state = 'ok' and not stop"))
        near = met if near is None else near.unionByName(met)
    rows = _with_near(_begun(seeds, refused, visited), near)
    log = "array<struct<url: string, depth: int, state: string>>"
    kind = f"struct<queue: array<{_ENTRY}>, refused: array<string>, seen: array<string>, n: int, log: {log}, done: boolean>"

    def step(s: Column) -> Column:
        open_ = F.filter(s["queue"], lambda q: ~F.array_contains(s["seen"], q["url"]) & ~F.array_contains(s["refused"], q["host"]))
        page = lambda at: F.array_min(F.filter("near", lambda p: p["url"] == at["url"]))
        return _let(open_, lambda queue: _let(F.array_min(queue), lambda at: _let(page(at), lambda p: after(s, queue, at, p))))

    def after(s: Column, queue: Column, at: Column, page: Column) -> Column:
        took, got = at.isNotNull(), F.coalesce(page["state"], F.lit("error"))
        ok = took & (got == "ok")
        stopped = ok & F.coalesce(page["stop"], F.lit(False))
        last = F.coalesce(F.array_max(F.transform(queue, lambda q: q["at"])), F.lit(0))
        more = F.when(ok & ~stopped & (at["depth"] < depth), _queued(page["links"], at["depth"] + 1, last + 1)).otherwise(F.array().cast(f"array<{_ENTRY}>"))
        n = s["n"] + took.cast("int")
        return F.struct(
            F.concat(F.filter(queue, lambda q: q["at"] != at["at"]), more).alias("queue"),
            F.when(took & (got == "refused"), F.array_append(s["refused"], at["host"])).otherwise(s["refused"]).alias("refused"),
            F.when(took, F.array_append(s["seen"], at["url"])).otherwise(s["seen"]).alias("seen"),
            n.alias("n"),
            F.when(took, F.array_append(s["log"], F.struct(at["url"].alias("url"), at["depth"].alias("depth"), got.alias("state")))).otherwise(s["log"]).alias("log"),
            (~took | stopped | (n >= fetches)).alias("done"),
        ).cast(kind)

    start = [F.col("queue"), F.col("refused"), F.col("seen"), F.lit(0), F.array().cast(log), F.lit(False)]
    out = _walked(rows, start, kind, step, F.lit(max(fetches, 1)))
    return out.select("domain", F.posexplode("walk.log").alias("nth", "f")).select("domain", (F.col("nth") + 1).alias("nth"), "f.*")


#: Contact pages of a domain that are read live, and from the archive; paths that are tried on a main host that answers.
LIVE, ARCHIVED = 3, 2
#: Where contact pages often are.
CONTACT_PATHS = ("/contact", "/kontakti")


def contact_plan(domains: DataFrame, links: DataFrame, refused: DataFrame, visited: DataFrame, live: int = LIVE, archived: int = ARCHIVED) -> DataFrame:
    """domain, nth, url, via (live, archive) of the contact pages to read for each domain, in order.

    domains: domain, host (its main one), blocked; links: domain, url, the contact links of its pages; refused: domain, host;
    visited: domain, url. A main host that doesn't block is tried at CONTACT_PATHS too. Pages of the main host (with and
    without www) come first, then the shorter addresses, then by address; each once and none that was read. A host that
    refused is read from the archive alone, up to `archived` pages, any other one live, up to `live`.
    """
    guessed = domains.where("not blocked").select("domain", F.explode(F.array(*(F.concat(F.lit("https://"), "host", F.lit(p)) for p in CONTACT_PATHS))).alias("url"))
    seen = lambda rows, yes: rows.select("domain", "url", F.lit(yes).alias("seen"))
    known = seen(links, False).unionByName(seen(guessed, False)).unionByName(seen(visited.where("url is not null"), True))
    # A domain's rows meet once, in as many tasks as there are domains for; all that follows is by domain.
    known = known.repartition(tasks_for(domains), "domain").groupBy("domain", "url").agg(F.max("seen").alias("seen")).where("not seen").drop("seen")
    rows = known.withColumn("at", _host(F.col("url"))).join(domains.select("domain", F.col("host").alias("main")).hint("merge"), "domain")
    rows = rows.join(refused.groupBy("domain").agg(F.collect_set("host").alias("hosts")).hint("merge"), "domain", "left")
    rows = rows.withColumn("barred", F.coalesce(F.array_contains("hosts", F.col("at")), F.lit(False)))
    away = ~F.col("at").isin(F.col("main"), F.col("domain"), F.concat(F.lit("www."), "domain"))
    order = [away, F.length("url"), F.col("url")]
    nth = F.row_number().over(Window.partitionBy("domain", "barred").orderBy(*order))
    kept = rows.withColumn("own", nth).where(F.when(F.col("barred"), F.col("own") <= archived).otherwise(F.col("own") <= live))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(*order))
    return kept.select("domain", place.alias("nth"), "url", F.when(F.col("barred"), "archive").otherwise("live").alias("via"))


def twin(url: Column, domain: Column) -> Column:
    """The address with www before the domain, or without it; null on other hosts."""
    host, rest = _host(url), F.regexp_replace(url, r"(?i)^https?://[^/?#]+", "")
    scheme = F.regexp_extract(url, r"(?i)^(https?://)", 1)
    other = F.when(host == domain, F.concat(F.lit("www."), domain)).when(host == F.concat(F.lit("www."), domain), domain)
    return F.concat(scheme, other, rest)


def _tries(url: Column, domain: Column, first: Column) -> Column:
    """The addresses under which the archive may hold a page: its own, its www twin and, of a start that is a root, both of /bg."""
    bg = F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/bg"))
    root = first & url.rlike(r"(?i)^https?://[^/?#]+/?$")
    return F.array_compact(F.array(url, twin(url, domain), F.when(root, bg), F.when(root, twin(bg, domain))))


@scoped
def archive_fallback(starts: DataFrame, pages: DataFrame, copies: DataFrame, refused: DataFrame, visited: DataFrame | None = None, documents: int = DOCUMENTS, lookups: int = LOOKUPS, depth: int = DEPTH) -> DataFrame:
    """domain, docs, lookups, named, reads (url, via, stamp, depth; in order) of each domain with a start.

    For hosts that refused. starts: domain, url, seq, the entry pages; pages: url, state, named, links of live pages;
    copies: url, stamp, named, links of the archive's. Each start is looked up, then its www twin, then, for a root, its
    /bg root and that one's twin. Then links of the first two tiers, best first, two levels deep: live where the host does
    not refuse, else from the archive, twin included. A lookup costs one of `lookups`, a copy one of `documents`; the walk
    ends with either, or once a page names the company. Domains without a start have no rows.
    """
    live = written(pages.where("url is not null").select("url", "state", "named", F.lit(None).cast("string").alias("stamp"), _links().alias("links")), "live")
    held = written(copies.where("url is not null").select("url", F.lit(None).cast("string").alias("state"), "named", F.col("stamp").cast("string").alias("stamp"), _links().alias("links")), "copies")
    level, near = starts.select("domain", "url").distinct(), None
    for d in range(depth + 1):
        tried = level.select("domain", F.explode(_tries(F.col("url"), F.col("domain"), F.lit(d == 0))).alias("url")).distinct()
        met = _met(tried, held, d, d == depth).withColumn("copy", F.lit(True))
        if d:
            met = met.unionByName(_met(level, live, d, d == depth).withColumn("copy", F.lit(False)))
        met = met.withColumn("links", F.filter("links", lambda x: x["tier"] <= ARCHIVE_TIER))
        if d < depth:
            met = written(met, "reach")
            level = _next(met.where("copy or state = 'ok'"))
        near = met if near is None else near.unionByName(met)
    rows = _with_near(_begun(starts, refused, visited), near)
    reads = "array<struct<url: string, via: string, stamp: string, depth: int>>"
    kind = f"struct<queue: array<{_ENTRY}>, refused: array<string>, seen: array<string>, docs: int, lookups: int, named: boolean, reads: {reads}, done: boolean>"
    none = F.array().cast(_LINK)
    meets = lambda url, copy: F.array_min(F.filter("near", lambda p: (p["url"] == url) & (p["copy"] == copy)))

    def step(s: Column) -> Column:
        open_ = F.filter(s["queue"], lambda q: (q["tier"] == -1) | ~F.array_contains(s["seen"], q["url"]))
        spent = lambda at: s["named"] | (s["docs"] >= documents) | ((at["tier"] != -1) & (s["lookups"] >= lookups))
        return _let(open_, lambda queue: _let(F.array_min(queue), lambda at: _let(F.when(~spent(at), at), lambda at: asked(s, queue, at))))

    def asked(s: Column, queue: Column, at: Column) -> Column:
        first, barred = at["tier"] == -1, F.array_contains(s["refused"], at["host"])

        def answered(page: Column) -> Column:
            state = F.when(~first & ~barred, F.coalesce(page["state"], F.lit("error")))
            asks = at.isNotNull() & (first | barred | (state == "refused"))
            left = F.lit(lookups) - s["lookups"]
            # Only as many as the budget still allows; the first one that is held ends the search.
            tries = F.when(asks & (left > 0), F.slice(_tries(at["url"], F.col("domain"), first), 1, F.greatest(left, F.lit(1)))).otherwise(F.array().cast("array<string>"))
            hits = lambda tries: F.filter(F.transform(tries, lambda u, j: F.struct(j.alias("j"), meets(u, True).alias("c"))), lambda h: h["c"].isNotNull())
            return _let(tries, lambda tries: _let(F.get(hits(tries), 0), lambda hit: _let(state, lambda state: after(s, queue, at, page, state, tries, hit))))

        return _let(F.when(~first, meets(at["url"], False)), answered)

    def after(s: Column, queue: Column, at: Column, page: Column, state: Column, tries: Column, hit: Column) -> Column:
        took, copy, read = at.isNotNull(), hit.isNotNull(), F.coalesce(state == "ok", F.lit(False))
        got = F.when(copy, hit["c"]["links"]).when(read, page["links"]).otherwise(none)
        follow = F.when(took & (at["depth"] < depth), got).otherwise(none)
        last = F.coalesce(F.array_max(F.transform(queue, lambda q: q["at"])), F.lit(0))
        told = F.struct(at["url"].alias("url"), F.when(copy, "archive").otherwise("live").alias("via"), hit["c"]["stamp"].alias("stamp"), at["depth"].alias("depth"))
        return F.struct(
            F.concat(F.filter(queue, lambda q: q["at"] != at["at"]), _queued(follow, at["depth"] + 1, last + 1)).alias("queue"),
            F.when(took & (state == "refused"), F.array_append(s["refused"], at["host"])).otherwise(s["refused"]).alias("refused"),
            F.when(took & (at["tier"] != -1), F.array_append(s["seen"], at["url"])).otherwise(s["seen"]).alias("seen"),
            (s["docs"] + copy.cast("int")).alias("docs"),
            (s["lookups"] + F.when(copy, hit["j"] + 1).otherwise(F.size(tries))).alias("lookups"),
            (s["named"] | F.coalesce(F.when(copy, hit["c"]["named"]).when(read, page["named"]), F.lit(False))).alias("named"),
            F.when(took & (copy | read), F.array_append(s["reads"], told)).otherwise(s["reads"]).alias("reads"),
            (~took).alias("done"),
        ).cast(kind)

    start = [F.col("queue"), F.col("refused"), F.col("seen"), F.lit(0), F.lit(0), F.lit(False), F.array().cast(reads), F.lit(False)]
    # Each step takes a start or an address that a page or copy links to and that was not seen.
    most = F.size("queue") + F.aggregate("near", F.lit(0), lambda n, p: n + F.size(p["links"])) + 1
    return _walked(rows, start, kind, step, most).select("domain", "walk.docs", "walk.lookups", "walk.named", "walk.reads")
