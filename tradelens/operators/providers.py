"""Search and declaration providers over captured answers: which one is asked, what its answers hold, and the state they
leave: a provider that is down is not one that found nothing.

Answers are tables, so that any store that Spark reads serves them; a provider is a name and whether it is configured.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, web

#: Hits of an answer, and characters of a hit's address, title and excerpt.
HITS, ADDRESS, TITLE, EXCERPT = 10, 500, 200, 500
#: Entries of a domain, and how often both filters of a register are asked before it is believed to hold nothing.
ENTRIES, PASSES = 5, 2


def chosen(providers: list[tuple[str, bool]]) -> str | None:
    """The first configured one, in order of preference; None where none is."""
    return next((name for name, ready in providers if ready), None)


def _good(status: Column, body: Column) -> Column:
    return F.coalesce(status.between(200, 299) & F.try_parse_json(body).isNotNull(), F.lit(False))


def search_hits(answers: DataFrame) -> DataFrame:
    """answers: provider, query, status, body (JSON with web.results). Adds good, and hits: the first ten as url, title and
    snippet, tags left out and cut to their lengths. An answer of another shape holds no hits."""
    raw = F.from_json(F.get_json_object("body", "$.web.results"), "array<struct<url: string, title: string, description: string>>")
    one = lambda x: F.struct(
        F.substring(F.coalesce(x["url"], F.lit("")), 1, ADDRESS).alias("url"),
        F.substring(F.coalesce(x["title"], F.lit("")), 1, TITLE).alias("title"),
        F.substring(F.regexp_replace(F.coalesce(x["description"], F.lit("")), "<[^>]+>", ""), 1, EXCERPT).alias("snippet"),
    )
    good = _good(F.col("status"), F.col("body"))
    hits = F.transform(F.slice(F.coalesce(raw, F.array().cast("array<struct<url: string, title: string, description: string>>")), 1, HITS), one)
    return answers.withColumns({"good": good, "hits": F.when(good, hits).otherwise(F.array().cast("array<struct<url: string, title: string, snippet: string>>"))})


def run_search(queries: DataFrame, answers: DataFrame, providers: list[tuple[str, bool]]) -> DataFrame:
    """domain, provider, state, hits, errors of each domain with a query. queries: domain, place, query; answers as in
    search_hits, one a provider and query.

    Queries go to the first configured provider, in order. One whose key is rejected (401, 403) ends them: failed, with the
    hits so far. Errors alone, or answers that weren't captured, are unavailable; else found or not_found. Without a
    provider the state is unconfigured.
    """
    name = chosen(providers)
    if name is None:
        none = F.array().cast("array<struct<query: string, url: string, title: string, snippet: string>>")
        return queries.select("domain").distinct().select("domain", F.lit(None).cast("string").alias("provider"), F.lit("unconfigured").alias("state"), none.alias("hits"), F.array().cast("array<string>").alias("errors"))
    got = search_hits(answers.where(F.col("provider") == name)).select("query", "status", "good", F.col("hits").alias("h"))
    rows = queries.join(got, "query", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    rejected = F.coalesce(F.col("status").isin(401, 403), F.lit(False))
    ended = F.min(F.when(rejected, F.col("place"))).over(Window.partitionBy("domain"))
    rows = rows.withColumn("ended", ended).where(F.col("ended").isNull() | (F.col("place") <= F.col("ended")))
    error = F.when(~F.col("good"), F.when(F.col("status").between(200, 299), "not an answer").otherwise(F.concat_ws(" ", F.lit("HTTP"), F.coalesce(F.col("status").cast("string"), F.lit("none")))))
    told = rows.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("place", "query", "h", error.alias("e")))).alias("r"), F.max("ended").isNotNull().alias("rejected"))
    hits = F.flatten(F.transform("r", lambda x: F.transform(F.coalesce(x["h"], F.array().cast("array<struct<url: string, title: string, snippet: string>>")), lambda y: F.struct(x["query"].alias("query"), y["url"].alias("url"), y["title"].alias("title"), y["snippet"].alias("snippet")))))
    errors = F.transform(F.filter("r", lambda x: x["e"].isNotNull()), lambda x: x["e"])
    state = F.when(F.col("rejected"), "failed").when((F.size("errors") > 0) & (F.size("hits") == 0), "unavailable").when(F.size("hits") > 0, "found").otherwise("not_found")
    return told.withColumns({"hits": hits, "errors": errors}).select("domain", F.lit(name).alias("provider"), state.alias("state"), "hits", F.slice("errors", 1, 3).alias("errors"))


def declared_host(raw: Column) -> Column:
    """The host that a declaration gives, without scheme, www and path."""
    bare = F.regexp_replace(F.lower(F.trim(raw)), r"^https?:?//", "")
    return F.regexp_replace(F.substring_index(bare, "/", 1), r"^www\.", "")


def declared_shops(domains: DataFrame, answers: DataFrame, registrable: Callable[[Column], Column] = web.registrable) -> DataFrame:
    """domain, state, entries (eik, shop, name, declared, at) of each domain. answers: domain, attempt (0: by address, 1: by
    name, 2 and 3: both again), status, body (JSON with data).

    A register's filters match parts of addresses, so an entry counts only where its own host's registrable domain is the
    domain; entries on a marketplace's platform, and owners without an identifier, don't. The first attempt that gives an
    entry is taken, its first five. not_found needs answers of both passes; without them, or with errors alone, the
    register is unavailable.
    """
    row = "array<struct<SHOPNAME: string, DOMAIN: string, PLATFORM_DOMAIN: string, OWNER_INFO: string, REGDATE: string>>"
    good = _good(F.col("status"), F.col("body"))
    read = answers.select("domain", "attempt", good.alias("good"), F.when(good, F.from_json(F.get_json_object("body", "$.data"), row)).alias("rows"))

    def entry(x: Column) -> Column:
        owner = markup.unescaped(F.coalesce(x["OWNER_INFO"], F.lit("")))
        return F.struct(
            F.nullif(F.regexp_extract(owner, r"(?u)ЕИК:\s*([0-9]{13}|[0-9]{9})", 1), F.lit("")).alias("eik"),
            F.substring(F.coalesce(x["SHOPNAME"], F.lit("")), 1, 120).alias("shop"),
            F.nullif(F.trim(F.regexp_extract(owner, r"(?u)Наименование:\s*([^<\n]{2,160}?)\s*(?:<br\s*/?>|$)", 1)), F.lit("")).alias("name"),
            x["DOMAIN"].alias("declared"),
            x["REGDATE"].alias("at"),
        )

    own = lambda x: (registrable(declared_host(x["DOMAIN"])) == F.col("domain")) & (declared_host(x["DOMAIN"]) != "") & (F.coalesce(x["PLATFORM_DOMAIN"], F.lit("")) == "")
    kept = F.filter(F.transform(F.filter("rows", lambda x: F.coalesce(own(x), F.lit(False))), entry), lambda e: e["eik"].isNotNull())
    read = read.withColumn("entries", kept)
    has = F.size("entries") > 0
    per = read.groupBy("domain").agg(F.min_by(F.when(has, F.col("entries")), F.when(has, F.col("attempt"))).alias("e"), F.max(~F.col("good")).alias("failed"), F.count_distinct(F.when(F.col("good"), F.col("attempt"))).alias("n"))
    out = domains.select("domain").join(per, "domain", "left")
    state = F.when(F.col("e").isNotNull(), "found").when(F.coalesce("failed", F.lit(True)) | (F.col("n") < 2 * PASSES), "unavailable").otherwise("not_found")
    kind = "array<struct<eik: string, shop: string, name: string, declared: string, at: string>>"
    return out.select("domain", state.alias("state"), F.coalesce(F.slice("e", 1, ENTRIES), F.array().cast(kind)).alias("entries"))
