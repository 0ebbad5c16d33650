"""The engine's verbs over captured tables: what a shop's pages disclose, evidence for the companies behind it, and the
state of what sources answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import agreement, identifiers, markup, web
from ..sources.tables import written
from . import crawl, profiles

FIELDS = ("company", "eik", "vat", "address", "phone", "email")


def page_records(fetches: DataFrame) -> DataFrame:
    """fetches: url (asked), final_url, seq, status, html. One row a page: host, state, challenge, shell, legal, the fields it
    tells (f) and its hash."""
    read = F.col("status").between(200, 299) & ~crawl.is_challenge(F.col("html"))
    html = F.when(read, F.col("html"))
    return fetches.select(
        "url",
        "final_url",
        "seq",
        web.host_of(F.col("final_url")).alias("host"),
        F.when(crawl.is_challenge(F.col("html")), "refused").otherwise(crawl.status_class(F.col("status"))).alias("state"),
        crawl.is_app_shell(F.col("html")).alias("shell"),
        markup.is_legal(F.col("final_url"), F.col("html")).alias("legal"),
        markup.six_fields(html).alias("f"),
        F.sha2(F.col("html").cast("binary"), 256).alias("sha256"),
    )


def triage(fetches: DataFrame) -> DataFrame:
    """One row a shop: the first value of each field by page order, findings, score and verdict.

    A shop no page of which could be read is blocked or unreachable; one that landed abroad is out of scope; one whose pages
    scripts fill and that tells nothing is undetermined; none of these has a score. A number that is written as a VAT number
    of the country stands for an identifier, and the other way round.
    """
    pages = written(page_records(fetches), "pages")  # what is read of a page is read once
    ok = F.col("state") == "ok"
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("seq")))
    name = agreement.wording_key(F.col("f.company"))
    told = pages.groupBy("url").agg(
        *(first(F.col(f"f.{c}")).alias(c) for c in FIELDS),
        F.count_distinct(F.nullif(name, F.lit(""))).alias("n_names"),
        F.count_if(ok).alias("pages"),
        F.max(F.col("state") == "refused").alias("refused"),
        F.max(ok & F.col("shell")).alias("shell"),
        F.min_by("final_url", F.when(ok, F.col("seq"))).alias("landed"),
    )
    told = written(told, "shops")
    parts = identifiers.vat_parts(F.col("vat"))
    # Columns of their own, since what follows names each of them many times.
    told = told.withColumn("number", F.when(parts["country"] == "BG", parts["number"]))
    told = told.withColumn("from_vat", F.when(F.col("number").isNotNull(), identifiers.identifier_or_null(F.col("number"))))
    told = told.withColumn("eik", F.coalesce("eik", "from_vat")).withColumn("eik_ok", identifiers.identifier_valid(F.col("eik")))
    told = told.withColumn("shop", web.host_of(F.col("url")))
    scored = profiles.assess(told.withColumn("shop", F.col("url"))).withColumnsRenamed({"shop": "url", "verdict": "scored"})
    nothing = F.coalesce(*FIELDS).isNull()
    state = F.when(F.col("pages") == 0, F.when(F.col("refused"), "blocked").otherwise("unreachable")).when(F.coalesce(web.abroad(F.col("url"), F.col("landed")), F.lit(False)), "out_of_scope").when(F.col("shell") & nothing, "undetermined")
    out = told.join(scored, "url").withColumn("state", state)
    none = F.col("state").isNull()
    return out.select("url", F.col("shop").alias("domain"), *FIELDS, "n_names", "pages", F.when(none, F.col("findings")).otherwise(F.array().cast("array<string>")).alias("findings"), F.when(none, F.col("score")).alias("score"), F.coalesce("state", "scored").alias("verdict"))


def foreign_numbers(pages: DataFrame) -> DataFrame:
    """domain, vat, seq: VAT numbers of other countries. pages: domain, seq, vat."""
    parts = identifiers.vat_parts(F.col("vat"))
    return pages.where(parts["country"] != "BG").select("domain", F.concat(parts["country"], parts["number"]).alias("vat"), "seq")


def evidence(pages: DataFrame, mentions: DataFrame, declared: DataFrame, found: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """Claims (domain, eik, branch, tier, operator, own, declared, host, page, name) of all branches; only identifiers whose
    digits hold, and of tier by the source's authority.

    pages: domain, host, page, eik, vat, company; mentions: domain, host, page, name, eik, operator; declared: domain, eik,
    name; found (search): domain, host, page, eik, text; stated (structured data, see structured.numbers): domain, host, page,
    eik, name. A result of another host counts if its text names the domain.
    """
    parts = identifiers.vat_parts(F.col("vat"))
    pages = pages.withColumn("number", F.when(parts["country"] == "BG", parts["number"]))  # named many times below
    claim = lambda eik, branch, tier, operator, own, declared_, name: (
        eik.alias("eik"),
        F.lit(branch).alias("branch"),
        F.lit(tier).alias("tier"),
        operator.alias("operator"),
        own.alias("own"),
        F.lit(declared_).alias("declared"),
        name.alias("name"),
    )
    no, yes = F.lit(False), F.lit(True)
    here = F.col("host") == F.col("domain")
    here = here | F.col("host").endswith(F.concat(F.lit("."), F.col("domain")))
    branches = [
        pages.select("domain", "host", "page", *claim(F.col("eik"), "own_id", 3, no, yes, False, F.col("company"))),
        pages.select("domain", "host", "page", *claim(F.col("number"), "own_vat", 3, no, yes, False, F.col("company"))),
        mentions.select("domain", "host", "page", *claim(F.col("eik"), "mention", 3, F.col("operator"), yes, False, F.col("name"))),
        declared.select("domain", F.lit(None).cast("string").alias("host"), F.lit(None).cast("long").alias("page"), *claim(F.col("eik"), "declaration", 2, yes, no, True, F.col("name"))),
        found.where(here | F.contains(F.lower("text"), F.col("domain"))).select("domain", "host", "page", *claim(F.col("eik"), "search", 5, no, here, False, F.lit(None).cast("string"))),
    ]
    if stated is not None:
        branches.append(stated.select("domain", "host", "page", *claim(F.col("eik"), "structured", 3, no, yes, False, F.col("name"))))
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out.withColumn("eik", identifiers.identifier_or_null(F.col("eik"))).where("eik is not null")


def with_official(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """claims with confirmed, name_ok: answers (eik, state, name) of registers by id, and whether a claim's name agrees with
    the official one (null where either says nothing)."""
    best = answers.where("state = 'confirmed'").groupBy("eik").agg(F.min("name").alias("official"))
    out = claims.join(best, "eik", "left")
    return out.withColumn("confirmed", F.col("official").isNotNull()).withColumn("name_ok", agreement.names_agree(F.col("name"), F.col("official"))).drop("official")


def provider_state(answers: DataFrame) -> DataFrame:
    """answers: provider, status (of an HTTP answer), n (results). One row a provider: failed where a key was rejected,
    unavailable where all answers were errors, else found or not_found."""
    good = F.col("status").between(200, 299)
    got = answers.groupBy("provider").agg(F.max(F.col("status").isin(401, 403)).alias("rejected"), F.max(F.coalesce(good, F.lit(False))).alias("any"), F.sum(F.when(good, F.col("n"))).alias("n"))
    state = F.when(F.col("rejected"), "failed").when(~F.col("any"), "unavailable").when(F.col("n") > 0, "found").otherwise("not_found")
    return got.select("provider", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def search_queries(domains: DataFrame) -> DataFrame:
    """domains: domain, host, names (array). One row a query: five of the domain, one of a host of another name, and one of
    each of the first two names."""
    d, h = F.col("domain"), F.col("host")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    at = lambda c: F.concat(F.lit("site:"), c)
    # The five queries of a domain, in their order.
    own = [F.concat_ws(" ", *x) for x in ((quoted(d), F.lit("ЕИК")), (at(d), F.lit('"ЕИК"')), (quoted(d), F.lit('"Общи условия"')), (at(d), F.lit('"Общи условия"')), (quoted(d), F.lit("EIK")))]
    other = F.when(h != d, F.concat_ws(" ", quoted(h), F.lit("ЕИК")))
    named = F.transform(F.slice(F.coalesce("names", F.array().cast("array<string>")), 1, 2), lambda n: F.concat_ws(" ", quoted(d), quoted(n)))
    every = F.concat(F.array_compact(F.array(*own, other)), named)
    return domains.select("domain", F.posexplode(every).alias("place", "query"))


def coverage_of(status: Column, value: Column) -> Column:
    """Who found a field, from its status and value."""
    found = F.when(F.startswith(status, F.lit("ai_assisted")), "found_by_model").otherwise("found")
    return F.when(status == "conflicting", "conflicting").when(value.isNotNull(), found).when(status == "unavailable", "unavailable").otherwise("not_found")


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def register_search(wanted: DataFrame, records: DataFrame, most: int = 5) -> DataFrame:
    """wanted: name; records: eik, name. The first `most` records by eik whose name, in capitals, holds the wanted one's core
    anywhere, also within words and forms. A name without a core finds nothing.

    Records are indexed by their runs of three characters (of fewer for cores that short). A core meets them by the run that
    fewest records hold, and only those it met are searched for the whole core."""
    from pyspark.sql import Window

    core = agreement.core_name(F.col("name"))
    cores = written(wanted.where("name is not null").select("name", core.alias("core")).where("core <> ''").distinct().withColumn("n", F.least(F.lit(3), F.length("core"))), "cores")
    held = records.select("eik", F.col("name").alias("record"), F.upper("name").alias("held")).where("held is not null")
    out = None
    for n in sorted(r.n for r in cores.select("n").distinct().collect()):  # 1, 2, 3
        asked = cores.where(F.col("n") == n).select("name", "core", F.explode(_grams(F.col("core"), n)).alias("gram"))
        index = held.where(F.length("held") >= n).select("eik", "record", "held", F.explode(_grams(F.col("held"), n)).alias("gram"))
        sizes = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("size"))
        probes = asked.join(sizes, "gram", "left").groupBy("name", "core").agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "gram")).alias("p")).select("name", "core", F.col("p.gram").alias("gram"))
        met = index.join(probes, "gram").where(F.contains("held", F.col("core"))).select("name", "eik", "record")
        out = met if out is None else out.unionByName(met)
    if out is None:
        out = cores.select("name").join(held.select("eik", "record"), F.lit(False))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("eik", "record"))).where(F.col("place") <= most).select("name", "eik", "record", "place")
