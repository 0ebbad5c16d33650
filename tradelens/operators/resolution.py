"""From claims of sources to an entity for each domain: union, scoring, ranking with ties, alternatives, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agreement import plausible_name
from ..functions.flags import any_of, packed

#: Authority of sources, strongest first, and confidence, weakest first.
TIERS = ("registry", "official", "company", "public", "search")
LEVELS = ("insufficient", "low", "medium", "high")


def union_claims(branches: list[DataFrame]) -> DataFrame:
    """Claims of all branches; columns that a branch lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def score_candidates(claims: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row a (domain, eik). claims: tier (1 strongest, of TIERS), own (shown on the domain's own pages), operator (a text
    says who runs the domain), archived, declared, confirmed (by an official answer), host, page, name_ok.

    Claims of the operator's own documents are those of tier 3; a search claim (tier 5) may show own pages; operator texts
    count on own documents and own pages alone; hosts count where a public or search claim is not the domain's own.
    A claim counts for a page or for a host, never for both, so one aggregate by both and one over it count each once,
    without a row of a claim for each count. Both are plain partial ones: of a domain with a third of all claims, its
    different pages and hosts are dealt over tasks, and then cost a row a task.
    tasks: how many tasks count, where the session's shuffle partitions are too few to do it in memory. A domain's claims are
    then dealt by their page or host to so many parts and counted in each, and its ids meet as a row a part. The result is
    dealt by domain, so that what is done by domain next needs no shuffle.
    """
    document, shown = F.col("tier") == 3, (F.col("tier") == 5) & F.col("own")
    operator = F.col("operator") & ~F.col("declared") & (document | F.col("own"))
    live = ~F.col("archived")
    says = {"own_any": document, "own_live": document & live, "operator": operator, "operator_live": operator & live, "declared": F.col("declared"), "confirmed": F.col("confirmed"), "shown": shown, "name_ok": F.col("name_ok")}
    host, page = F.when(F.col("tier").isin(4, 5) & ~F.col("own"), F.col("host")), F.when(document, F.col("page"))
    key = ["domain", "eik"]
    counted = [*key, F.col("tier").alias("best_tier"), packed(says.values()).alias("said"), host.alias("host"), page.alias("page")]
    best = [F.min("best_tier").alias("best_tier"), F.bit_or("said").alias("said")]
    if tasks:
        # Claims that count for neither may be counted in any part: beside others of their page they take fewest bytes.
        of = F.xxhash64(host, F.when(host.isNull(), F.col("page")))
        claims = claims.select(*counted, F.pmod(of, F.lit(tasks)).cast("int").alias("part")).repartition(tasks, "domain", "part")
        key = [*key, "part"]
    else:
        claims = claims.select(*counted)
    once = claims.groupBy(*key, "host", "page").agg(*best)
    out = once.groupBy(*key).agg(*best, F.count("host").alias("public_hosts"), F.count("page").alias("pages"))
    if tasks:
        out = out.repartition(tasks, "domain").groupBy("domain", "eik").agg(*best, F.sum("public_hosts").alias("public_hosts"), F.sum("pages").alias("pages"))
    out = out.withColumns({name: any_of("said", i) for i, name in enumerate(says)})
    known = F.col("own_any") | F.col("operator")
    level = (
        F.when(F.col("declared") & ~known, "high")
        .when(known & ~F.col("own_live") & ~F.col("operator_live") & ~F.col("confirmed"), "medium")
        .when(known, "high")
        .when(F.col("shown") & F.col("confirmed"), "medium")
        .when(F.col("public_hosts") >= 2, "medium")
        .otherwise("low")
    )
    out = out.withColumn("level", level)
    lowered = F.when((F.col("level") == "high") & (F.col("name_ok") == F.lit(False)), "medium").otherwise(F.col("level"))
    return out.withColumn("level", lowered).select("domain", "eik", "level", "best_tier", "operator", "confirmed", "name_ok", "pages", "public_hosts")


def ranked(scored: DataFrame) -> DataFrame:
    """rank, n_first (how many candidates share the first rank in all six parts of the key), and place: rank's order, of
    equals by identifier."""
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    key = [level.desc(), F.asc("best_tier"), F.desc("operator"), F.desc("confirmed"), F.coalesce("name_ok", F.lit(False)).desc(), F.desc("pages")]
    w = Window.partitionBy("domain")
    out = scored.withColumn("rank", F.rank().over(w.orderBy(*key))).withColumn("place", F.row_number().over(w.orderBy(*key, "eik")))
    return out.withColumn("n_first", F.sum((F.col("rank") == 1).cast("int")).over(w))


def resolve(scored: DataFrame, foreign: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """One row a domain: the entity, unless first candidates tie (which ends it) or the best is low.

    foreign: domain, vat, seq; names: domain, name, seq, operator, stated (labelled, structured or on a legal page).
    Where no candidate is identified, the first foreign number identifies without an id (high), else the first plausible
    name that was stated or said to run the domain, those first (medium); else the best is shown as a candidate.
    """
    best = ranked(scored).where("place = 1").select("domain", F.col("eik").alias("first"), "n_first", F.col("level").alias("best"))
    basis = F.when(F.col("n_first") > 1, "ambiguous").when(F.col("best").isin("high", "medium"), "identified")
    if foreign is None and names is None:
        basis = basis.otherwise("candidate")
        return best.select("domain", F.when(basis == "identified", F.col("first")).alias("eik"), F.when(basis == "ambiguous", "insufficient").otherwise(F.col("best")).alias("level"), basis.alias("basis"))
    vats = foreign.groupBy("domain").agg(F.min_by("vat", "seq").alias("vat"))
    # Names are only read where a flag lets them count: most time goes to them.
    told = names.where((F.col("operator") | F.col("stated")) & plausible_name(F.col("name")))
    told = told.groupBy("domain").agg(F.min_by("name", F.struct(~F.col("operator"), "seq")).alias("name"))
    out = best.join(vats, "domain", "full_outer").join(told, "domain", "full_outer")
    basis = basis.when(F.col("vat").isNotNull(), "foreign_vat").when(F.col("name").isNotNull(), "name_only").when(F.col("first").isNotNull(), "candidate").otherwise("none")
    level = F.when(basis == "identified", F.col("best")).when(basis == "foreign_vat", "high").when(basis == "name_only", "medium").when(basis == "candidate", "low").otherwise("insufficient")
    only = lambda kind, c: F.when(basis == kind, F.col(c))
    return out.select("domain", only("identified", "first").alias("eik"), level.alias("level"), basis.alias("basis"), only("foreign_vat", "vat").alias("vat"), only("name_only", "name").alias("name"), only("candidate", "first").alias("candidate"))


def alternatives(scored: DataFrame, most: int = 5) -> DataFrame:
    """Candidates after the first, or from it where first candidates tie, in ranked()'s order up to place `most`."""
    out = ranked(scored).where((F.col("place") <= most) & ((F.col("place") > 1) | (F.col("n_first") > 1)))
    return out.select("domain", "eik", F.col("place").alias("rn"))


def conflicts(scored: DataFrame, most: int = 5) -> DataFrame:
    """domain, kind, ids: a row for each id whose published names all disagree with the official one (names), and one for
    each domain that several ids are claimed for (ids: the first `most` of them)."""
    names = scored.where(F.col("name_ok") == F.lit(False)).select("domain", F.lit("names").alias("kind"), F.col("eik").cast("string").alias("ids"))
    n = scored.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = F.slice(F.sort_array(F.collect_list("eik")), 1, most)
    several = scored.join(n.select("domain"), "domain", "left_semi").groupBy("domain").agg(F.array_join(listed.cast("array<string>"), ",").alias("ids"))
    return names.unionByName(several.select("domain", F.lit("ids").alias("kind"), "ids"))
