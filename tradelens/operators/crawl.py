"""Which captured pages to take next: link quotas, a frontier of bounded depth, host order, robots rules, page states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import tasks_for

#: Links that a task ranks, about.
TASK_LINKS = 500_000
#: How many links of each tier (0 best) come before all others.
QUOTA = (2, 2, 1)
#: Marks of pages that challenge the visitor, and of pages that scripts fill; narrow, so that pages that only
#: mention a challenge, or use such a library beside their text, don't count.
CHALLENGE = ("cf_chl_opt", "<title>just a moment...</title>", "attention required! | cloudflare", "_incapsula_resource", "px-captcha", "ddos-guard.net/", "checking your browser before")
APP_SHELL = ("auraconfig", "data-aura-rendered-by", "__next_data__", "window.__nuxt__", "ng-app", "data-reactroot", "__remix_context__")
#: Labels of hosts that hold legal texts, best first, and what else in a label speaks for such a host.
LEGAL_LABELS = ("legal", "help", "support", "about", "company", "corporate", "developer", "developers", "business", "info")
HOST_HINTS = ("developer", "help", "support", "legal", "about", "corporate", "company", "business", "info", "terms", "policies", "privacy", "pomosht", "za-nas")
#: Path parts of areas that belong to one visitor.
PRIVATE = ("account", "cart", "checkout", "login", "logout", "order", "password", "profile", "register", "wishlist")


def link_plan(links: DataFrame, most: int = 8) -> DataFrame:
    """links: page, link, tier (0 best), text_only, seq. Adds place: each tier's quota first, then the rest, `most` in all.

    A page's links meet in one window; the pages, not the links, are many. Both windows use one shuffle by page, into as many
    tasks as there are links for, so that a task's memory doesn't grow with the table.
    """
    links = links.repartition(tasks_for(links, TASK_LINKS), "page")
    best = Window.partitionBy("page", "tier").orderBy("text_only", "seq", "link")
    quota = F.coalesce(F.get(F.array(*map(F.lit, QUOTA)), F.col("tier").cast("int")), F.lit(0))
    late = F.row_number().over(best) > quota
    out = links.withColumn("_late", late).withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("_late", "tier", "text_only", "seq", "link")))
    return out.where(F.col("place") <= most).drop("_late")


def frontier(seeds: DataFrame, edges: DataFrame, refused: DataFrame, depth: int = 2) -> DataFrame:
    """node, depth: what is reached from the seeds (node) over edges (src, dst) in so many steps, each node at its least
    depth; refused nodes (node) are neither taken nor passed through. As many joins as steps, no loop over rows."""
    edges = edges.select("src", "dst").distinct().join(refused.select(F.col("node").alias("dst")), "dst", "left_anti")
    reached = level = seeds.select("node").distinct().join(refused.select("node"), "node", "left_anti").withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(d))
        reached = reached.unionByName(level)
    return reached.groupBy("node").agg(F.min("depth").alias("depth"))


def host_rank(hosts: DataFrame, most: int = 12) -> DataFrame:
    """hosts: domain, host. Adds place among the domain's hosts with a hint in their labels: by the place in LEGAL_LABELS of the
    label next to the domain, then by fewer labels, then by name.

    Rows are one a host, so the window holds hosts, not pages.
    """
    label = F.expr("substring(host, 1, length(host) - length(domain) - 1)")
    near = F.substring_index("label", ".", -1)
    known = F.array(*map(F.lit, LEGAL_LABELS))
    rank = F.when(F.array_position(known, near) > 0, F.array_position(known, near)).otherwise(99)
    pool = hosts.where("endswith(host, '.' || domain)").withColumn("label", label).where(F.exists(F.array(*map(F.lit, HOST_HINTS)), lambda k: F.contains(F.col("label"), k)))
    order = Window.partitionBy("domain").orderBy(rank, F.size(F.split("label", r"\.")), "label")
    return pool.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("label")


def status_class(status: Column) -> Column:
    """ok, refused (401, 403, 429) or error; error too where there is none."""
    return F.when(status.between(200, 299), "ok").when(status.isin(401, 403, 429), "refused").otherwise("error")


def has_mark(html: Column, marks: tuple[str, ...], most: int) -> Column:
    """Whether the first `most` characters hold one of the marks."""
    head = F.lower(F.substring(html, 1, most))
    return F.coalesce(F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(head, m)), F.lit(False))


def is_challenge(html: Column, mitigated: Column | None = None) -> Column:
    """mitigated: the response header by which a host says that it challenged the visitor."""
    said = F.lit(False) if mitigated is None else F.coalesce(F.lower(mitigated) == "challenge", F.lit(False))
    return said | has_mark(html, CHALLENGE, 60_000)


def is_app_shell(html: Column) -> Column:
    return has_mark(html, APP_SHELL, 400_000)


def is_private(url: Column) -> Column:
    return F.lower(url).rlike(rf"/({'|'.join(PRIVATE)})([/?.#-]|$)")


def robots_allowed(urls: DataFrame, rules: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """urls: host, path; rules: host, prefix, allow; answers: host, status of its rules file. Adds allowed: the longest
    prefix decides, allow wins a tie, and without a rule a path is allowed. A host that answered 401 or 403 allows nothing,
    one with any other error everything.

    A path meets rules by its prefixes of the lengths that the host's rules have (an equality join, as many rows a path as
    there are lengths), so it stays apart for a host with many rows.
    """
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("_n"))
    each = urls.select("host", "path").distinct().join(lengths, "host").withColumn("n", F.explode("_n")).where(F.length("path") >= F.col("n"))
    cut = each.select("host", "path", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("prefix"))
    told = cut.join(rules, ["host", "prefix"]).groupBy("host", "path").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    out = urls.join(told, ["host", "path"], "left")
    if answers is None:
        return out.withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")
    state = answers.select("host", F.col("status").alias("_s"))
    allowed = F.when(F.col("_s").isin(401, 403), False).when(~F.coalesce(F.col("_s").between(200, 299), F.lit(True)), True).otherwise(F.coalesce("allow", F.lit(True)))
    return out.join(state, "host", "left").withColumn("allowed", allowed).drop("allow", "_s")
