"""Bounded walks over captured pages: budgets, stops, refusals, the archive's addresses."""

from tradelens.operators import discovery

PAGE = "url string, state string, named boolean, links array<struct<tier: int, url: string>>"
COPY = "url string, stamp string, named boolean, links array<struct<tier: int, url: string>>"
D = "shop.bg"


def crawl(spark, seeds, pages, **options):
    s = spark.createDataFrame([(D, u, i) for i, u in enumerate(seeds)], "domain string, url string, seq int")
    return [(r.url, r.depth, r.state) for r in discovery.legal_crawl(s, spark.createDataFrame(pages, PAGE), **options).orderBy("nth").collect()]


def test_seeds_then_links_by_tier_and_a_stop(spark):
    a, b, c, d = (f"https://{D}/{x}" for x in "abcd")
    pages = [(a, "ok", False, [(2, c), (0, d), (0, b)]), (b, "ok", None, []), (c, "ok", False, []), (d, "ok", False, [])]
    assert crawl(spark, [a, b], pages) == [(a, 0, "ok"), (b, 0, "ok"), (d, 1, "ok"), (c, 1, "ok")]
    assert crawl(spark, [a, b], [*pages[:1], (b, "ok", True, [(0, c)]), *pages[2:]]) == [(a, 0, "ok"), (b, 0, "ok")]
    assert crawl(spark, [a, a], pages, fetches=2) == [(a, 0, "ok"), (d, 1, "ok")]
    assert crawl(spark, [a], pages, depth=0) == [(a, 0, "ok")]
    seen = spark.createDataFrame([(D, a)], "domain string, url string")
    assert crawl(spark, [a, b], pages, visited=seen) == [(b, 0, "ok")]


def test_hosts_that_refuse_are_not_asked_again_and_what_was_not_captured_costs(spark):
    a, b, c = f"https://help.{D}/", f"https://help.{D}/b", f"https://{D}/c"
    assert crawl(spark, [a, b, c, f"https://{D}/d"], [(a, "refused", None, None), (c, "ok", False, None)]) == [(a, 0, "refused"), (c, 0, "ok"), (f"https://{D}/d", 0, "error")]
    assert crawl(spark, [], []) == []


def fallback(spark, starts, pages, copies, refused, **options):
    s = spark.createDataFrame([(D, u, i) for i, u in enumerate(starts)], "domain string, url string, seq int")
    r = spark.createDataFrame([(D, h) for h in refused], "domain string, host string")
    out = discovery.archive_fallback(s, spark.createDataFrame(pages, PAGE), spark.createDataFrame(copies, COPY), r, **options).collect()
    return [(x.docs, x.lookups, x.named, [(y.url, y.via, y.depth) for y in x.reads]) for x in out]


def test_the_archive_holds_a_link_under_its_www_twin(spark):
    root, terms = f"https://{D}/", f"https://{D}/terms"
    copies = [(root, "2025", False, [(0, terms), (2, root + "x")]), (f"https://www.{D}/terms", "2025", True, [])]
    assert fallback(spark, [root], [], copies, [D]) == [(2, 3, True, [(root, "archive", 0), (terms, "archive", 1)])]
    assert fallback(spark, [root], [], copies, [D], documents=1) == [(1, 1, False, [(root, "archive", 0)])]
    assert fallback(spark, [root], [], copies, [D], lookups=2) == [(1, 2, False, [(root, "archive", 0)])]


def test_a_root_that_was_never_archived_and_a_page_that_is_live(spark):
    host = f"https://developer.{D}"
    copies = [(f"{host}/bg", "2025", False, [(0, f"{host}/bg/terms"), (1, f"https://{D}/live")]), (f"{host}/bg/terms", "2024", False, [(0, f"{host}/doc.pdf")]), (f"{host}/doc.pdf", "2023", True, [])]
    live = [(f"https://{D}/live", "ok", False, [(0, f"{host}/doc.pdf")])]
    got = fallback(spark, [f"{host}/"], live, copies, [f"developer.{D}"])
    assert got == [(3, 4, True, [(f"{host}/", "archive", 0), (f"{host}/bg/terms", "archive", 1), (f"{host}/doc.pdf", "archive", 2)])]
    # A host that refuses on the way is looked up from then on.
    got = fallback(spark, [f"{host}/"], [(f"https://{D}/live", "refused", None, None)], copies[:1], [f"developer.{D}"])
    assert got == [(1, 5, False, [(f"{host}/", "archive", 0)])]
    assert fallback(spark, [], [], copies, [D]) == []


def test_contact_pages_by_host_and_length_within_both_budgets(spark):
    domains = spark.createDataFrame([(D, f"www.{D}", False), ("b.bg", "b.bg", True), ("c.bg", "c.bg", True)], "domain string, host string, blocked boolean")
    links = spark.createDataFrame([(D, f"https://help.{D}/c"), (D, f"https://{D}/contacts-long"), (D, f"https://{D}/seen"), (D, None), *(("b.bg", f"https://b.bg/{'x' * i}") for i in range(4)), ("b.bg", "https://help.b.bg/")], "domain string, url string")
    refused = spark.createDataFrame([("b.bg", "b.bg")] * 2, "domain string, host string")
    seen = spark.createDataFrame([(D, f"https://{D}/seen")], "domain string, url string")
    got = [tuple(r) for r in discovery.contact_plan(domains, links.where("url is not null"), refused, seen).orderBy("domain", "nth").collect()]
    assert got == [
        ("b.bg", 1, "https://b.bg/", "archive"), ("b.bg", 2, "https://b.bg/x", "archive"), ("b.bg", 3, "https://help.b.bg/", "live"),
        (D, 1, f"https://www.{D}/contact", "live"), (D, 2, f"https://www.{D}/kontakti", "live"), (D, 3, f"https://{D}/contacts-long", "live"),
    ]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_that_follow_from_few_keys_are_not_broadcast(spark):
    # Spark takes rows of an explode for as many as its input has.
    pages = spark.range(50).selectExpr("explode(sequence(1, 40)) as j", "id").selectExpr("concat(id, '/', j) as url", "'ok' as state", "false as named")
    links = pages.selectExpr("url as page", "url", "0 as tier", "1 as seq")
    assert "Broadcast" not in _plan(discovery.with_links(pages, links))
    seeds = pages.selectExpr("split_part(url, '/', 1) as domain", "url", "1 as seq")
    assert "Broadcast" not in _plan(discovery._begun(seeds, seeds.selectExpr("domain", "url as host"), seeds))


def test_a_walk_writes_as_many_tables_whatever_it_fetches(spark, monkeypatch):
    made = []
    monkeypatch.setattr(discovery, "written", lambda df, tag, own=discovery.written: made.append(tag) or own(df, tag))
    urls = [f"https://{D}/{i}" for i in range(9)]
    assert len(crawl(spark, urls, [(u, "ok", False, []) for u in urls])) == 9
    assert len(made) == 3
    assert fallback(spark, urls, [], [(u, "2025", False, []) for u in urls], [D], documents=9)[0][0] == 9
    assert len(made) == 7


def test_rows_that_much_follows_from_are_dealt_to_tasks(spark):
    from tradelens.sources.tables import spread

    few, many = spread(spark.range(100)), spread(spark.range(100), rows=2)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 50
    assert many.distinct().count() == 100


def test_contact_plans_meet_in_tasks_by_domain(spark):
    domains = spark.range(30).selectExpr("cast(id as string) as domain", "cast(id as string) as host", "false as blocked")
    links = domains.selectExpr("domain", "explode(sequence(1, 9)) as i").selectExpr("domain", "concat('https://', domain, '/', i) as url")
    out = discovery.contact_plan(domains, links, domains.select("domain", "host"), links.where("url like '%/1'"))
    assert "Broadcast" not in _plan(out)
    assert out.count() == 60 and out.where("url like '%/1'").isEmpty()


def test_links_are_ranked_in_as_many_tasks_as_there_are_links_for(spark, monkeypatch):
    from tradelens.operators import crawl as plans

    monkeypatch.setattr(plans, "TASK_LINKS", 10)
    links = spark.range(400).selectExpr("id % 40 as page", "id as link", "id % 3 as tier", "false as text_only", "id as seq")
    out = plans.link_plan(links, 4)
    assert out.count() == 160 and out.rdd.getNumPartitions() == 40
