"""Claims and values are counted without a row of theirs for each count, and mean the same."""

import random

from pyspark.sql import functions as F

from tradelens.operators import resolution
from tradelens.plans import entity_queries
from tradelens.sources import tables

CLAIM = "domain int, eik int, tier int, operator boolean, archived boolean, declared boolean, own boolean, host string, page int, name_ok boolean, confirmed boolean"


def _claims(spark):
    rows = [
        # tier, operator, archived, declared, own, host, page, name_ok, confirmed
        (1, 7, 3, False, True, False, False, "a", 1, False, None), (1, 7, 3, False, True, False, False, "b", 1, None, None), (1, 7, 3, False, True, False, False, "a", 2, False, None),
        (1, 8, 4, False, False, False, False, "a", 1, None, True), (1, 8, 5, False, False, False, False, "b", 1, None, False), (1, 8, 5, False, False, False, True, "c", 1, None, None), (1, 8, 4, False, False, False, None, "d", 1, None, None),
        (2, 9, None, None, None, None, None, None, None, None, None), (2, 5, 3, True, False, False, False, "a", None, True, False), (2, 5, 3, True, False, False, False, "a", None, False, False),
    ]
    return spark.createDataFrame(rows, CLAIM)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_and_hosts_of_claims_are_counted_without_a_row_each(spark):
    scored = resolution.score_candidates(_claims(spark))
    assert "Expand" not in _plan(scored)
    got = {(r.domain, r.eik): tuple(r)[2:] for r in scored.collect()}
    # level, best_tier, operator, confirmed, name_ok, pages, public_hosts
    assert got == {(1, 7): ("medium", 3, False, None, False, 2, 0), (1, 8): ("medium", 4, False, True, None, 0, 2), (2, 9): ("low", None, None, None, None, 0, 0), (2, 5): ("high", 3, True, False, True, 0, 0)}


def _tied(spark):
    """Domain 1 has two first candidates and five more, domain 2 one; a claim has three rows."""
    rows = [(d, e, 3 if e < 3 else 4, False, False, False, False, f"h{e % 2}", 1, None, False) for d, e in [*((1, e) for e in range(1, 8)), (2, 1)] for _ in range(3)]
    return resolution.score_candidates(spark.createDataFrame(rows, CLAIM))


def test_alternatives_of_a_tie_begin_with_the_first(spark):
    out = resolution.alternatives(_tied(spark))
    assert "Expand" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, e, e) for e in range(1, 6)]


def test_a_tie_ends_the_search_and_one_first_candidate_is_it(spark):
    out = resolution.resolve(_tied(spark))
    assert "Expand" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, None, "insufficient", "ambiguous"), (2, 1, "high", "identified")]


def test_names_are_read_only_where_they_may_count(spark):
    vats = spark.createDataFrame([(3, "DE1", 2), (3, "DE2", 1)], "domain int, vat string, seq int")
    names = spark.createDataFrame([(4, "Алфа Трейд ООД", 2, False, True), (4, "Бета Трейд ООД", 3, True, False), (5, "Алфа Трейд ООД", 1, False, False)], "domain int, name string, seq int, operator boolean, stated boolean")
    out = resolution.resolve(_tied(spark), vats, names)
    assert "Expand" not in _plan(out)
    read = next(x for x in _plan(out).splitlines() if "Filter" in x and "stated" in x)
    assert read.index("stated") < read.index("RLIKE") if "RLIKE" in read else read.index("stated") < read.index("name#")
    assert {r.domain: (r.basis, r.vat or r.name or r.eik) for r in out.collect()} == {1: ("ambiguous", None), 2: ("identified", 1), 3: ("foreign_vat", "DE2"), 4: ("name_only", "Бета Трейд ООД")}


VALUE = "domain int, field string, key int, authority int, authoritative boolean, official boolean, voice string, origin string"


def test_values_of_many_are_read_once_and_not_expanded(spark):
    from tradelens.operators import profiles

    rows = [
        (1, "a", 5, 3, False, False, "v", "x"), (1, "a", 5, 4, True, None, "v", "y"), (1, "a", 6, 1, False, False, "v", "x"), (1, "a", 6, 1, False, False, "w", "x"),
        (1, "b", 5, 2, False, False, "v", "x"), (1, "b", 6, 2, None, None, "v", "y"), (1, "b", 6, 3, False, False, "v", "y"),
        (2, "a", 5, 2, None, None, "v", None), (2, "a", 6, 2, False, False, None, None), (2, "b", 5, 2, False, False, "v", "x"), (2, "b", 5, 2, False, False, "w", "x"),
    ]
    values = spark.createDataFrame([*rows, *rows[:4] * 2], VALUE)
    out = profiles.shared_value_status(values)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("LogicalRDD") == 1
    got = {(r.domain, r.field): (r.value, r.n_values, r.status) for r in out.collect()}
    assert got == {(1, "a"): (5, 2, "verified"), (1, "b"): (6, 2, "conflicting"), (2, "a"): (5, 2, "published"), (2, "b"): (5, 1, "corroborated")}


def test_tables_are_joined_and_ranked_in_tasks_by_their_size_not_by_the_session(spark, monkeypatch):
    """With few shuffle partitions each task sorted, and spilled, its share of whatever size."""
    for module in (tables, entity_queries):
        monkeypatch.setattr(module, "SORTED", 400, raising=False)
    folder = "/root/testdata/sf0.001"
    least = -(-tables.table(spark, folder, "lineitem").count() // 400)
    partitions, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        claims = tables.synthesised(spark, folder, entity_queries.CLAIMS, ("lineitem", "orders"), by={"lineitem": "l_orderkey", "orders": "o_orderkey"}).rdd.getNumPartitions()
        ranked = [f(spark, folder).rdd.getNumPartitions() for f in (entity_queries.resolve_domains, entity_queries.resolve_alternatives)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert least > 8 and (claims, ranked) == (least, [least, least])


def test_candidates_are_counted_in_tasks_by_their_size_not_by_the_session(spark, monkeypatch):
    """With few shuffle partitions each task held, and from some size on spilled, its share of all claims twice."""
    for module in (tables, entity_queries):
        monkeypatch.setattr(module, "SORTED", 400)
    names = ("candidate_scores", "resolve_domains", "resolve_alternatives", "resolve_conflicts")
    plans = {n: _plan(getattr(entity_queries, n)(spark, "/root/testdata/sf0.001")) for n in names}
    assert all("REPARTITION_BY_NUM" in p and "ENSURE_REQUIREMENTS" not in p for p in plans.values())
    # Lines and orders, claims by domain and part, candidates by domain.
    assert plans["resolve_alternatives"].count("REPARTITION_BY_NUM") == 4


def test_claims_dealt_by_page_and_host_count_the_same(spark):
    """A third of the claims are one domain's; keys, flags, hosts and pages may be null."""
    r = random.Random(10)
    pick = lambda *of: r.choice(of)
    flag = lambda: pick(True, False, None)
    rows = [
        (1 if i % 3 == 0 else pick(2, 3, 4, None), pick(7, 8, 9, None), pick(1, 2, 3, 3, 4, 5, None), flag(), flag(), flag(), flag(), pick("a", "b", "c", None), pick(*range(90), None), flag(), flag())
        for i in range(1500)
    ]
    claims = spark.createDataFrame(rows, CLAIM)
    want = sorted(map(str, resolution.score_candidates(claims).collect()))
    for tasks in (1, 5, 40):
        dealt = resolution.score_candidates(claims, tasks)
        assert dealt.rdd.getNumPartitions() == tasks and sorted(map(str, dealt.collect())) == want
    assert len(want) == 20 and any("pages=31," in w for w in want)


def test_lines_of_six_gigabytes_are_dealt_to_joins_without_being_held():
    """To more than 200 tasks a file's share was held in memory, and spilled, before it was written."""
    assert -(-360 * 600_000 // tables.SORTED) <= 200 and tables.SORTED > entity_queries.SORTED
