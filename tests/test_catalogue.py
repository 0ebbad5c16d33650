"""Every registered query of the library against its SQL on the small tables."""

import pytest
from pyspark.sql import functions as F

from tests.compare import database, differences
from tradelens.operators import state
from tradelens.plans import catalogue
from tradelens.streaming.limits import fold

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, db, name):
    assert differences(catalogue.QUERIES[name](spark, FOLDER), db, catalogue.ORACLE_SQL[name]) == ""


def test_rate_limit_replay(spark):
    got = {(r.event_type, r.event_id): r.accepted for r in catalogue.QUERIES["rate_limit_replay"](spark, FOLDER).collect()}
    logs, want = {}, {}
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("ts", "event_id").collect():
        t, log = r.ts.timestamp(), logs.setdefault(r.event_type, [])
        log[:] = [x for x in log if t - x <= 7200]
        want[r.event_type, r.event_id] = len(log) < 8
        if len(log) < 8:
            log.append(t)
    assert got == want


def test_fold_leaves_no_trace_of_refusals():
    assert fold([], [0, 1, 2, 11, 12], 2, 10) == ([11, 12], [True, True, False, True, True])


def test_replace_people(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "eik int, name string")
    new = spark.createDataFrame([(1, "d")], "eik int, name string")
    assert sorted(map(tuple, state.replace_people(old, new).collect())) == [(1, "d"), (2, "c")]


def test_pages_of_a_whole_segment(spark, db):
    rows = spark.read.parquet(f"{FOLDER}/customer.parquet").where("c_mktsegment = 'BUILDING'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = state.paged(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], 5).select("c_custkey", "page")
    out = differences(got, db, "select c_custkey, cast(ceil(row_number() over (order by c_acctbal desc, c_custkey) / 5.0) as int) as page from customer where c_mktsegment = 'BUILDING'")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out == ""


def test_pages_made_of_a_small_file_are_read_by_all_tasks(spark):
    from tradelens.plans import catalogue

    for name in DEALT:
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


DEALT = ["extract_roundtrip", "page_reader"]


def test_pages_made_of_keys_are_dealt_before_they_are_made(spark):
    from tradelens.plans import prose_queries

    shops = prose_queries._shops(spark, "/root/testdata/sf0.001")
    assert shops.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_triage_makes_its_pages_in_all_tasks(spark, monkeypatch):
    from tradelens.plans import verb_queries

    class Made(Exception):
        pass

    def made(df, tag):
        raise Made(df.rdd.getNumPartitions())

    monkeypatch.setattr(verb_queries, "written", made)
    with pytest.raises(Made) as e:
        verb_queries.triage(spark, "/root/testdata/sf0.001")
    assert e.value.args[0] == 2 * spark.sparkContext.defaultParallelism
