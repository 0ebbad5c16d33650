"""The store: whole commits or none, each batch once, and the jobs over it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradelens.operators import persist
from tradelens.sources.store import Conflict, Store

CHECK = "domain string, url string, at timestamp, status string, eik string, verified boolean, name string, seat string, entity_status string, confidence double, basis string, site string, people array<struct<name: string, role: string>>, evidence array<struct<tier: string, url: string, claim: string, content_hash: string>>"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def check(domain, day, eik=None, name=None, site="ok", verified=True, people=()):
    return (domain, f"https://{domain}/", at(day), "identified", eik, verified, name, "Sofia", "active", 0.9, "official", site, [(p, "manager") for p in people], [("company_source", f"https://{domain}/a", f"EIK {eik}", None)])


def rows(store, table, *columns):
    return sorted(map(tuple, store.read(table).select(*columns).collect()), key=str)


def test_a_commit_is_whole_and_a_batch_counts_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("domains").count() == 0 and persist.entity(store, "1").count() == 0
    first = spark.createDataFrame([check("a.bg", 0, "1", "Old", people=("Anna", "Ivan")), check("b.bg", 0, "2", "B", verified=False), check("a.bg", 1, "1", "Alpha", people=("Anna",))], CHECK)
    assert persist.persist(store, first, "q", 0) and not persist.persist(store, first, "q", 0)
    assert rows(store, "domains", "domain", "first_seen") == [("a.bg", at(1)), ("b.bg", at(0))]
    assert rows(store, "entities", "eik", "name") == [("1", "Alpha")] and rows(store, "people", "name") == [("Anna",)]
    assert rows(store, "subscriptions", "eik", "provider") == [("1", "register"), ("1", "vat-poll")]
    second = spark.createDataFrame([check("a.bg", 5, "1", "Renamed", "blocked")], CHECK)
    sink = persist.sink(store, "q")
    sink(second, 1)
    sink(second, 1)
    assert rows(store, "audit", "action", "eik", "detail") == [("official_record_changed", "1", "name")]
    assert rows(store, "domains", "domain", "first_seen", "last_checked") == [("a.bg", at(1), at(5)), ("b.bg", at(0), at(0))]
    assert rows(store, "people", "name") == [("Anna",)]  # a check that names nobody leaves them
    told = rows(store, "evidence", "domain", "claim", "seen_at")
    assert told == [("a.bg", "EIK 1", at(1)), ("a.bg", "direct acquisition: blocked", at(5)), ("b.bg", "EIK 2", at(0))]
    assert store.state()["version"] == 2 and [r.name for r in persist.entity(store, "1").collect()] == ["Renamed"]


def test_writers_that_meet_and_one_that_was_lost(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": "k int"})
    base = store.state()
    assert store.commit({"t": spark.createDataFrame([(1,)], "k int")}, base)
    with pytest.raises(Conflict):
        store.commit({"t": spark.createDataFrame([(2,)], "k int")}, base)
    (tmp_path / "manifests" / "0000000002").write_text('{"version": 2, "tab')  # its writer went while it wrote
    assert rows(store, "t", "k") == [(1,)]
    assert store.commit({"t": spark.createDataFrame([(3,)], "k int")})
    assert rows(store, "t", "k") == [(3,)] and store.state()["version"] == 3
    assert store.vacuum(keep=1) == 1 and rows(store, "t", "k") == [(3,)]


def test_refresh_tells_again_takes_records_and_purges(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    persist.persist(store, spark.createDataFrame([check("old.bg", 0, "1", "Gone"), check("a.bg", 190, "2", "A"), check("b.bg", 200, "3", "B"), check("c.bg", 230, "4", "C")], CHECK))
    answers = spark.createDataFrame([("2", "confirmed", "A new", "Varna"), ("3", "unavailable", None, None), ("4", "not_found", None, None)], "eik string, state string, name string, seat string")
    records = spark.createDataFrame([("9", "Delivered", "Ruse", "registered", "{}")], "eik string, name string, seat string, status string, record string")
    got = persist.refresh(store, answers, records, "2024-08-20 00:00:00")
    assert got == {"reverified": 1, "records": 1, "purged_domains": 1}
    assert rows(store, "entities", "eik", "name", "status") == [("2", "A new", "vat_registered"), ("3", "B", "active"), ("4", "C", "active"), ("9", "Delivered", "registered")]
    assert rows(store, "domains", "domain") == [("a.bg",), ("b.bg",), ("c.bg",)] and rows(store, "records", "eik") == [("9",)]
    assert rows(store, "links", "domain") == [("a.bg",), ("b.bg",), ("c.bg",)]
    assert store.read("entities").where("eik = '2'").select(F.date_format("checked", "yyyy-MM-dd")).first()[0] == "2024-08-20"


def test_what_a_purge_hangs_on_is_computed_once(spark):
    from tradelens.operators import state

    reads = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: reads.add(1) or x, "string").asNondeterministic()
    domains = spark.createDataFrame([("a", "2024-01-01"), ("b", "2020-01-01")], "domain string, at string").select(count("domain").alias("domain"), F.to_timestamp("at").alias("last_checked"))
    links = spark.createDataFrame([("a", 1), ("b", 2)], "domain string, eik int")
    eiks = links.select("eik")
    tables = {"domains": domains, "links": links, "evidence": links, "entities": eiks, "subscriptions": eiks, "roles": eiks.withColumn("person", F.col("eik")), "people": eiks.select(F.col("eik").alias("person")), "cache": spark.sql("select 'dns' as kind, timestamp '2024-01-02 00:00:00' as stored_at")}
    left = {t: df.count() for t, df in state.purge(tables, "2024-01-03 00:00:00").items()}
    assert set(left.values()) == {1} and reads.value == 2
