"""Queries that write a store in batches, one of them twice, and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import persist
from ..sources.store import Store
from ..sources.tables import synthesised, work_path
from .registry import plain, query

#: Checks of customers: of even keys in the first batch, of every third in the second, where every fifth is renamed.
CHECKS = "select c_custkey as k, n, concat('shop', cast(c_custkey as string), '.example') as domain, case when c_custkey % 7 > 0 then cast(200000000 + c_custkey as string) end as eik, c_custkey % 4 > 0 as verified, concat('Firm ', cast(c_custkey as string), case when n = 1 and c_custkey % 5 = 0 then ' New' else '' end) as name, case when c_custkey % 6 = n then 'blocked' else 'ok' end as site from (select *, 0 as n from {customer} where c_custkey % 2 = 0 union all select *, 1 as n from {customer} where c_custkey % 3 = 0)"


def _stored(spark, folder):
    rows = synthesised(spark, folder, CHECKS, ("customer",))
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(n * 10)")
    people = F.when(F.col("n") == 0, F.array(F.struct(F.lit("Anna").alias("name"), F.lit("manager").alias("role")))).otherwise(F.array().cast("array<struct<name: string, role: string>>"))
    evidence = F.array(F.struct(F.lit("company_source").alias("tier"), F.concat(F.lit("https://"), "domain").alias("url"), F.concat(F.lit("EIK "), "eik").alias("claim"), F.lit(None).cast("string").alias("content_hash")))
    checks = rows.select("n", "domain", F.concat(F.lit("https://"), "domain").alias("url"), at.alias("at"), F.lit("identified").alias("status"), "eik", "verified", "name", F.lit("Sofia").alias("seat"), F.lit("active").alias("entity_status"), F.lit(0.9).alias("confidence"), F.lit("official").alias("basis"), "site", people.alias("people"), evidence.alias("evidence"))
    store = Store(spark, work_path(spark, "store"))
    for batch in (0, 0, 1, 1):  # as a restarted stream would
        persist.persist(store, checks.where(F.col("n") == batch).drop("n"), "checks", batch)
    return store


_C = plain(CHECKS).replace("as string", "as varchar")


@query(f"""with c as ({_C}), d as (select domain, min(n) as a, max(n) as z, bool_or(n = 1) as second from c group by domain), e as (select eik, arg_max(name, n) as name, count(*) > 1 and count(distinct name) > 1 as renamed from c where verified and eik is not null group by eik),
v as (select domain, count(*) as n_evidence from (select distinct domain, 'E' || coalesce(eik, '-') || verified as claim from c union select distinct domain, site from c where site <> 'ok') group by domain)
select d.domain, 10 * a as first_day, 10 * z as last_day, e.eik, e.name, coalesce(e.renamed, false) as renamed, n_evidence, case when e.eik is not null and a = 0 then 'Anna' end as person from d left join (select distinct domain, eik from c where verified) l using (domain) left join e using (eik) left join v using (domain)""")
def persisted_checks(spark, folder):
    store = _stored(spark, folder)
    day = lambda c: F.datediff(F.col(c), F.lit("2024-01-01")).alias(c.replace("_seen", "_day").replace("_checked", "_day"))
    domains = store.read("domains").select("domain", day("first_seen"), day("last_checked"))
    renamed = store.read("audit").select("eik", F.lit(True).alias("renamed")).distinct()
    people = store.read("people").select("eik", F.col("name").alias("person"))
    known = store.read("links").select("domain", "eik").join(store.read("entities").select("eik", "name"), "eik").join(renamed, "eik", "left").join(people, "eik", "left")
    n = store.read("evidence").groupBy("domain").agg(F.count(F.lit(1)).alias("n_evidence"))
    out = domains.join(known, "domain", "left").join(n, "domain", "left")
    return out.select("domain", "first_day", "last_day", "eik", "name", F.coalesce("renamed", F.lit(False)).alias("renamed"), "n_evidence", "person")
