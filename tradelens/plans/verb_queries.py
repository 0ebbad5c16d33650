"""Queries of the verbs and of state changes, over shops, evidence and stores made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state, verbs
from ..sources.tables import synthesised, table, written
from .registry import plain, query
from .site_queries import SHOPS, _filled

_FRONT = '<html><body><p>Търговец: {company}</p><div>ЕИК</div><div>{eik}</div></body></html>'
_LEGAL = '<p>Адрес: {address}</p><p>Тел.: {phone}</p><a href="mailto:{email}">us</a><p>Фирма: {other}</p>'


@query(f"""select 'https://shop' || k || '.example/' as url, 'shop' || k || '.example' as domain, case when verdict is null and k % 11 <> 0 then company end as company, case when verdict is null and k % 11 <> 0 then eik end as eik, null as vat,
 case when verdict is null and k % 5 <> 0 then address end as address, case when verdict is null and k % 5 <> 0 then phone end as phone, case when verdict is null and k % 5 <> 0 then email end as email,
 cast(case when verdict is not null then 0 else (case when k % 11 <> 0 then 1 else 0 end) + (case when k % 5 <> 0 and (k % 3 = 0 or k % 11 = 0) then 1 else 0 end) end as bigint) as n_names, cast(case when verdict is not null then 0 else 2 end as bigint) as pages, case when verdict is null then score end as score, coalesce(verdict, case when score < 20 then 'ok' when score < 50 then 'suspect' else 'noncompliant' end) as verdict
 from (select *, case when k % 7 = 0 then 'blocked' when k % 13 = 0 then 'unreachable' end as verdict, cast(least(100, (case when k % 11 = 0 then 50 else 0 end) + (case when k % 5 = 0 then 40 else 0 end) + (case when k % 11 = 0 and k % 5 = 0 then 10 else 0 end) + (case when k % 5 <> 0 and k % 3 = 0 and k % 11 <> 0 then 10 else 0 end)) as int) as score from ({plain(SHOPS)}))
 """.replace("case when verdict is null and k % 11 <> 0 then company end", "case when verdict is not null then null when k % 11 <> 0 then company when k % 5 <> 0 then 'Other Trade ' || k || ' OOD' end").replace("(case when k % 5 <> 0 and (k % 3 = 0 or k % 11 = 0) then 1 else 0 end)", "(case when k % 5 <> 0 and (k % 3 = 0 or k % 11 = 0) then 1 else 0 end)"))
def triage(spark, folder):
    k = F.col("k")
    shops = synthesised(spark, folder, SHOPS, ("customer",), dealt=True).withColumn("n", k.cast("string"))
    # Every third shop's legal page names another company, and so does every eleventh's, whose front page says nothing.
    shops = shops.withColumn("other", F.when((k % 3 == 0) | (k % 11 == 0), F.concat(F.lit("Other Trade "), "n", F.lit(" OOD"))).otherwise(F.col("company")))
    url = F.concat(F.lit("https://shop"), "n", F.lit(".example/"))
    status = F.when(k % 7 == 0, 403).when(k % 13 == 0, 500).otherwise(200)
    front = shops.select(url.alias("url"), url.alias("final_url"), F.lit(1).alias("seq"), status.alias("status"), F.when(k % 11 == 0, "<p>welcome</p>").otherwise(_filled(_FRONT, "company", "eik")).alias("html"))
    legal = shops.select(url.alias("url"), F.concat(url, F.lit("terms")).alias("final_url"), F.lit(2).alias("seq"), status.alias("status"), F.when(k % 5 == 0, "<p>nothing</p>").otherwise(_filled(_LEGAL, "address", "phone", "email", "other")).alias("html"))
    return verbs.triage(written(front.unionByName(legal), "fetches")).drop("findings")


_PAGES = f"select concat('shop', cast(k as string), '.example') as domain, concat('www.shop', cast(k as string), '.example') as host, cast(k as bigint) as page, case when k % 3 = 0 then eik when k % 3 = 1 then 'none' end as eik, case when k % 4 = 0 then concat('BG', eik) when k % 4 = 1 then concat('DE', eik) end as vat, company from ({SHOPS})"
_FOUND = f"select concat('shop', cast(k as string), '.example') as domain, case when k % 2 = 0 then 'other.example' else concat('shop', cast(k as string), '.example') end as host, cast(-k as bigint) as page, eik, case when k % 6 = 0 then concat('see SHOP', cast(k as string), '.example here') else 'nothing' end as text from ({SHOPS})"
_ANSWERS = f"select eik, case k % 3 when 0 then 'confirmed' when 1 then 'not_found' else 'unavailable' end as state, case when k % 2 = 0 then company else 'Quite Another AD' end as name from ({SHOPS})"


def _claims(spark, folder):
    # Captured tables, as the verbs meet them: what they are made by isn't part of the plan.
    pages, found = (written(synthesised(spark, folder, x, ("customer",)), "captured") for x in (_PAGES, _FOUND))
    shops = written(synthesised(spark, folder, SHOPS, ("customer",)), "shops")
    mentions = pages.where("page % 5 = 0").join(shops.select(F.col("k").alias("page"), F.col("eik").alias("e")), "page")
    mentions = mentions.select("domain", "host", "page", F.col("company").alias("name"), F.col("e").alias("eik"), (F.col("page") % 2 == 0).alias("operator"))
    declared = shops.where("k % 9 = 0").select(F.concat(F.lit("shop"), F.col("k").cast("string"), F.lit(".example")).alias("domain"), "eik", F.col("company").alias("name"))
    return verbs.evidence(pages, mentions, declared, found)


_CLAIMS_SQL = f"""select domain, eik, 'own_id' as branch, 3 as tier, false as operator, true as own, company as name from (select * from ({plain(_PAGES)})) where eik is not null and eik <> 'none'
 union all select domain, substr(vat, 3), 'own_vat', 3, false, true, company from ({plain(_PAGES)}) where vat like 'BG%'
 union all select 'shop' || k || '.example', eik, 'mention', 3, k % 2 = 0, true, company from ({plain(SHOPS)}) where k % 5 = 0
 union all select 'shop' || k || '.example', eik, 'declaration', 2, true, false, company from ({plain(SHOPS)}) where k % 9 = 0
 union all select domain, eik, 'search', 5, false, host = domain, null from ({plain(_FOUND)}) where host = domain or text <> 'nothing'"""


@query(f"select branch, tier, operator, own, count(*) as n, count(distinct domain) as domains, min(eik) as first from ({_CLAIMS_SQL}) group by all")
def evidence_branches(spark, folder):
    return _claims(spark, folder).groupBy("branch", "tier", "operator", "own").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("domains"), F.min("eik").alias("first"))


@query(f"with a as (select eik, min(name) as official from ({plain(_ANSWERS)}) where state = 'confirmed' group by eik) select domain, eik, branch, official is not null as confirmed, case when official is not null and name is not null then name = official end as name_ok from ({_CLAIMS_SQL}) left join a using (eik)")
def official_answers(spark, folder):
    return verbs.with_official(_claims(spark, folder), synthesised(spark, folder, _ANSWERS, ("customer",))).select("domain", "eik", "branch", "confirmed", "name_ok")


@query(f"select domain, vat, page as seq from ({plain(_PAGES)}) where vat like 'DE%'")
def foreign_vat(spark, folder):
    return verbs.foreign_numbers(synthesised(spark, folder, _PAGES, ("customer",)).withColumnRenamed("page", "seq"))


_HTTP = "select o_custkey as provider, case o_orderkey % 4 when 0 then 200 when 1 then 500 when 2 then null else case when o_custkey % 10 = 0 then 403 else 429 end end as status, o_orderkey % 3 as n from {orders}"


@query(f"select provider, coalesce(cast(sum(n) filter (where status = 200) as bigint), 0) as n, case when bool_or(coalesce(status = 403, false)) then 'failed' when count(*) filter (where status = 200) = 0 then 'unavailable' when sum(n) filter (where status = 200) > 0 then 'found' else 'not_found' end as state from ({plain(_HTTP)}) group by provider")
def provider_states(spark, folder):
    return verbs.provider_state(synthesised(spark, folder, _HTTP, ("orders",)))


_ASKED = "select concat('shop', cast(s_suppkey as string), '.example') as domain, case when s_suppkey % 2 = 0 then concat('shop', cast(s_suppkey as string), '.example') else concat('m.shop', cast(s_suppkey as string), '.example') end as host, s_suppkey as k, s_name as name from {supplier}"


@query(f"""select domain, cast(place - 1 as int) as place, q as query from (select domain, unnest(l) as q, generate_subscripts(l, 1) as place from (select domain, list_filter(['"' || domain || '" ЕИК', 'site:' || domain || ' "ЕИК"', '"' || domain || '" "Общи условия"', 'site:' || domain || ' "Общи условия"', '"' || domain || '" EIK', case when host <> domain then '"' || host || '" ЕИК' end, case when k % 3 > 0 then '"' || domain || '" "' || name || '"' end, case when k % 3 > 1 then '"' || domain || '" "b"' end], lambda x: x is not null) as l from ({plain(_ASKED)})))""")
def search_plan(spark, folder):
    rows = synthesised(spark, folder, _ASKED, ("supplier",))
    names = F.when(F.col("k") % 3 == 1, F.array("name")).when(F.col("k") % 3 == 2, F.array(F.col("name"), F.lit("b"), F.lit("c")))
    return verbs.search_queries(rows.withColumn("names", names))


_RECORDS = "select c_custkey as eik, concat(case c_custkey % 3 when 0 then 'ALPHA' when 1 then 'Beta Trade' else 'Gamma' end, ' ', cast(c_custkey % 40 as string), case c_custkey % 2 when 0 then ' \"X\" ООД' else ' - АД' end) as name from {customer}"
_WANTED = "select distinct concat('\"', case s_suppkey % 3 when 0 then 'alpha' when 1 then 'rade' else 'amma' end, ' ', cast(s_suppkey % 40 as string), '\" ЕООД') as name from {supplier} union all select 'ha' union all select '7' union all select 'no such name'"
_CORE = "trim(regexp_replace(regexp_replace(regexp_replace(upper(replace({0}, '\"', ' ')), ' (ЕООД|ООД|ЕАД|АД|ЕТ|-)( (ЕООД|ООД|ЕАД|АД|ЕТ|-))*$', ''), ' - ', ' '), ' +', ' ', 'g'))"


@query(f"select name, eik, record, cast(place as int) as place from (select w.name, r.eik, r.name as record, row_number() over (partition by w.name order by r.eik) as place from ({plain(_WANTED)}) w join ({plain(_RECORDS)}) r on contains(upper(r.name), {_CORE.format('w.name')})) where place <= 5")
def register_names(spark, folder):
    return verbs.register_search(synthesised(spark, folder, _WANTED, ("supplier",)), synthesised(spark, folder, _RECORDS, ("customer",)))


_STATES = "select o_orderkey as k, case o_orderkey % 5 when 0 then 'conflicting' when 1 then 'unavailable' when 2 then 'ai_assisted_page' when 3 then 'published' else 'not_found' end as status, case when o_orderkey % 3 = 0 then null else o_orderkey end as value from {orders}"


@query(f"select c, count(*) as n from (select case when status = 'conflicting' then 'conflicting' when value is not null and status = 'ai_assisted_page' then 'found_by_model' when value is not null then 'found' when status = 'unavailable' then 'unavailable' else 'not_found' end as c from ({plain(_STATES)})) group by c")
def coverage_classes(spark, folder):
    rows = synthesised(spark, folder, _STATES, ("orders",)).select(verbs.coverage_of(F.col("status"), F.col("value")).alias("c"))
    return rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


_OLD_LINKS = "select o_custkey as domain, o_orderkey % 7 as eik, max(o_totalprice) as confidence, min(o_orderdate) as linked_at from {orders} where o_orderkey % 2 = 0 group by 1, 2"
_NEW_LINKS = "select o_custkey as domain, o_orderkey % 7 as eik, case when o_custkey % 3 = 0 then null else max(o_totalprice) end as confidence, max(o_orderdate) as linked_at from {orders} where o_orderkey % 3 = 0 group by o_custkey, o_orderkey % 7"


@query(f"select domain, eik, coalesce(n.confidence, o.confidence) as confidence, coalesce(o.linked_at, n.linked_at) as linked_at from ({plain(_OLD_LINKS)}) o full join ({plain(_NEW_LINKS)}) n using (domain, eik)")
def upsert_links(spark, folder):
    return state.link(synthesised(spark, folder, _OLD_LINKS, ("orders",)), synthesised(spark, folder, _NEW_LINKS, ("orders",)))


_STORE = {
    "domains": "select o_custkey as domain, max(o_orderdate) as last_checked from {orders} group by 1",
    "links": "select distinct o_custkey as domain, o_orderkey % 5000 as eik from {orders}",
    "evidence": "select o_custkey as domain, o_orderkey % 5000 as eik, o_orderkey as item from {orders}",
    "entities": "select distinct o_orderkey % 6000 as eik from {orders}",
    "subscriptions": "select distinct o_orderkey % 5500 as eik, o_orderkey % 3 as provider from {orders}",
    "roles": "select distinct o_orderkey % 5500 as eik, o_custkey as person from {orders}",
    "people": "select c_custkey as person from {customer}",
    "cache": "select case o_orderkey % 2 when 0 then 'result' else 'dns' end as kind, o_orderdate as stored_at from {orders}",
}
_AS_OF = "1998-12-31 00:00:00"


def _kept_sql() -> str:
    t = {k: f"({plain(v)})" for k, v in _STORE.items()}
    return f"""with d as (select * from {t['domains']} where last_checked >= timestamp '{_AS_OF}' - interval 180 days), l as (select * from {t['links']} where domain in (select domain from d)), h as (select distinct eik from l), e as (select * from {t['evidence']} where domain in (select domain from d) and eik in (select eik from h)),
    n as (select * from {t['entities']} where eik in (select eik from h)), s as (select * from {t['subscriptions']} where eik in (select eik from h)), r as (select * from {t['roles']} where eik in (select eik from h)), p as (select * from {t['people']} where person in (select person from r)),
    c as (select * from {t['cache']} where not (kind = 'result' and epoch(timestamp '{_AS_OF}') - epoch(stored_at) > 600) and epoch(timestamp '{_AS_OF}') - epoch(stored_at) <= 300 * 86400)
    select 'domains' as t, count(*) as n from d union all select 'links', count(*) from l union all select 'evidence', count(*) from e union all select 'entities', count(*) from n union all select 'subscriptions', count(*) from s union all select 'roles', count(*) from r union all select 'people', count(*) from p union all select 'cache', count(*) from c"""


@query(_kept_sql())
def retention_cascade(spark, folder):
    kept = state.purge({k: synthesised(spark, folder, v, ("orders",) if k != "people" else ("customer",)) for k, v in _STORE.items()}, _AS_OF, cached=300 * 86400)
    out = None
    for t, df in kept.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_ENTITIES = "select c_custkey as eik, c_name as name, c_mktsegment as seat, 'vat_registered' as status from {customer} where c_custkey % 5 <> 0"
_CHECKS = "select c_custkey as eik, case c_custkey % 3 when 0 then 'confirmed' when 1 then 'not_found' else 'unavailable' end as state, case when c_custkey % 2 = 0 then c_name else 'renamed' end as name, c_mktsegment as seat from {customer} where c_custkey % 4 <> 0"


@query(f"select eik, case when c.state = 'confirmed' then c.name else e.name end as name, e.seat, case when c.state = 'not_found' then 'not_in_vies' else e.status end as status, concat_ws(',', case when c.state = 'confirmed' and c.name <> e.name then 'name' end, case when c.state = 'not_found' then 'status' end) as changed from ({plain(_ENTITIES)}) e left join ({plain(_CHECKS)}) c using (eik)")
def stale_refresh(spark, folder):
    return state.reverified(synthesised(spark, folder, _ENTITIES, ("customer",)), synthesised(spark, folder, _CHECKS, ("customer",)))


@query("select event_id as job from (select event_id, row_number() over (order by ts desc, event_id) as n from events where event_type <> 'view') where n > greatest(0, (select count(*) from events) * 9 // 10 - (select count(*) from events where event_type = 'view'))")
def evicted_jobs(spark, folder):
    jobs = table(spark, folder, "events").select(F.col("event_id").alias("job"), (F.col("event_type") != "view").alias("finished"), F.col("ts").alias("updated"))
    return state.evicted(jobs, table(spark, folder, "events").count() * 9 // 10)


@query("select day, cast(sum(n) as bigint) as n from (select cast(ts as date) as day, count(*) as n from events where event_id % 2 = 0 group by 1 union all select cast(ts as date), count(*) from events where event_id % 2 = 1 group by 1) group by day")
def budget_usage(spark, folder):
    e = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return state.use_budget(e.where("event_id % 2 = 0").groupBy("day").agg(F.count(F.lit(1)).alias("n")), e.where("event_id % 2 = 1"))
