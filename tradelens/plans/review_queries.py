"""Queries about coverage, requests, jobs under way, declarations and offered values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requests, review, state
from ..sources.tables import synthesised, table
from .registry import plain, query

TRUTH = "select c_custkey as shop, case c_custkey % 3 when 0 then 'eik' when 1 then 'phone' else 'email' end as field, c_custkey % 4 <> 0 as published, c_custkey % 10 as value from {customer}"
FOUND = "select o_custkey as shop, case o_custkey % 3 when 0 then 'eik' when 1 then 'phone' else 'email' end as field, case when o_orderkey % 5 = 0 then null else o_orderkey % 10 end as value from {orders} where o_orderkey % 4 = 0"
_COVERAGE = f"select shop, field, case when bool_or(published) and bool_or(coalesce(v = value, false)) then 'found' when count(v) > 0 then 'conflicting' when bool_or(published) and count(hit) > 0 then 'unavailable' else 'not_found' end as coverage from (select t.shop, t.field, t.published, t.value, f.value as v, f.shop as hit from ({plain(TRUTH)}) t left join ({plain(FOUND)}) f using (shop, field)) group by shop, field"


def _coverage(spark, folder):
    return review.coverage(synthesised(spark, folder, TRUTH, ("customer",)), synthesised(spark, folder, FOUND, ("orders",)))


@query(f"select field, {', '.join(f'''count_if(coverage = '{c}') as n_{c}''' for c in review.COVERAGE)}, count(*) as n from ({_COVERAGE}) group by field")
def coverage_crosstab(spark, folder):
    return review.crosstab(_coverage(spark, folder))


SHORT = "select c_custkey as shop, case c_custkey % 3 when 0 then 'identity' when 1 then 'contact' else 'address' end as kind from {customer}"
CODES = "select distinct o_custkey as shop, case o_orderkey % 4 when 0 then 'no_id' when 1 then 'no_email' when 2 then 'no_phone' else 'no_address' end as code from {orders}"
BRIDGE = "select 'identity' as kind, 'no_id' as code union all select 'contact', 'no_email' union all select 'contact', 'no_phone' union all select 'address', 'no_address'"


def _reviewed(spark, folder):
    return synthesised(spark, folder, SHORT, ("customer",)), synthesised(spark, folder, CODES, ("orders",)), spark.sql(BRIDGE)


@query(f"select shop, kind, exists (select 1 from ({plain(CODES)}) c join ({BRIDGE}) b using (code) where c.shop = s.shop and b.kind = s.kind) as reproduced from ({plain(SHORT)}) s")
def shortfall_reproduction(spark, folder):
    return review.reproduced(*_reviewed(spark, folder))


@query(f"select shop, code from ({plain(CODES)}) c where not exists (select 1 from ({plain(SHORT)}) s join ({BRIDGE}) b using (kind) where s.shop = c.shop and b.code = c.code)")
def false_alarms(spark, folder):
    return review.false_alarms(*_reviewed(spark, folder))


ALERTS = "select o_custkey as shop, o_orderpriority as code, cast(substr(o_orderpriority, 1, 1) as int) as severity, o_orderdate as observed from {orders}"


@query(f"select shop, array_to_string(list(severity || ':' || code || ':' || times order by severity, code)[1:3], ',') as codes, count(*) as n_codes, cast(sum(times) as bigint) as n_rows, max(observed) as observed from (select shop, code, min(severity) as severity, count(*) as times, max(observed) as observed from ({plain(ALERTS)}) group by shop, code) group by shop")
def publish_worklist(spark, folder):
    return review.worklist(synthesised(spark, folder, ALERTS, ("orders",)), 3).drop("json")


@query("select s_suppkey as eik, s_name as name from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, 'new ' || s_name from supplier where s_suppkey % 3 = 0")
def people_replace(spark, folder):
    old = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("eik"), F.col("s_name").alias("name"))
    return state.replace_people(old, old.where("eik % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")))


PEOPLE = "select s_nationkey as eik, case when s_suppkey % 2 = 0 then 'Anna' else 'ANNA' end as name, concat('role', cast(s_suppkey % 3 as string)) as role, s_suppkey % 5 = 0 as verified, s_suppkey as seq from {supplier}"


@query(f"select eik, name, role, verified from (select *, row_number() over (partition by eik, lower(name) order by verified desc, seq) as n from ({plain(PEOPLE)})) where n = 1")
def people_union(spark, folder):
    return requests.people_union(synthesised(spark, folder, PEOPLE, ("supplier",)))


FIELDS = "select c_custkey as eik, 'name' as field, c_name as value from {customer} union all select c_custkey, 'segment', c_mktsegment from {customer} union all select c_custkey, 'nation', cast(c_nationkey as string) from {customer}"


@query(f"select * from ({plain(FIELDS)}) where field in ('name', 'segment') and not (field = 'segment' and eik % 4 = 0)")
def restricted_output(spark, folder):
    rules = table(spark, folder, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("eik"), F.lit("segment").alias("field"))
    return requests.without_restricted(synthesised(spark, folder, FIELDS, ("customer",)), rules, ("name", "segment"))


ACTIONS = "select user_id as request, event_id as seq, case event_type when 'view' then 'open' when 'click' then 'restrict' when 'purchase' then 'resolve' else 'erase' end as action, case when event_type = 'click' then concat('f', cast(event_id % 3 as string)) end as field from {events}"


@query(f"select request, coalesce(arg_max(case when action = 'resolve' then 'resolved' else 'open' end, seq) filter (where action in ('open', 'resolve')), 'open') as status, coalesce(array_to_string(list_sort(list(distinct field) filter (where action = 'restrict')), ','), '') as restricted, bool_or(action = 'erase') as erased, count(*) as n_events from ({plain(ACTIONS)}) group by request")
def dsr_fold(spark, folder):
    return requests.request_state(synthesised(spark, folder, ACTIONS, ("events",)))


@query(None)
def inflight_dedupe(spark, folder):
    jobs = table(spark, folder, "events").withColumn("end", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, 600 + event_id % 7 * 600)"))
    return requests.in_flight(jobs, "event_type", "ts", "end", "event_id")


DECLARED = "select concat('Shop', cast(cast(floor(c_custkey / 3) as int) as string), '.example.com') as domain, concat('shop', cast(cast(floor(c_custkey / 2) as int) as string), '.example.com') as platform, c_custkey as seq, concat('Owner, ', cast(100000000 + c_custkey as string)) as owner from {customer}"


@query(f"select domain, seq, cast(p as int) as priority, cast(100000000 + seq as varchar) as eik from (select *, row_number() over (partition by domain order by seq) as n from (select *, min(p) over (partition by domain) as best from (select 'shop' || c_custkey || '.example.com' as domain, seq, p from customer join (select lower(domain) as d, seq, 1 as p from ({plain(DECLARED)}) union all select platform, seq, 2 from ({plain(DECLARED)})) on d = 'shop' || c_custkey || '.example.com')) where p = best) where n <= 5")
def declaration_match(spark, folder):
    domains = table(spark, folder, "customer").select(F.concat(F.lit("shop"), F.col("c_custkey").cast("string"), F.lit(".example.com")).alias("domain"))
    return requests.declarations(domains, synthesised(spark, folder, DECLARED, ("customer",)))


PROFILE = "select o_custkey as domain, concat('f', cast(l_linenumber as string)) as field, min(case when l_suppkey % 3 = 0 then l_suppkey end) as value, case when min(l_partkey) % 3 = 0 then 'conflicting' else 'not_found' end as status from {lineitem} join {orders} on l_orderkey = o_orderkey group by 1, 2"
OFFERS = "select o_custkey as domain, concat('f', cast(l_linenumber as string)) as field, l_suppkey as value from {lineitem} join {orders} on l_orderkey = o_orderkey where l_returnflag = 'R'"
ON_PAGES = "select o_custkey as domain, l_suppkey as value from {lineitem} join {orders} on l_orderkey = o_orderkey where l_linenumber % 2 = 0"


@query(f"with p as ({plain(PROFILE)}), a as (select domain, field from (select *, row_number() over (partition by domain order by field) as n from p where value is null and status in ('not_found', 'unavailable')) where n <= 2), o as (select domain, field, min(value) as offer from ({plain(OFFERS)}) group by 1, 2), b as (select a.domain, a.field, offer from a join o using (domain, field) where exists (select 1 from ({plain(ON_PAGES)}) v where v.domain = a.domain and v.value = offer)) select domain, field, coalesce(value, offer) as value, case when offer is not null then 'model' else status end as status from p left join b using (domain, field)")
def ai_fill(spark, folder):
    both = ("lineitem", "orders")
    return requests.model_fill(*(synthesised(spark, folder, s, both) for s in (PROFILE, OFFERS, ON_PAGES)), 2)
