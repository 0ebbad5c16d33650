"""Queries about identifiers, claims, profiles and state over the driver's tables, each with the SQL that another engine answers it by.

The tables hold no trader data, so most queries make theirs from keys in a SELECT that both engines run (S below);
what the operators do with it is written twice, as DataFrame operators and as SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import web
from ..operators import profiles, resolution, state
from ..sources.tables import synthesised, table, tasks_for
from .registry import plain as _sql
from .registry import query

def _sum11(raw: str, weights) -> str:
    return "((" + " + ".join(f"cast(substr({raw}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights)) + ") % 11)"


def _digit_sql(raw: str) -> str:
    """SQL of the check digit after eight digits."""
    once, twice = _sum11(raw, ids.NINE), _sum11(raw, ids.NINE_AGAIN)
    return f"(case when {once} < 10 then {once} else {twice} % 10 end)"


#: S: identifiers of customers: eight digits and their check digit; it is one too many for every seventh key, and there is no
#: identifier for every eleventh.
_EIGHT = "select c_custkey, lpad(cast(c_custkey * 7919 % 100000000 as string), 8, '0') as b from {customer}"
IDS = f"select c_custkey, case when c_custkey % 11 = 0 then null else concat(b, cast(({_digit_sql('b')} + case when c_custkey % 7 = 0 then 1 else 0 end) % 10 as string)) end as raw from ({_EIGHT})"
PHONES = """select s_suppkey, case s_suppkey % 10 when 0 then concat('+359 2 ', cast(9000000 + s_suppkey as string)) when 1 then concat('00359', cast(88000000 + s_suppkey as string))
 when 2 then concat('0', cast(88000000 + s_suppkey as string)) when 3 then concat('(02) ', cast(s_suppkey as string)) when 4 then concat('+359 (0) ', cast(8700000 + s_suppkey as string)) when 5 then concat('359 88 ', cast(8123456 + s_suppkey as string))
 when 6 then concat('+359 0700 ', cast(10000 + s_suppkey % 80000 as string)) when 7 then concat('*', cast(9000 + s_suppkey as string)) when 8 then null else concat('32 ', cast(640000 + s_suppkey as string)) end as raw from {supplier}"""
MAILS = """select s_suppkey, case s_suppkey % 10 when 0 then concat('mailto:Office', cast(s_suppkey as string), '@Shop.example.com?subject=x') when 1 then concat(' <john', cast(s_suppkey as string), '@example.org>. ')
 when 2 then concat('logo', cast(s_suppkey as string), '@2x.example.png') when 3 then concat('no at ', cast(s_suppkey as string)) when 4 then concat('(a.b+', cast(s_suppkey as string), '@mail.example.net)') when 5 then 'INFO-2@abv.example'
 when 6 then concat('my.onlineshop', cast(s_suppkey as string), '@mail.example') when 7 then 'delo@unit.cpdp.bg' when 8 then concat('x', cast(s_suppkey as string), '@10.0.0.12') else null end as raw from {supplier}"""
VATS = "select c_custkey, concat(case c_custkey % 4 when 0 then 'BG' when 1 then 'bg ' when 2 then 'DE' else '' end, cast(100000000 + c_custkey as string), case when c_custkey % 13 = 0 then '1' when c_custkey % 7 = 0 then '0001' else '' end) as raw from {customer}"
URLS = """select page_id, case page_id % 8 when 0 then url when 1 then replace(url, 'http', 'ftp') when 2 then concat(url, ' x') when 3 then 'https://user:pw@shop.example.com/' when 4 then 'http://10.1.2.3/'
 when 5 then 'https://shop.example.com:8443/a' when 6 then 'https://localhost/' else '' end as url from {pages}"""
#: S: a customer is a domain, its orders' first lines are claims, suppliers are candidates.
CLAIMS = """select o_custkey as domain, l_suppkey % 50 as eik, 1 + l_linenumber % 5 as tier, l_returnflag = 'R' as operator, l_shipdate < timestamp '1995-01-01 00:00:00' as archived, l_linenumber = 1 and l_suppkey % 5 = 0 as declared,
 l_linenumber % 3 = 0 as own, l_partkey % 7 as host, l_orderkey as page, case when l_suppkey % 3 = 0 then null else l_partkey % 2 = 0 end as name_ok, l_suppkey % 3 = 1 as confirmed
 from {lineitem} join {orders} on l_orderkey = o_orderkey"""
MERCHANTS = """select c_custkey as shop, case when c_custkey % 11 = 0 then null else c_custkey end as eik, c_custkey % 7 <> 0 as eik_ok, case when c_custkey % 5 = 0 then null else 'a' end as address, case when c_custkey % 3 = 0 then null else 'e' end as email,
 case when c_custkey % 2 = 0 then null else 'p' end as phone, case when c_custkey % 13 = 0 then null else c_name end as company, 1 + c_nationkey % 2 as n_names, case when c_custkey % 4 = 0 then 'v' else null end as vat from {customer}"""
VALUES = """select o_custkey as domain, case l_linenumber % 2 when 0 then 'phone' else 'name' end as field, l_suppkey % 4 as key, 1 + l_linenumber as authority, l_linenumber = 1 and l_suppkey % 4 = 0 as authoritative, l_suppkey % 9 = 0 as official,
 l_partkey % 3 as voice, l_linenumber % 3 as origin from {lineitem} join {orders} on l_orderkey = o_orderkey"""
OLD_DOMAINS = "select c_custkey as domain, timestamp '2024-01-01 00:00:00' as first_seen, timestamp '2024-02-01 00:00:00' as last_checked from {customer} where c_custkey % 3 <> 0"
NEW_DOMAINS = "select c_custkey as domain, timestamp '2024-03-01 00:00:00' as first_seen, timestamp '2024-03-05 00:00:00' as last_checked from {customer} where c_custkey % 2 = 0"
OLD_ENTITIES = "select c_custkey as eik, c_name as name, c_mktsegment as seat, case when c_custkey % 4 = 0 then null else 'active' end as status from {customer} where c_custkey % 5 <> 0"
NEW_ENTITIES = "select c_custkey as eik, case when c_custkey % 6 = 0 then concat(c_name, ' x') when c_custkey % 7 = 0 then null else c_name end as name, c_mktsegment as seat, case when c_custkey % 9 = 0 then 'closed' else 'active' end as status from {customer} where c_custkey % 3 <> 0"


_VALID = f"coalesce({_digit_sql('raw')} = cast(substr(raw, 9, 1) as int), false)"


@query(f"select c_custkey, raw, {_VALID} as valid from ({_sql(IDS)})")
def eik9_validate(spark, folder):
    return synthesised(spark, folder, IDS, ("customer",)).select("c_custkey", "raw", ids.identifier_valid(F.col("raw")).alias("valid"))


@query(f"select c_custkey, case when {_VALID} and c_custkey % 5 <> 0 then raw end as eik from ({_sql(IDS)})")
def eik_normalise(spark, folder):
    mark = F.when(F.col("c_custkey") % 5 == 0, "_").otherwise("-")  # an underscore is no separator
    spaced = F.concat(F.lit(" ["), F.substring("raw", 1, 3), mark, F.substring("raw", 4, 3), F.lit("."), F.substring("raw", 7, 3), F.lit("]"))
    return synthesised(spark, folder, IDS, ("customer",)).select("c_custkey", ids.identifier_or_null(spaced).alias("eik"))


@query(f"""select c_custkey, case when good then substr(v, 1, 2) end as country, case when good then substr(v, 3) end as number from (select c_custkey, v, regexp_matches(v, '^[A-Z][A-Z][0-9A-Z]{{2,13}}$') and (substr(v, 1, 2) <> 'BG' or length(v) = 11 or length(v) = 15) as good from (select c_custkey, replace(upper(raw), ' ', '') as v from ({_sql(VATS)})))""")
def vat_parse(spark, folder):
    parts = ids.vat_parts(F.col("raw"))
    return synthesised(spark, folder, VATS, ("customer",)).select("c_custkey", parts["country"].alias("country"), parts["number"].alias("number"))


@query(f"select c_custkey, case when regexp_full_match(v, '(BG)?([0-9]{{9}}|[0-9]{{13}})') then 'BG' || ltrim(v, 'BG') end as vat from (select c_custkey, regexp_replace(upper(raw), '[ .-]', '', 'g') as v from ({_sql(VATS)}))")
def vat_keys(spark, folder):
    return synthesised(spark, folder, VATS, ("customer",)).select("c_custkey", ids.vat_key(F.col("raw")).alias("vat"))


_NATIONAL = f"""select s_suppkey, case when regexp_full_match(n, '[0-9]{{7,9}}') then n end as n from (select s_suppkey, regexp_replace(case when d like '+359%' then substr(d, 5) when d like '00359%' then substr(d, 6) when d like '359%' and length(d) >= 11 then substr(d, 4) when d like '0%' and length(d) between 8 and 10 then substr(d, 2) end, '^0', '') as n
 from (select s_suppkey, regexp_replace(raw, '[^0-9+]', '', 'g') as d from ({_sql(PHONES)})))"""


@query(f"select s_suppkey, '+359' || n as phone from ({_NATIONAL})")
def phone_key(spark, folder):
    return synthesised(spark, folder, PHONES, ("supplier",)).select("s_suppkey", ids.phone_key(F.col("raw")).alias("phone"))


@query(f"select s_suppkey, '+359 ' || rtrim(case when n like '2%' then '2 ' || substr(n, 2, 3) || ' ' || substr(n, 5) when substr(n, 1, 3) in ('700', '800', '900') then substr(n, 1, 3) || ' ' || substr(n, 4, 2) || ' ' || substr(n, 6) else substr(n, 1, 2) || ' ' || substr(n, 3, 3) || ' ' || substr(n, 6) end) as phone from ({_NATIONAL})")
def phone_shown(spark, folder):
    return synthesised(spark, folder, PHONES, ("supplier",)).select("s_suppkey", ids.phone_display(F.col("raw")).alias("phone"))


_MAIL_KEYS = f"""select s_suppkey, raw, case when regexp_full_match(v, '[a-z0-9._%+-]{{1,64}}@[a-z0-9.-]{{1,253}}\\.[a-z]{{2,10}}') and split_part(v, '.', -1) not in ('png', 'jpg', 'jpeg', 'gif', 'svg', 'webp', 'css', 'js') then v end as email
 from (select s_suppkey, raw, trim(split_part(replace(trim(lower(raw)), 'mailto:', ''), '?', 1), ' .,;:<>()[]') as v from ({_sql(MAILS)}))"""


@query(f"select s_suppkey, email from ({_MAIL_KEYS})")
def email_key(spark, folder):
    return synthesised(spark, folder, MAILS, ("supplier",)).select("s_suppkey", ids.email_key(F.col("raw")).alias("email"))


_SITE = "onlineshop.example.com"


@query(f"""select s_suppkey, case when email is null then null when host = 'shop.example.com' then 'published_contact' when host = '{_SITE}' or host like '%.{_SITE}' then 'corporate' when host = 'cpdp.bg' or host like '%.cpdp.bg' then 'institution'
 when regexp_matches(local, '^(info|office)([._-]?[a-z0-9_]*)$') then 'corporate' when regexp_replace(local, '[^a-z0-9]', '', 'g') like '%onlineshop%' then 'corporate' else 'published_contact' end as kind, substr(sha256(lower(trim(raw))), 1, 16) as hash
 from (select s_suppkey, raw, email, split_part(email, '@', 2) as host, split_part(email, '@', 1) as local from ({_MAIL_KEYS}))""".replace("when host = 'shop.example.com' then 'published_contact' ", ""))
def email_classify(spark, folder):
    return synthesised(spark, folder, MAILS, ("supplier",)).select("s_suppkey", ids.email_kind(F.col("raw"), F.lit(_SITE)).alias("kind"), ids.email_hash(F.col("raw")).alias("hash"))


@query("""select doc_id, email from (select distinct doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'))) as email from documents)""")
def doc_emails(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(web.emails_in(F.col("text"))).alias("email"))


@query("""select page_id, concat(regexp_replace(lower(regexp_extract(u, '^(https?://[^/?]+)', 1)), ':(80|443)$', ''), case when regexp_extract(u, '^[a-zA-Z]+://[^/?]+(.*)$', 1) = '' then '/' else regexp_extract(u, '^[a-zA-Z]+://[^/?]+(.*)$', 1) end) as url, regexp_replace(regexp_extract(lower(u), '^https?://([^/:?#]+)', 1), '^www\\.', '') as host from (select page_id, regexp_replace(url, '#.*$', '') as u from pages)""")
def url_normalise(spark, folder):
    return table(spark, folder, "pages").select("page_id", web.canonical(F.col("url")).alias("url"), web.host_of(F.col("url")).alias("host"))


@query("select page_id, case page_id % 8 when 1 then 'scheme' when 2 then 'whitespace' when 3 then 'credentials' when 4 then 'ip_address' when 5 then 'port' when 6 then 'host_shape' when 7 then 'empty' end as error from pages")
def url_reject_codes(spark, folder):
    return synthesised(spark, folder, URLS, ("pages",)).select("page_id", web.url_error(F.col("url")).alias("error"))


@query("select concat_ws('.', split_part(h, '.', -2), split_part(h, '.', -1)) as domain, count(*) as n from (select regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]+)', 1), '^www\\.', '') as h from pages) group by 1")
def registrable_domain(spark, folder):
    return table(spark, folder, "pages").groupBy(web.registrable(web.host_of(F.col("url"))).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("select page_id, sha256(html) as sha256, length(html) as n from pages")
def page_hash(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.length("html").cast("bigint").alias("n"))


_HEAVY = "<style[^>]*>.*?</style>|<svg[^>]*>.*?</svg>|<noscript[^>]*>.*?</noscript>|<template[^>]*>.*?</template>|<!--.*?-->"


@query(f"""select page_id, length(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|{_HEAVY}', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script[^>]*ld\\+json[^>]*>.*?</script>'), lambda x: length(x))), 0)::bigint as n from pages""")
def page_strip_len(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.length(web.stripped(F.col("html"))).cast("bigint").alias("n"))


@query("""select distinct page_id, link from (select page_id, trim(regexp_replace(unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)), '^["'']|["'']$', '', 'g')) as link from pages) where link <> '' and link[1] <> '#'""")
def page_links(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.explode(web.links(F.col("html"))).alias("link"))


_CLAIM_SOURCE = ("lineitem", "orders")
_JOINED = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
#: Claims that a task counts, and candidates that it ranks.
SORTED = 500_000


def _scored_sql() -> str:
    """The scoring and its levels in SQL, by evidence of each kind."""
    return f"""with c as (select *, operator and not declared and (tier = 3 or own) as op from ({_sql(CLAIMS)})),
    e as (select domain, eik, min(tier) as best_tier, count_if(tier = 3) as documents, count_if(tier = 3 and not archived) as live, count_if(op) as ops, count_if(op and not archived) as live_ops, bool_or(declared) as declared, bool_or(confirmed) as confirmed,
     count_if(tier = 5 and own) as shown, count(distinct host) filter (where tier >= 4 and not own) as public_hosts, count(distinct page) filter (where tier = 3) as pages, count_if(name_ok) as good, count_if(not name_ok) as bad from c group by domain, eik),
    l as (select *, case when documents + ops = 0 and declared then 'high' when documents + ops > 0 and (live + live_ops > 0 or confirmed) then 'high' when documents + ops > 0 then 'medium' when shown > 0 and confirmed then 'medium' when public_hosts >= 2 then 'medium' else 'low' end as plain from e)
    select domain, eik, case when plain = 'high' and good = 0 and bad > 0 then 'medium' else plain end as level, best_tier, ops > 0 as operator, confirmed, case when good > 0 then true when bad > 0 then false end as name_ok, pages, public_hosts from l"""


def _ranked_sql() -> str:
    order = "case level when 'high' then 1 when 'medium' then 2 else 3 end, best_tier, case when operator then 0 else 1 end, case when confirmed then 0 else 1 end, case when name_ok then 0 else 1 end, -pages"
    return f"select *, row_number() over (partition by domain order by {order}, eik) as rn, first_value(eik) over (partition by domain order by {order}, eik) as lead, count(*) over (partition by domain, {order}) as alike from ({_scored_sql()})"


def _scored(spark, folder):
    """Candidates, counted and dealt by domain in tasks of about SORTED claims: there are no more candidates than claims."""
    tasks = tasks_for(table(spark, folder, "lineitem"), SORTED)
    return resolution.score_candidates(synthesised(spark, folder, CLAIMS, _CLAIM_SOURCE, by=_JOINED), tasks)


@query(_scored_sql())
def candidate_scores(spark, folder):
    return _scored(spark, folder)


_FIRST = f"select domain, eik, level, case when alike > 1 then 'ambiguous' when level in ('high', 'medium') then 'identified' end as basis from ({_ranked_sql()}) where rn = 1"


@query(f"select domain, case when basis = 'identified' then eik end as eik, case when basis = 'ambiguous' then 'insufficient' else level end as level, coalesce(basis, 'candidate') as basis from ({_FIRST})")
def resolve_domains(spark, folder):
    return resolution.resolve(_scored(spark, folder))


FOREIGN = "select c_custkey as domain, concat('DE', cast(100000000 + c_custkey as string)) as vat, c_custkey as seq from {customer} where c_custkey % 4 = 0"
NAMED = "select o_custkey as domain, concat(case o_orderkey % 3 when 0 then 'Alpha' when 1 then 'Beta 5' else 'Gamma' end, case o_orderkey % 4 when 0 then ' ООД' when 1 then ' ET' when 2 then '' else ' КАПАЦИТ 7 ЕТ' end) as name, o_orderkey as seq, o_orderkey % 5 = 0 as operator, o_orderkey % 2 = 0 as stated from {orders}"


@query(f"""with f as ({_FIRST}), v as (select domain, vat from ({_sql(FOREIGN)})), n as (select domain, name from (select *, row_number() over (partition by domain order by case when operator then 0 else 1 end, seq) as i from ({_sql(NAMED)}) where (operator or stated) and (name like '% ООД' or name like '% ET')) where i = 1),
 b as (select domain, f.eik, f.level as best, v.vat, n.name, case when f.basis is not null then f.basis when v.vat is not null then 'foreign_vat' when n.name is not null then 'name_only' when f.eik is not null then 'candidate' else 'none' end as basis from f full join v using (domain) full join n using (domain))
 select domain, case when basis = 'identified' then eik end as eik, case basis when 'identified' then best when 'foreign_vat' then 'high' when 'name_only' then 'medium' when 'candidate' then 'low' else 'insufficient' end as level, basis, case when basis = 'foreign_vat' then vat end as vat, case when basis = 'name_only' then name end as name, case when basis = 'candidate' then eik end as candidate from b""")
def resolve_fall_through(spark, folder):
    return resolution.resolve(_scored(spark, folder), synthesised(spark, folder, FOREIGN, ("customer",)), synthesised(spark, folder, NAMED, ("orders",)))


@query(f"select r.domain, r.eik, cast(r.rn as int) as rn from ({_ranked_sql()}) r join ({_FIRST}) f using (domain) where rn <= 5 and (rn > 1 or coalesce(f.basis, '') = 'ambiguous')")
def resolve_alternatives(spark, folder):
    return resolution.alternatives(_scored(spark, folder))


@query(f"with s as ({_scored_sql()}) select domain, 'names' as kind, cast(eik as varchar) as ids from s where not name_ok union all select domain, 'ids', array_to_string(list_sort(list(eik))[1:5], ',') from s group by domain having count(*) > 1")
def resolve_conflicts(spark, folder):
    return resolution.conflicts(_scored(spark, folder))


@query("select kind, count(*) as n, count(tier) as with_tier, count(user_id) as with_user from (select 'order' as kind, 1 as tier, null as user_id from orders union all select 'line', l_linenumber, null from lineitem union all select 'event', null, user_id from events) group by kind")
def evidence_union(spark, folder):
    branches = [table(spark, folder, "orders").select(F.lit("order").alias("kind"), F.lit(1).alias("tier")), table(spark, folder, "lineitem").select(F.lit("line").alias("kind"), F.col("l_linenumber").alias("tier")), table(spark, folder, "events").select(F.lit("event").alias("kind"), "user_id")]
    return resolution.union_claims(branches).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("tier").alias("with_tier"), F.count("user_id").alias("with_user"))


_SCORE_SQL = f"""select shop, cast(least(100, (case when eik is null then 50 else 0 end) + (case when eik is not null and not eik_ok then 40 else 0 end) + (case when address is null then 20 else 0 end) + (case when email is null and phone is null then 20 when email is null or phone is null then 10 else 0 end) + (case when company is null then 10 else 0 end) + (case when n_names > 1 then 10 else 0 end)) as int) as score from ({_sql(MERCHANTS)})"""


@query(f"select shop, score, case when score < 20 then 'ok' when score < 50 then 'suspect' else 'noncompliant' end as verdict from ({_SCORE_SQL})")
def assess_score(spark, folder):
    return profiles.assess(synthesised(spark, folder, MERCHANTS, ("customer",))).drop("findings")


@query(f"""select * from (select 'no_id' as code, count_if(eik is null) as n from m union all select 'bad_id', count_if(eik is not null and not eik_ok) from m union all select 'no_address', count_if(address is null) from m union all select 'no_contact', count_if(email is null and phone is null) from m union all select 'no_email', count_if(email is null and phone is not null) from m union all select 'no_phone', count_if(email is not null and phone is null) from m union all select 'no_company', count_if(company is null) from m union all select 'names_differ', count_if(n_names > 1) from m union all select 'no_vat', count_if(vat is null) from m) where n > 0""".replace("from m", f"from ({_sql(MERCHANTS)}) m"))
def finding_counts(spark, folder):
    return profiles.finding_counts(profiles.assess(synthesised(spark, folder, MERCHANTS, ("customer",))))


@query("select o_custkey, arg_min(prio, o_orderkey) filter (where prio is not null) as prio, arg_min(status, o_orderkey) filter (where status is not null) as status from (select o_custkey, o_orderkey, case when o_orderkey % 3 = 0 then null else o_orderpriority end as prio, case when o_orderkey % 4 <> 0 then null else o_orderstatus end as status from orders) group by o_custkey")
def first_nonnull_merge(spark, folder):
    pages = table(spark, folder, "orders").selectExpr("o_custkey", "o_orderkey", "case when o_orderkey % 3 = 0 then null else o_orderpriority end as prio", "case when o_orderkey % 4 <> 0 then null else o_orderstatus end as status")
    return profiles.first_per_field(pages, "o_custkey", "o_orderkey", ["prio", "status"])


_STATUS_SQL = f"""select domain, field, key as value, n_values, case when n_values > 1 then 'conflicting' when verified then 'verified' when official or voices > 1 then 'corroborated' else 'published' end as status from (select *, count(*) over (partition by domain, field) as n_values, row_number() over (partition by domain, field order by authority, sources desc, key) as rn from (select domain, field, key, min(authority) as authority, count(*) as sources, bool_or(authoritative) as verified, bool_or(official) as official, count(distinct voice) as voices from ({_sql(VALUES)}) group by domain, field, key)) where rn = 1"""


@query(_STATUS_SQL)
def field_profile_exact(spark, folder):
    return profiles.field_status(synthesised(spark, folder, VALUES, _CLAIM_SOURCE, by=_JOINED))


_KEYS = f"select domain, field, key, count(distinct origin) as i, min(authority) as a, count(*) as n, bool_or(authoritative) as v, bool_or(official) as o, count(distinct voice) as w from ({_sql(VALUES)}) group by domain, field, key"
_SHARED = f"select *, origins > 1 and i = origins as shared from ({_KEYS}) join (select domain, field, count(distinct origin) as origins from ({_sql(VALUES)}) group by domain, field) using (domain, field)"


@query(f"""select domain, field, key as value, cast(n_values as bigint) as n_values, case when origins > 1 and not any_shared then 'conflicting' when v then 'verified' when o or w > 1 then 'corroborated' else 'published' end as status
 from (select *, row_number() over (partition by domain, field order by case when shared then 0 else 1 end, a, n desc, key) as place, bool_or(shared) over (partition by domain, field) as any_shared, count(*) over (partition by domain, field) as n_values from ({_SHARED})) where place = 1""")
def field_profile_multi(spark, folder):
    return profiles.shared_value_status(synthesised(spark, folder, VALUES, _CLAIM_SOURCE, by=_JOINED))


@query(f"select field, count_if(status = 'verified') as n_verified, count_if(status = 'corroborated') as n_corroborated, count_if(status = 'published') as n_published, count_if(status = 'conflicting') as n_conflicting, count(*) as n from ({_STATUS_SQL}) group by field")
def profile_summary(spark, folder):
    return profiles.profile_summary(field_profile_exact(spark, folder))


@query("select quality, toxic, count(*) as n, grouping(quality) + grouping(toxic) as level from labels group by rollup (quality, toxic)")
def coverage_rollup(spark, folder):
    return table(spark, folder, "labels").rollup("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), (F.grouping("quality") + F.grouping("toxic")).cast("bigint").alias("level"))


@query("select o_orderkey as key, case when o_orderkey % 5 = 0 then 'explained' else 'unexplained' end as reason from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def gap_log(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    gaps = orders.join(table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")), "key", "left_anti")
    told = table(spark, folder, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("key"), F.lit("explained").alias("reason"))
    return gaps.join(told, "key", "left").select("key", F.coalesce("reason", F.lit("unexplained")).alias("reason"))


@query(f"select domain, coalesce(o.first_seen, n.first_seen) as first_seen, coalesce(n.last_checked, o.last_checked) as last_checked from ({_sql(OLD_DOMAINS)}) o full outer join ({_sql(NEW_DOMAINS)}) n using (domain)")
def upsert_domain(spark, folder):
    return state.upsert_domains(synthesised(spark, folder, OLD_DOMAINS, ("customer",)), synthesised(spark, folder, NEW_DOMAINS, ("customer",)))


@query(f"select eik, coalesce(n.name, o.name) as name, coalesce(n.seat, o.seat) as seat, coalesce(n.status, o.status) as status, concat_ws(',', case when o.name <> n.name then 'name' end, case when o.seat <> n.seat then 'seat' end, case when o.status <> n.status then 'status' end) as changed from ({_sql(OLD_ENTITIES)}) o full outer join ({_sql(NEW_ENTITIES)}) n using (eik)")
def upsert_entity_changes(spark, folder):
    return state.upsert_entities(synthesised(spark, folder, OLD_ENTITIES, ("customer",)), synthesised(spark, folder, NEW_ENTITIES, ("customer",)), ["name", "seat", "status"])


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def orphan_entities(spark, folder):
    return state.orphans(table(spark, folder, "customer").select(F.col("c_custkey").alias("eik")), table(spark, folder, "orders").select(F.col("o_custkey").alias("eik"))).select(F.col("eik").alias("c_custkey"))


@query("select o_custkey, max(o_orderdate) as last from orders group by 1 order by last, o_custkey limit 20")
def stale_topk(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last")).orderBy("last", "o_custkey").limit(20)


@query("select s_name, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def access_report(spark, folder):
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_name", "n_name", "r_name")


@query("""select g.event_id, p.event_id as put_id, p.event_id is not null as hit from (select * from events where event_type <> 'signup') g left join lateral (select event_id, ts from events p where p.event_type = 'signup' and p.user_id = g.user_id and p.ts <= g.ts order by p.ts desc, p.event_id desc limit 1) p on epoch_ms(g.ts) // 1000 - epoch_ms(p.ts) // 1000 < 86400""")
def cache_lookup(spark, folder):
    e = table(spark, folder, "events")
    gets = e.where("event_type <> 'signup'").select("user_id", "ts", "event_id")
    puts = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("put_id"))
    return state.as_of(gets, puts, "user_id", "ts", 86400, ["put_id"]).select("event_id", "put_id", "hit")


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 300 seconds preceding and current row) as n_trailing from events")
def rate_window_count(spark, folder):
    return state.trailing_counts(table(spark, folder, "events"), "user_id", "ts", 300).select("event_id", "n_trailing")


@query(None)
def rate_limit_replay(spark, folder):
    return state.admit(table(spark, folder, "events"), "event_type", "ts", "event_id", 8, 7200)


@query("select event_type, event_id, value from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events where cast(ts as date) = date '2024-01-15') where rn = 1")
def day_log(spark, folder):
    today = table(spark, folder, "events").where(F.to_date("ts") == "2024-01-15").select("event_type", "ts", "event_id", "value")
    return state.latest(today, "event_type", ["ts", "event_id"]).select("event_type", "event_id", "value")


@query("select event_id, row_number() over (partition by cast(ts as date) order by ts, event_id) <= 100 as allowed from events")
def daily_budget(spark, folder):
    return state.daily_budget(table(spark, folder, "events"), "ts", "event_id", 100).select("event_id", "allowed")


@query("select user_id, max(value) as stage, arg_max(event_type, event_id) as last_type, count(*) as n_events from events group by user_id")
def job_state(spark, folder):
    return state.job_state(table(spark, folder, "events"), "user_id", "value", "event_id", "event_id")


@query("select c_custkey, cast(ceil(row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) / 5.0) as int) as page from customer")
def worklist_page(spark, folder):
    order = [F.asc("c_mktsegment"), F.desc("c_acctbal"), F.asc("c_custkey")]
    return state.paged(table(spark, folder, "customer"), order, 5).select("c_custkey", "page")


@query("select distinct concat(case when c_custkey % 2 = 0 then 'www' else 'shop' end, cast(c_nationkey as string), '.example.com') as host from customer")
def ct_hosts(spark, folder):
    raw = table(spark, folder, "customer").selectExpr("concat('*.Example.org\\n', case when c_custkey % 2 = 0 then '*.WWW' else 'shop' end, cast(c_nationkey as string), '.example.com') as names")
    hosts = raw.select(F.explode(F.split(F.lower("names"), "\n")).alias("host")).select(F.regexp_replace("host", r"^\*\.", "").alias("host"))
    return hosts.where(F.col("host").endswith(".example.com")).distinct()



WORDINGS = "select c_nationkey as domain, 'name' as field, concat(c_mktsegment, ' ', case c_custkey % 4 when 0 then 'alpha one' when 1 then 'beta' when 2 then 'ALPHA two' else 'three gamma' end) as value, c_custkey as seq from {customer}"


@query(None)
def field_profile_fuzzy(spark, folder):
    rows = synthesised(spark, folder, WORDINGS, ("customer",))
    grouped = profiles.fuzzy_groups(rows, profiles.words_agree, ["domain", "field"])
    return grouped.groupBy("domain", "field", "leader").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
