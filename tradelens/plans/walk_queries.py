"""Queries that walk captured pages. Each customer is a domain of 24 pages on two hosts, whose links, refusals and named
companies follow from keys; SQL walks the same pages by recursion over one row a domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery
from ..sources.tables import synthesised
from .registry import plain, query

_ADDRESS = "concat('https://', case when {j} % 5 = 0 then 'help.' when {j} % 7 = 3 then 'www.' else '' end, 'shop', cast(k as string), '.example', case when {j} = 1 then '/' else concat('/p', cast({j} as string)) end)"
_AT = lambda j: _ADDRESS.format(j=f"({j})")

#: k, j and what was captured of page j of domain k.
PAGES = f"select k, cast(j as int) as j, {_AT('j')} as url, case when (k * 7 + j * 3) % 9 = 0 then 'refused' when (k + j) % 13 = 0 then 'error' else 'ok' end as state, (k * 3 + j * 5) % 37 = 0 as named from (select c_custkey as k, explode(sequence(0, 23)) as j from {{customer}})"
LINKS = f"select k, j, cast(n as int) as seq, {_AT('(j * (n + 2) + n * n + k) % 24')} as url, (j + n + k) % 4 as tier from (select *, explode(sequence(0, 4)) as n from ({PAGES}))"
SEEDS = f"select concat('shop', cast(k as string), '.example') as domain, {_AT('j')} as url, j as seq from ({PAGES}) where j < 3"
_VALUES = lambda sql: plain(sql).replace("as string", "as varchar").replace("explode(sequence(0, 23))", "unnest(range(24))").replace("explode(sequence(0, 4))", "unnest(range(5))")

_PER_PAGE = f"""p as materialized (select k, url, any_value(state) as state, any_value(named) as named, list({{'tier': cast(tier as int), 'url': link}} order by seq) as links
 from (select a.k, a.j, a.url, a.state, a.named, b.seq, b.tier, b.url as link from ({_VALUES(PAGES)}) a join ({_VALUES(LINKS)}) b on a.k = b.k and a.j = b.j) group by k, url)"""
_ENTRIES = "list_transform({0}, lambda x, i: {{'tier': cast(x.tier as int), 'at': cast({1} + i - 1 as int), 'depth': cast({2} as int), 'url': x.url, 'host': regexp_extract(lower(x.url), '^https?://([^/:?#]+)', 1)}})"
_AFTER = "coalesce(list_max(list_transform(queue, lambda q: q.at)), 0) + 1"


def _of_keys(spark, folder, sql):
    return synthesised(spark, folder, sql, ("customer",), dealt=True)


def _page_tables(spark, folder):
    """Pages with their links; an address stands once a domain."""
    pages, links = _of_keys(spark, folder, PAGES), _of_keys(spark, folder, f"select *, {_AT('j')} as page from ({LINKS})")
    return discovery.with_links(pages.select("url", "state", "named"), links.select("page", "url", "tier", "seq"))


CRAWL = f"""with recursive {_PER_PAGE},
seeds as (select domain, list({{'tier': -1, 'url': url}} order by seq) as l from ({_VALUES(SEEDS)}) group by domain),
s as (select domain, {_ENTRIES.format('l', '0', '0')} as queue, cast([] as varchar[]) as refused, cast([] as varchar[]) as seen, 0 as n, false as done, cast([] as struct(url varchar, depth int, state varchar)[]) as log from seeds
union all
select domain, list_concat(list_filter(queue, lambda q: q.at <> nxt.at), case when ok and not stop and nxt.depth < 2 then {_ENTRIES.format('links', _AFTER, 'nxt.depth + 1')} else [] end),
 case when nxt is not null and state = 'refused' then list_append(refused, nxt.host) else refused end, case when nxt is not null then list_append(seen, nxt.url) else seen end,
 n + (nxt is not null)::int, nxt is null or (ok and stop) or n + 1 >= 14, case when nxt is not null then list_append(log, {{'url': nxt.url, 'depth': nxt.depth, 'state': state}}) else log end
 from (select o.*, coalesce(p.state, 'error') as state, nxt is not null and coalesce(p.state, 'error') = 'ok' as ok, coalesce(p.named, false) as stop, p.links
  from (select *, list_sort(queue)[1] as nxt from (select domain, list_filter(queue, lambda q: not list_contains(seen, q.url) and not list_contains(refused, q.host)) as queue, refused, seen, n, log from s where not done)) o left join p on p.url = nxt.url))
select domain, cast(nth as int) as nth, f.url as url, f.depth as depth, f.state as state from (select domain, unnest(log) as f, generate_subscripts(log, 1) as nth from s where done)"""


@query(CRAWL)
def legal_crawl(spark, folder):
    return discovery.legal_crawl(_of_keys(spark, folder, SEEDS), _page_tables(spark, folder))


#: The archive holds some pages, some of them under the twin address or below /bg alone.
COPIES = f"select url, '20250101000000' as stamp, named from ({PAGES}) where (k + j) % 3 = 0 and j <> 1 union all select concat('https://www.shop', cast(k as string), '.example/p', cast(j as string)), '20240101000000', named from ({PAGES}) where (k + j) % 3 = 1 and j % 5 <> 0 and j % 7 <> 3 and j <> 1 union all select concat('https://', case when k % 2 = 0 then 'www.' else '' end, 'shop', cast(k as string), '.example/bg'), '20230101000000', false from ({PAGES}) where j = 1 and k % 3 > 0"
STARTS = f"select concat('shop', cast(k as string), '.example') as domain, {_AT('j')} as url, j as seq from ({PAGES}) where j in (1, 5)"
REFUSED = "select concat('shop', cast(c_custkey as string), '.example') as domain, concat('shop', cast(c_custkey as string), '.example') as host from {customer} union all select concat('shop', cast(c_custkey as string), '.example'), concat('help.shop', cast(c_custkey as string), '.example') from {customer} where c_custkey % 2 = 0"

_TWIN = "case when regexp_extract(lower({0}), '^https?://([^/:?#]+)', 1) = domain then replace({0}, '://', '://www.') when regexp_extract(lower({0}), '^https?://([^/:?#]+)', 1) = 'www.' || domain then replace({0}, '://www.', '://') end"
ARCHIVE = f"""with recursive {_PER_PAGE},
c as materialized (select a.url, a.stamp, a.named, coalesce(b.links, []) as links from (select url, any_value(stamp) as stamp, any_value(named) as named from ({_VALUES(COPIES)}) group by url) a left join p b on b.url = regexp_replace(regexp_replace(a.url, 'example/bg$', 'example/'), '://www\\.(.*)$', case when exists (select 1 from p where p.url = a.url) then '://www.\\1' else '://\\1' end)),
starts as (select domain, list({{'tier': -1, 'url': url}} order by seq) as l from ({_VALUES(STARTS)}) group by domain),
r as (select domain, list(host) as refused from ({_VALUES(REFUSED)}) group by domain),
s as (select domain, {_ENTRIES.format('l', '0', '0')} as queue, refused, cast([] as varchar[]) as seen, 0 as docs, 0 as lookups, false as named, cast([] as struct(url varchar, via varchar, stamp varchar, depth int)[]) as reads, false as done from starts join r using (domain)
union all
select domain, list_concat(list_filter(queue, lambda q: q.at <> nxt.at), case when nxt.depth < 2 then {_ENTRIES.format('list_filter(got, lambda x: x.tier <= 1)', _AFTER, 'nxt.depth + 1')} else [] end),
 case when live = 'refused' then list_append(refused, nxt.host) else refused end, case when nxt.tier >= 0 then list_append(seen, nxt.url) else seen end,
 docs + (hit is not null)::int, lookups + coalesce(hit, len(tries)), named or coalesce(case when hit is not null then c_named when live = 'ok' then p_named end, false),
 case when hit is not null or coalesce(live = 'ok', false) then list_append(reads, {{'url': nxt.url, 'via': case when hit is not null then 'archive' else 'live' end, 'stamp': stamp, 'depth': nxt.depth}}) else reads end, nxt is null
 from (select t.*, c.stamp, c.named as c_named, case when hit is not null then c.links when live = 'ok' then p_links else [] end as got
  from (select *, list_position(list_transform(tries, lambda u: list_contains(held, u)), true) as hit0, case when hit0 > 0 then hit0 end as hit from
   (select u.*, coalesce((select list(c.url) from c where list_contains(u.tries, c.url)), []) as held from
    (select v.*, case when nxt is not null and v.lookups < 10 and (nxt.tier = -1 or list_contains(refused, nxt.host) or live = 'refused') then list_filter([nxt.url, {_TWIN.format('nxt.url')}, case when nxt.tier = -1 and root then bg end, case when nxt.tier = -1 and root then {_TWIN.format('bg')} end], lambda x: x is not null)[1:10 - v.lookups] else [] end as tries from
     (select o.*, p.named as p_named, p.links as p_links, case when nxt.tier >= 0 and not list_contains(refused, nxt.host) then coalesce(p.state, 'error') end as live, regexp_matches(nxt.url, '^https?://[^/?#]+/?$') as root, rtrim(nxt.url, '/') || '/bg' as bg from
      (select * replace (case when named or docs >= 6 or (nxt.tier >= 0 and lookups >= 10) then null else nxt end as nxt) from (select *, list_sort(queue)[1] as nxt from (select domain, list_filter(queue, lambda q: q.tier = -1 or not list_contains(seen, q.url)) as queue, refused, seen, docs, lookups, named, reads from s where not done))) o
      left join p on p.url = nxt.url) v) u)) t left join c on c.url = tries[hit]))
select domain, docs, lookups, named, cast(len(reads) as int) as n_reads, coalesce(array_to_string(list_transform(reads, lambda r: concat_ws(' ', r.via, r.depth, r.url, r.stamp)), ','), '') as reads from s where done"""


@query(ARCHIVE)
def archive_fallback(spark, folder):
    pages = _page_tables(spark, folder)
    copies = _of_keys(spark, folder, COPIES).dropDuplicates(["url"])
    # A copy under another address links as the page that it is a copy of.
    known = pages.select("url").withColumn("same", F.lit(True)).hint("merge")
    bare = F.regexp_replace("url", "example/bg$", "example/")
    copies = copies.withColumn("key", bare).join(known.select(F.col("url").alias("copy_url"), "same"), F.col("url") == F.col("copy_url"), "left")
    key = F.when(F.col("same"), F.col("key")).otherwise(F.regexp_replace("key", r"://www\.", "://"))
    copies = copies.withColumn("key", key).join(pages.select(F.col("url").alias("key"), "links").hint("merge"), "key", "left").select("url", "stamp", "named", F.coalesce("links", F.array().cast("array<struct<tier: int, url: string>>")).alias("links"))
    out = discovery.archive_fallback(_of_keys(spark, folder, STARTS), pages, copies, _of_keys(spark, folder, REFUSED))
    told = F.transform("reads", lambda r: F.concat_ws(" ", r["via"], r["depth"].cast("string"), r["url"], r["stamp"]))
    return out.select("domain", "docs", "lookups", "named", F.size("reads").alias("n_reads"), F.array_join(told, ",").alias("reads"))


_CONTACTS = _VALUES(LINKS)


@query(f"""with d as (select 'shop' || c_custkey || '.example' as domain, c_custkey % 3 = 0 as blocked from customer), v as (select 'shop' || k || '.example' as domain, url from ({_VALUES(PAGES)}) where j < 4),
l as (select distinct domain, url from (select 'shop' || k || '.example' as domain, url from ({_CONTACTS}) where tier = 1 union all select domain, 'https://' || domain || p from d, unnest(['/contact', '/kontakti']) as u(p) where not blocked)) ,
r as (select l.domain, l.url, regexp_extract(l.url, '^https://([^/]+)', 1) as host from l where not exists (select 1 from v where v.domain = l.domain and v.url = l.url)),
b as (select r.*, exists (select 1 from ({_VALUES(REFUSED)}) x where x.domain = r.domain and x.host = r.host) as barred, host not in (domain, 'www.' || domain) as away from r),
n as (select *, row_number() over (partition by domain, barred order by away, length(url), url) as own from b)
select domain, cast(row_number() over (partition by domain order by away, length(url), url) as int) as nth, url, case when barred then 'archive' else 'live' end as via from n where own <= case when barred then 2 else 3 end""")
def contact_plan(spark, folder):
    domain = F.concat(F.lit("shop"), F.col("k").cast("string"), F.lit(".example"))
    links = _of_keys(spark, folder, LINKS).where("tier = 1").select(domain.alias("domain"), "url")
    visited = _of_keys(spark, folder, PAGES).where("j < 4").select(domain.alias("domain"), "url")
    domains = synthesised(spark, folder, "select concat('shop', cast(c_custkey as string), '.example') as domain, c_custkey % 3 = 0 as blocked from {customer}", ("customer",)).withColumn("host", F.col("domain"))
    return discovery.contact_plan(domains, links, _of_keys(spark, folder, REFUSED), visited)
