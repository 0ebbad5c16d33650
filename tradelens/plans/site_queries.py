"""Queries about pages, links, extraction and captured documents.

Where the operator reads text that SQL can't, the text is made from keys and what is read is held against these keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import agreement, identifiers, markup, web
from ..operators import crawl, hosts
from ..sources import captured
from ..sources.tables import synthesised, table
from .registry import plain, query

#: S: nine digits and their check digit, by the published weights.
_DIGIT = "cast(substr(b, {i}, 1) as int) * {w}"
_SUM = lambda ws: "(" + " + ".join(_DIGIT.format(i=i + 1, w=w) for i, w in enumerate(ws)) + ") % 11"
_CHECK = f"case when {_SUM(identifiers.NINE)} < 10 then {_SUM(identifiers.NINE)} else {_SUM(identifiers.NINE_AGAIN)} % 10 end"


def _with_id(key: str, source: str) -> str:
    """key, eik: an identifier that holds, from a key."""
    return f"select k, concat(b, cast({_CHECK} as string)) as eik from (select {key} as k, lpad(cast({key} * 7919 % 100000000 as string), 8, '0') as b from {source})"


SHOPS = f"select k, eik, concat('Shop', cast(k as string), ' Trade OOD') as company, concat('1000 Sofia, Long street ', cast(k as string)) as address, concat('+359', cast(88000000 + k as string)) as phone, concat('office', cast(k as string), '@shop.example.com') as email from ({_with_id('c_custkey', '{customer}')})"
TRADERS = _with_id("s_suppkey", "{supplier}")

THIRTEEN = f"select o_orderkey, concat(b, cast(case when o_orderkey % 7 = 0 then 0 else {_CHECK} end as string), lpad(cast(o_orderkey % 1000 as string), 3, '0'), cast(o_orderkey % 10 as string)) as raw from (select o_orderkey, lpad(cast(o_orderkey * 7919 % 100000000 as string), 8, '0') as b from {{orders}})"


def _tail_ok(ws, again) -> str:
    part = lambda w: "(" + " + ".join(f"cast(substr(raw, {9 + i}, 1) as int) * {x}" for i, x in enumerate(w)) + ") % 11"
    return f"(case when {part(ws)} < 10 then {part(ws)} else {part(again)} % 10 end) = cast(substr(raw, 13, 1) as int)"


@query(f"select o_orderkey, ({_CHECK}) = cast(substr(b, 9, 1) as int) and {_tail_ok(identifiers.THIRTEEN, identifiers.THIRTEEN_AGAIN)} as valid from (select o_orderkey, raw, raw as b from ({plain(THIRTEEN)}))")
def eik13_validate(spark, folder):
    return synthesised(spark, folder, THIRTEEN, ("orders",)).select("o_orderkey", identifiers.identifier_valid(F.col("raw")).alias("valid"))


@query(f"select k, 'BG' || eik as vat, case when k % 2 = 0 then eik end as told from ({plain(TRADERS)})")
def vat_eik_inference(spark, folder):
    rows = synthesised(spark, folder, TRADERS, ("supplier",)).withColumn("raw", F.concat(F.when(F.col("k") % 2 == 0, "BG").otherwise("DE"), "eik"))
    parts = identifiers.vat_parts(F.col("raw"))
    told = F.when(parts["country"] == "BG", identifiers.identifier_or_null(parts["number"]))
    return rows.select("k", F.concat(F.lit("BG"), identifiers.identifier_or_null(F.col("eik"))).alias("vat"), told.alias("told"))


LINKS = "select l_orderkey as page, l_partkey as link, l_suppkey % 3 as tier, l_partkey % 2 = 0 as text_only, l_linenumber as seq from {lineitem}"


@query(f"select page, link, tier, text_only, seq, cast(place as int) as place from (select *, row_number() over (partition by page order by late, tier, text_only, seq, link) as place from (select *, row_number() over (partition by page, tier order by text_only, seq, link) > case tier when 2 then 1 else 2 end as late from ({plain(LINKS)}))) where place <= 4")
def link_plan(spark, folder):
    return crawl.link_plan(synthesised(spark, folder, LINKS, ("lineitem",)), 4)


#: Every customer links to two others; those short of money are seeds, those of every tenth nation refuse.
_TO = "(c_custkey * {0} + {1}) % (select max(c_custkey) from {{customer}}) + 1"
EDGES = f"select c_custkey as src, {_TO.format(3, 0)} as dst from {{customer}} union all select c_custkey, {_TO.format(7, 1)} from {{customer}}"


@query(f"with g as (select c_custkey as node, c_nationkey % 10 = 3 as refused, c_acctbal < 0 as seed from customer), e as (select distinct src, dst from ({plain(EDGES)}) join g on dst = node where not refused), s as (select node from g where seed and not refused), a as (select dst as node from s join e on node = src), b as (select dst as node from a join e on node = src) select node, cast(min(depth) as int) as depth from (select node, 0 as depth from s union all select node, 1 from a union all select node, 2 from b) group by node")
def frontier_depth2(spark, folder):
    nodes = table(spark, folder, "customer").withColumn("node", F.col("c_custkey"))
    return crawl.frontier(nodes.where("c_acctbal < 0"), synthesised(spark, folder, EDGES, ("customer",)), nodes.where("c_nationkey % 10 = 3"), 2)


_HOST = "regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]+)', 1), '^www\\.', '')"


HOSTS = "select distinct concat('shop', cast(c_nationkey as string), '.example') as domain, concat(case c_custkey % 9 when 0 then 'legal' when 1 then 'old.help' when 2 then 'help' when 3 then 'cdn' when 4 then 'terms' when 5 then 'za-nas' when 6 then 'x.info' when 7 then 'myprivacy' else 'developers' end, '.shop', cast(c_nationkey as string), '.example') as host from {customer}"


@query(f"""select domain, host, cast(place as int) as place from (select domain, host, row_number() over (partition by domain order by coalesce(list_position(['legal', 'help', 'support', 'about', 'company', 'corporate', 'developer', 'developers', 'business', 'info'], split_part(label, '.', -1)), 99), length(label) - length(replace(label, '.', '')), label) as place
 from (select domain, host, replace(host, '.' || domain, '') as label from ({plain(HOSTS)})) where label <> 'cdn') where place <= 12""")
def host_rank(spark, folder):
    return crawl.host_rank(synthesised(spark, folder, HOSTS, ("customer",)))


@query("select page_id, case when page_id % 5 = 0 then 'refused' when page_id % 3 = 0 then 'error' else 'ok' end as state, page_id % 4 = 0 or page_id % 11 = 0 as challenge, page_id % 6 = 0 as shell, page_id % 7 = 0 as private from pages")
def page_state(spark, folder):
    p = table(spark, folder, "pages")
    status = F.when(F.col("page_id") % 5 == 0, 403).when(F.col("page_id") % 3 == 0, 500).otherwise(204)
    ordinary = F.lit('<p>we use a captcha; access denied to bots</p><div id="app"></div><div id="root"></div>')
    html = F.concat(ordinary, F.when(F.col("page_id") % 4 == 0, "<title>Just a MOMENT...</title>").otherwise(""), F.when(F.col("page_id") % 6 == 0, '<script id="__NEXT_DATA__"></script>').otherwise(""), F.col("html"))
    url = F.concat(F.lit("https://shop.example.com/"), F.when(F.col("page_id") % 7 == 0, "Cart?x").otherwise("cartoons"))
    return p.select("page_id", crawl.status_class(status).alias("state"), crawl.is_challenge(html, F.when(F.col("page_id") % 11 == 0, "Challenge")).alias("challenge"), crawl.is_app_shell(html).alias("shell"), crawl.is_private(url).alias("private"))


@query("select page_id, case when page_id % 10 = 0 then false when page_id % 3 = 0 then true when page_id % 3 = 1 then false else page_id % 2 = 0 end as allowed from pages")
def robots_rules(spark, folder):
    urls = table(spark, folder, "pages").selectExpr("page_id", "case when page_id % 10 = 0 then 'shut.example' when page_id % 3 = 2 and page_id % 2 = 0 then 'b.example' else 'a.example' end as host", "concat(case page_id % 3 when 0 then '/x/open/' when 1 then '/x/' else '/x' end, case when page_id % 3 = 2 then '/shut' else '' end, cast(page_id as string)) as path")
    rules = spark.createDataFrame([("a.example", "/x/", False), ("a.example", "/x/open", True), ("a.example", "/x/open/", True), ("a.example", "/", True)], "host string, prefix string, allow boolean")
    answers = spark.createDataFrame([("shut.example", 403), ("a.example", 200), ("b.example", 404)], "host string, status int")
    return crawl.robots_allowed(urls, rules, answers).select("page_id", "allowed")


_PAGE = "<html><head><script>var x = 'ЕИК: 1';</script></head><body><h1>Shop</h1><p>Търговец: {company}</p><div>ЕИК</div><div>{eik}</div><p>ИН по ЗДДС: BG{eik}</p><p>Адрес: {address}</p><p>Тел.: {phone}<br>write to <a href=\"mailto:{email}?subject=x\">us</a>&nbsp;</p></body></html>"


def _filled(template: str, *fields: str):
    """A literal with columns in place of names in braces."""
    out = F.lit(template)
    for f in fields:
        out = F.replace(out, F.lit("{" + f + "}"), F.col(f))
    return out


@query(f"select k, company, eik, 'BG' || eik as vat, address, phone, email from ({plain(SHOPS)})")
def extract_roundtrip(spark, folder):
    shops = synthesised(spark, folder, SHOPS, ("customer",), dealt=True)
    return shops.select("k", markup.six_fields(_filled(_PAGE, "company", "eik", "address", "phone", "email")).alias("f")).select("k", "f.*")


@query(f"select k, phone || ',+3592' || (1000000 + k) as phones, email || ',info@example.org' as emails from ({plain(SHOPS)})")
def contacts_roundtrip(spark, folder):
    shops = synthesised(spark, folder, SHOPS, ("customer",)).withColumn("other", F.concat(F.lit("+359 2 "), (F.col("k") + 1000000).cast("string")))
    html = _filled('<a href="tel:{phone}">call</a><p>or {other}, {other}</p><p>{email} and Info@Example.org</p><img src="x@2x.example.png">', "phone", "other", "email")
    return shops.select("k", F.array_join(markup.phones(html), ",").alias("phones"), F.array_join(markup.emails(html), ",").alias("emails"))


@query(f"select k, unnest(['Alpha Trade OOD', 'Beta Post EOOD']) as name, unnest([eik, null]) as eik, unnest([true, false]) as operator from ({plain(TRADERS)})")
def mentions_roundtrip(spark, folder):
    text = _filled("this shop is operated by Alpha Trade OOD, EIK {eik}, and parcels go by Beta Post EOOD.", "eik")
    rows = synthesised(spark, folder, TRADERS, ("supplier",)).select("k", F.explode(markup.mentions(text)).alias("m"))
    return rows.select("k", "m.*")


@query("select s_suppkey as k, unnest(['Anna Petrova', 'Ivan Ivanov Petrov']) as name, unnest(['manager', 'управител']) as role from supplier")
def people_roundtrip(spark, folder):
    text = F.concat(F.lit("Manager: Anna Petrova, Управител Ivan Ivanov Petrov; manager: Anna Petrova. Shop "), F.col("s_suppkey").cast("string"))
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(markup.people(text)).alias("p")).select("k", "p.*")


@query(f"select k, 'Trader ' || k as name, eik as tax_id from ({plain(TRADERS)})")
def jsonld_roundtrip(spark, folder):
    rows = synthesised(spark, folder, TRADERS, ("supplier",)).withColumn("n", F.col("k").cast("string"))
    graph = '{"@graph": [{"@type": "WebSite", "name": "no"}, {"@type": "Organization", "name": "Trader {n}", "taxID": "{eik}"}]}'
    own = '{"@type": "Store", "legalName": "Trader {n}", "taxID": "{eik}"}'
    block = '<script type="application/ld+json">%s</script><script type="application/ld+json">{broken</script>'
    html = F.when(F.col("k") % 3 == 0, _filled(block % graph, "n", "eik")).when(F.col("k") % 3 == 1, _filled(block % own, "n", "eik")).otherwise(_filled(block % f"[{own}]", "n", "eik"))
    return rows.select("k", F.explode(markup.structured(html)).alias("o")).select("k", "o.name", "o.tax_id")


_DEED = """<m:Message xmlns:m="urn:m" xmlns:d="urn:d" xmlns:f="urn:f"><m:Body><d:Deed UIC="{eik}" CompanyName="Firm {n}" LegalForm="OOD" DeedStatus="{status}"><d:SubDeed><f:Seat FieldOperation="{op}"><f:Address><f:Country>Bulgaria</f:Country>
<f:Settlement>Sofia</f:Settlement><f:PostCode></f:PostCode><f:Street>Long</f:Street><f:StreetNumber>{n}</f:StreetNumber><f:Floor>3</f:Floor></f:Address><f:Contacts><f:URL>https://firm{n}.example</f:URL></f:Contacts></f:Seat><f:Funds currency="BGN"> 5000 </f:Funds>
<f:Managers><f:Manager><f:Person Position="manager"><f:Indent>0000000000</f:Indent><f:Name> Anna Petrova </f:Name></f:Person></f:Manager><f:Manager FieldOperation="Erase"><f:Person><f:Name>Gone Person</f:Name></f:Person></f:Manager><f:Procurator><f:Person><f:Name>Ivan Ivanov</f:Name></f:Person></f:Procurator></f:Managers></d:SubDeed></d:Deed></m:Body></m:Message>"""


@query(f"select eik, 'Firm ' || k as name, 'OOD' as legal_form, case k % 4 when 0 then 'closed' when 1 then 'registered' when 2 then 'unknown' else 'registered' end as status, case when k % 5 <> 0 then 'Sofia, Long, ' || k || ', 3' end as address, case when k % 5 <> 0 then 'https://firm' || k || '.example' end as website, '5000 BGN' as capital, 'Anna Petrova:manager,Ivan Ivanov:Procurator' as people from ({plain(TRADERS)})")
def deed_roundtrip(spark, folder):
    rows = synthesised(spark, folder, TRADERS, ("supplier",)).withColumn("n", F.col("k").cast("string")).withColumn("op", F.when(F.col("k") % 5 == 0, "Erase").otherwise("Current"))
    rows = rows.withColumn("status", F.element_at(F.array(*map(F.lit, ("C", "N", "X", "E"))), (F.col("k") % 4 + 1).cast("int")))
    out = captured.deeds(rows.select(_filled(_DEED, "eik", "n", "op", "status").alias("body")))
    people = F.array_join(F.transform("people", lambda p: F.concat_ws(":", p["name"], p["role"])), ",")
    return out.select("eik", "name", "legal_form", "status", "address", "website", "capital", people.alias("people"))


NAMES = "select s_suppkey as k, s_nationkey as n, concat(case s_suppkey % 4 when 0 then 'Alpha' when 1 then 'ALPHA Star' when 2 then 'Beta' else 'Gamma Delta' end, case s_suppkey % 3 when 0 then ' OOD' when 1 then ' EOOD' else '' end) as name from {supplier}"
_OTHER = "case k % 5 when 0 then 'Alpha Ltd' when 1 then 'alphastar ood' when 2 then 'beta gamma' when 3 then 'OOD' else 'Delta Gamma' end"
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda w: length(w) > 2 and w not in ('ood', 'eood', 'ltd'))"
_GLUED = "array_to_string(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: w not in ('ood', 'eood', 'ltd')), '')"


@query(f"select k, case when gx = gy and gx <> '' then true when least(len(x), len(y)) > 0 then len(list_intersect(x, y)) >= greatest(1, least(len(x), len(y)) // 2) end as agree, len(x) > 0 and len(y) > 0 and (len(list_intersect(x, y)) = len(x) or len(list_intersect(x, y)) = len(y)) as same from (select k, {_WORDS.format('name')} as x, {_WORDS.format('o')} as y, {_GLUED.format('name')} as gx, {_GLUED.format('o')} as gy from (select *, {_OTHER} as o from ({plain(NAMES)})))")
def name_agreement(spark, folder):
    rows = synthesised(spark, folder, NAMES, ("supplier",)).withColumn("o", F.expr(_OTHER))
    return rows.select("k", agreement.names_agree(F.col("name"), F.col("o")).alias("agree"), agreement.same_company(F.col("name"), F.col("o")).alias("same"))


@query("select s_suppkey as k, case s_suppkey % 4 when 0 then true when 1 then true when 2 then false end as agree from supplier")
def address_agreement(spark, folder):
    own = F.lit("1000 гр. София, бул. Витоша 12, ет. 3")
    k = F.col("s_suppkey")
    other = F.when(k % 4 == 0, "София, Витоша 12").when(k % 4 == 1, "SOFIA софия витоша 12 3 вход").when(k % 4 == 2, "Пловдив, ул. Витоша 7").otherwise("1000, ет.")
    return table(spark, folder, "supplier").select(k.alias("k"), agreement.addresses_agree(own, other).alias("agree"))


@query(f"select a.k as k, b.k as other from ({plain(NAMES)}) a join ({plain(NAMES)}) b on a.n = b.n and a.k <> b.k and {_GLUED.format('a.name')} = {_GLUED.format('b.name')}")
def same_name_other_id(spark, folder):
    rows = synthesised(spark, folder, NAMES, ("supplier",)).withColumn("g", agreement.glued(F.col("name")))
    return rows.select("n", "g", "k").join(rows.select("n", "g", F.col("k").alias("other")), ["n", "g"]).where("k <> other").select("k", "other")


@query(f"select n, count(distinct lower(name)) as n_names, arg_min(name, k) as name from ({plain(NAMES)}) group by n having count(distinct lower(name)) > 1")
def name_inconsistent(spark, folder):
    rows = synthesised(spark, folder, NAMES, ("supplier",))
    return rows.groupBy("n").agg(F.count_distinct(agreement.wording_key(F.col("name"))).alias("n_names"), F.min_by("name", "k").alias("name")).where("n_names > 1")


_SUFFIXES = "select * from values ('com', 'rule'), ('uk', 'rule'), ('co.uk', 'rule'), ('ck', 'wildcard'), ('www.ck', 'exception') as r(suffix, kind)"
_HOSTS = "select c_custkey as k, case c_custkey % 7 when 0 then 'a.b.example.com' when 1 then 'x.shop.co.uk' when 2 then 'co.uk' when 3 then 'a.b.co.ck' when 4 then 'www.ck' when 5 then 'b.c.test' else 'u.www.ck' end as host from {customer}"


@query(f"select k, host, case k % 7 when 0 then 'example.com' when 1 then 'shop.co.uk' when 3 then 'b.co.ck' when 4 then 'www.ck' when 5 then 'c.test' when 6 then 'www.ck' end as domain from ({plain(_HOSTS)})")
def suffix_rules(spark, folder):
    return hosts.registrable_domains(synthesised(spark, folder, _HOSTS, ("customer",)), spark.sql(_SUFFIXES))


_ANSWERS = "select c_nationkey as host, case c_custkey % 3 when 0 then 'A' when 1 then 'MX' else 'TXT' end as type, concat('10.0.0.', cast(c_custkey % 20 as string)) as data, c_custkey as seq from {customer}"


@query(f"select host, type, array_to_string(list_sort(list(distinct data))[1:10], ',') as \"values\" from ({plain(_ANSWERS)}) group by host, type")
def dns_records(spark, folder):
    return hosts.dns_table(synthesised(spark, folder, _ANSWERS, ("customer",)))


_NAMES = "select cast(floor(c_custkey / 4) as int) as host, case when cast(floor(c_custkey / 4) as int) % 5 = 0 and c_custkey % 4 > 1 then 'CNAME' when cast(floor(c_custkey / 4) as int) % 7 = 0 then 'TXT' else 'A' end as type, concat('h', cast(c_custkey % 11 as string)) as data, c_custkey as seq from {customer}"


@query(f"select domain, host, fingerprint from (select host % 10 as domain, host, coalesce(arg_min(data, seq) filter (where type = 'CNAME'), array_to_string(list_sort(list(distinct data) filter (where type = 'A')), ',')) as fingerprint from ({plain(_NAMES)}) group by host) where fingerprint <> '' and fingerprint is distinct from case when domain = 5 then 'h3' end")
def real_hosts(spark, folder):
    seen = hosts.fingerprints(synthesised(spark, folder, _NAMES, ("customer",))).withColumn("domain", F.col("host") % 10)
    probes = spark.sql("select 5L as domain, 'h3' as fingerprint")
    return hosts.real_hosts(seen, probes).select("domain", "host", "fingerprint")


_RDAP = """{"events":[{"eventAction":"registration","eventDate":"2020-01-02T03:04:05Z"}{ends}],"status":["active"],"nameservers":[{"ldhName":"ns{k}.example"},{"ldhName":"ns.example"}],
"entities":[{"roles":["abuse"],"vcardArray":["vcard",[["fn",{},"text","Abuse Desk"]]]},{"roles":["technical","registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"]{name},["adr",{"label":"x"},"text",["","","Long street","Sofia"]]]]},{"roles":["registrant"]}]}"""


@query("""select s_suppkey as domain, case when s_suppkey % 5 = 0 then 'not_found' when s_suppkey % 5 = 1 then 'unavailable' else 'ok' end as state, case when s_suppkey % 5 > 1 and s_suppkey % 3 > 0 then 'Registrar ' || s_suppkey end as registrar,
 case when s_suppkey % 5 > 1 then timestamp '2020-01-02 03:04:05' end as registered, case when s_suppkey % 5 > 1 and s_suppkey % 2 = 0 then timestamp '2030-01-01 00:00:00' end as expires, case when s_suppkey % 5 > 1 then 'ns' || s_suppkey || '.example,ns.example' end as name_servers from supplier""")
def registration_dates(spark, folder):
    k = F.col("s_suppkey")
    body = F.replace(F.lit(_RDAP), F.lit("{k}"), k.cast("string"))
    body = F.replace(body, F.lit("{ends}"), F.when(k % 2 == 0, ',{"eventAction":"expiration","eventDate":"2030-01-01T00:00:00Z"}').otherwise(""))
    body = F.replace(body, F.lit("{name}"), F.when(k % 3 > 0, F.concat(F.lit(',["fn",{},"text","Registrar '), k.cast("string"), F.lit('"]'))).otherwise(""))
    status = F.when(k % 5 == 0, 404).when(k % 5 == 1, F.when(k % 2 == 0, 200).otherwise(503)).otherwise(200)
    answers = table(spark, folder, "supplier").select(k.alias("domain"), status.alias("status"), F.when((k % 5 == 1) & (k % 2 == 0), "<html>").otherwise(body).alias("body"))
    out = hosts.registration(answers)
    return out.select("domain", "state", "registrar", F.col("registered").cast("timestamp_ntz").alias("registered"), F.col("expires").cast("timestamp_ntz").alias("expires"), F.array_join("name_servers", ",").alias("name_servers"))


_SNAPSHOTS = "select o_custkey as url, date_format(o_orderdate, 'yyyyMMdd000000') as stamp, case when o_orderkey % 4 = 0 then 404 else 200 end as status, 'body' as body from {orders}"


@query("select c_custkey as url, max(strftime(o_orderdate, '%Y%m%d000000')) as stamp from customer left join orders on o_custkey = c_custkey and o_orderkey % 4 <> 0 and o_orderdate < timestamp '1996-01-02 00:00:00' group by 1")
def archive_lookup(spark, folder):
    wanted = table(spark, folder, "customer").select(F.col("c_custkey").alias("url"), F.expr("timestamp '1996-01-01 00:00:00'").alias("at"))
    return hosts.archived_copy(wanted, synthesised(spark, folder, _SNAPSHOTS, ("orders",))).select("url", "stamp")


@query("select s_suppkey as k, 'https://xn--e1afmkfd.example/' || case when s_suppkey % 2 = 0 then '%D0%B6' else 'a%20b' end || '?q=' || s_suppkey as url from supplier")
def ascii_urls(spark, folder):
    k = F.col("s_suppkey")
    raw = F.concat(F.lit("https://пример.example/"), F.when(k % 2 == 0, "ж").otherwise("a b"), F.lit("?q="), k.cast("string"))
    return table(spark, folder, "supplier").select(k.alias("k"), web.ascii_url(raw).alias("url"))


@query("select s_suppkey as k, 'Alpha Trade OOD' as name, 'гр. София, ул. Дълга 5, Bulgaria' as address from supplier")
def displayed(spark, folder):
    k = F.col("s_suppkey")
    name = F.when(k % 2 == 0, '"Alpha Trade" - OOD').otherwise("„Alpha  Trade“ OOD")
    address = F.when(k % 2 == 0, "гр.СОФИЯ,ул.Дълга 5 ,BULGARIA").otherwise("гр. София, ул. Дълга 5, Bulgaria")
    return table(spark, folder, "supplier").select(k.alias("k"), agreement.display_name(name).alias("name"), agreement.display_address(address).alias("address"))
