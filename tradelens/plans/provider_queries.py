"""Queries about providers' captured answers, made from keys of whole tables in every state that an answer can have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import providers
from ..sources.tables import synthesised
from .registry import plain, query

QUERIES_ = "select concat('shop', cast(o_custkey as string), '.example') as domain, o_orderkey as place, concat('q', cast(o_orderkey as string)) as query, o_custkey as k from {orders}"
#: status and hits of the answer to each query: one of 401, one of 503, one that isn't JSON, else key mod 13 hits.
_STATUS = "case when o_orderkey % 29 = 0 then 401 when o_orderkey % 5 = 0 then 503 else 200 end"
_BROKEN, _N = "(o_orderkey % 7 = 0)", "cast(case when o_custkey % 4 = 0 then 0 else o_orderkey % 13 end as int)"
_ASKED = f"select 'shop' || o_custkey || '.example' as domain, o_orderkey as place, {_STATUS} as status, {_STATUS} = 200 and not {_BROKEN} as good, least({_N}, 10) as n from orders"


@query(f"""select domain, 'second' as provider, case when cut is not null then 'failed' when bad > 0 and n = 0 then 'unavailable' when n > 0 then 'found' else 'not_found' end as state, cast(n as int) as n, case when n > 0 then 'https://r.example/' || first_place || '/1 no 1: a plain excerpt' end as first, e as errors from (select domain, max(cut) as cut, count(*) filter (where not good) as bad, coalesce(sum(n) filter (where good), 0) as n, min(place) filter (where good and n > 0) as first_place,
 coalesce(array_to_string(list(case when status = 200 then 'not an answer' else 'HTTP ' || status end order by place) filter (where not good)[1:3], ','), '') as e from (select *, min(place) filter (where status = 401) over (partition by domain) as cut from ({_ASKED})) where cut is null or place <= cut group by domain)""")
def search_fanout(spark, folder):
    asked = synthesised(spark, folder, QUERIES_, ("orders",))
    one = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.concat(F.lit('{"url":"https://r.example/'), F.col("place").cast("string"), F.lit("/"), i.cast("string"), F.lit('","title":"no '), i.cast("string"), F.lit('","description":"a <b>plain</b> excerpt"}')))
    body = F.concat(F.lit('{"web":{"results":['), F.array_join(F.slice(one, 1, F.expr(_N.replace("o_custkey", "k").replace("o_orderkey", "place"))), ","), F.lit("]}}"))
    status = F.expr(_STATUS.replace("o_orderkey", "place"))
    answers = asked.select(F.lit("second").alias("provider"), "query", status.alias("status"), F.when(F.expr(_BROKEN.replace("o_orderkey", "place")), "<html>").otherwise(body).alias("body"))
    other = answers.withColumns({"provider": F.lit("third"), "status": F.lit(401)})
    out = providers.run_search(asked.select("domain", "place", "query"), answers.unionByName(other), [("first", False), ("second", True), ("third", True)])
    first = F.get("hits", F.lit(0))
    return out.select("domain", "provider", "state", F.size("hits").alias("n"), F.concat(first["url"], F.lit(" "), first["title"], F.lit(": "), first["snippet"]).alias("first"), F.array_join("errors", ",").alias("errors"))


#: k: a domain. Declared by its address in capitals; by its name at the second attempt, beside a longer host that only holds
#: it; on a platform alone; at the second pass alone; never, by both passes; never, by one pass; behind errors; by seven owners.
SHOPS = "select c_custkey as k, c_custkey % 8 as shape, concat('shop', cast(c_custkey as string), '.example') as domain from {customer}"


@query(f"select 'shop' || k || '.example' as domain, case when shape in (0, 1, 3, 7) then 'found' when shape in (2, 4) then 'not_found' else 'unavailable' end as state, case when shape in (0, 1, 3) then (100000000 + k)::varchar when shape = 7 then array_to_string([((100000000 + k) * 10 + i)::varchar for i in range(5)], ',') else '' end as eiks, case when shape in (0, 1, 3, 7) then 'Чунче & син ' || k end as name from ({plain(SHOPS)})".replace("(100000000 + k) * 10 + i", "100000000 + k + i"))
def declared_shops(spark, folder):
    rows = synthesised(spark, folder, SHOPS, ("customer",)).withColumn("attempt", F.explode(F.array(*map(F.lit, range(4)))))
    k, shape, attempt = F.col("k").cast("string"), F.col("shape"), F.col("attempt")

    def entry(host, i=0, platform="null"):
        eik = (F.lit(100000000) + F.col("k") + i).cast("string")
        return F.concat(F.lit('{"SHOPNAME":"Shop '), k, F.lit('","DOMAIN":"'), host, F.lit(f'","PLATFORM_DOMAIN":{platform},"OWNER_INFO":"Наименование: Чунче &amp; син '), k, F.lit("<br/>ЕИК: "), eik, F.lit('","REGDATE":"01.02.2024"}'))

    capitals, longer = F.concat(F.lit("HTTPS://WWW.SHOP"), k, F.lit(".EXAMPLE/x")), F.concat(F.lit("my"), "domain")
    seven = F.concat_ws(",", *(entry(F.concat(F.lit(f"s{i}."), "domain"), i) for i in range(7)))
    data = (
        F.when((shape == 0) & (attempt == 0), entry(capitals))
        .when((shape == 1) & (attempt == 0), entry(longer, 5))
        .when((shape == 1) & (attempt == 1), F.concat_ws(",", entry(longer, 5), entry(F.col("domain"))))
        .when(shape == 2, entry(F.col("domain"), 0, '"market.example"'))
        .when((shape == 3) & (attempt == 3), entry(F.col("domain")))
        .when((shape == 7) & (attempt == 1), seven)
        .otherwise("")
    )
    status = F.when((shape == 6) | ((shape == 3) & (attempt == 0)), 503).otherwise(200)
    answers = rows.where("shape <> 5 or attempt < 2").select("domain", "attempt", status.alias("status"), F.concat(F.lit('{"data":['), data, F.lit("]}")).alias("body"))
    out = providers.declared_shops(rows.select("domain").distinct(), answers)
    return out.select("domain", "state", F.array_join("entries.eik", ",").alias("eiks"), F.get("entries.name", F.lit(0)).alias("name"))
