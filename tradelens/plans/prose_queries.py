"""Queries about what a page's prose says of companies and addresses. Pages are made from keys of whole tables in several
shapes; SQL tells what each shape says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as reader
from ..functions.identifiers import NINE, NINE_AGAIN
from ..operators import lines, parties, structured, verbs
from ..sources.tables import synthesised
from .registry import plain, query

_SUM = lambda ws: "(" + " + ".join(f"cast(substr(b, {i + 1}, 1) as int) * {w}" for i, w in enumerate(ws)) + ") % 11"
_CHECK = f"case when {_SUM(NINE)} < 10 then {_SUM(NINE)} else {_SUM(NINE_AGAIN)} % 10 end"
_WITH_ID = lambda key, name: f"select k as {name}_k, concat(b, cast({_CHECK} as string)) as {name} from (select k, lpad(cast({key} * 7919 % 100000000 as string), 8, '0') as b from (select s_suppkey as k from {{supplier}}))"

#: k, shape, x and y: each supplier with two identifiers that hold and one of seven shapes of prose.
TWO = f"select x_k as k, x_k % 7 as shape, x, y from ({_WITH_ID('k', 'x')}) join ({_WITH_ID('(k + 40000000)', 'y')}) on x_k = y_k"
_FILL = "The parcels of this shop leave on working days before noon. "
#: A shape each: who runs the shop is said before the name; after it, with seat and contacts, and right before the next
#: one, so of both; of the second company, in a list of terms; at the second place of one company; with words between that break the tie; of nobody, with the number too
#: far away and one that doesn't hold; by a name without marks.
SHAPES = (
    "Администратор на shop{k}.example е „Алфа {k}“ ЕООД, ЕИК {x}. Плащанията се обработват от „Бета Пей“ ЕАД, ЕИК {y}.",
    "„Алфа {k}“ ООД, седалище и адрес на управление: Варна, бул Дълга {k}, ЕИК {x}, тел: +359 2 {n}, a{k}@mail.example, дружество - собственик на shop{k}.example. „Бета Пей“ ЕАД, ЕИК {y}, тел: +359 32 {n}, пощенски услуги",
    "„Алфа {k}“ ООД, ЕИК {x}, означава доставчик на shop{k}.example; „Бета Пей“ ЕАД, ЕИК {y}, собственик на shop{k}.example",
    "Гама Трейд EOOD, EIK {x}, keeps a store. " + _FILL * 6 + "The owner of shop{k}.example is Гама Трейд EOOD, EIK {x}. „Бета Пей“ ЕАД, ЕИК {y}.",
    "Търговец на shop{k}.example и отделно от него партньор „Алфа {k}“ АД, ЕИК {x}. „Бета Пей“ ЕАД, ЕИК {y}.",
    "„Алфа {k}“ ООД. " + _FILL * 6 + "ЕИК {x}. „Делта“ СД, ЕИК 123456780.",
    "MOTORHEAD and FLOOD. Интернет магазинът shop{k}.example е собственост на Диверсо Хеър ЕООД, ЕИК {x}.",
)


def _pages(spark, folder):
    rows = synthesised(spark, folder, TWO, ("supplier",)).withColumn("n", F.col("k") + 1000000)
    text = F.element_at(F.array(*map(F.lit, SHAPES)), F.col("shape").cast("int") + 1)
    for c in ("k", "x", "y", "n"):
        text = F.replace(text, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return rows.select("k", "x", F.col("k").cast("string").alias("page"), F.concat(F.lit("shop"), "k", F.lit(".example")).alias("domain"), text.alias("text"))


#: What each shape says of its parties: name, number, runs the shop, seat, phones, in the order of parties.
_TOLD = f"""select k, 1 as nth, case shape when 3 then 'Бета Пей ЕАД' when 0 then 'Алфа ' || k || ' ЕООД' when 4 then 'Алфа ' || k || ' АД' when 6 then 'Диверсо Хеър ЕООД' else 'Алфа ' || k || ' ООД' end as name,
 case when shape = 3 then y when shape <> 5 then x end as eik, shape in (0, 1, 6) as operator, case when shape = 1 then 'Варна, бул Дълга ' || k end as address, case when shape = 1 then '+3592' || (k + 1000000) else '' end as phones, case when shape = 1 then 'a' || k || '@mail.example' else '' end as emails from ({plain(TWO)})
union all select k, 2, case shape when 3 then 'Гама Трейд EOOD' when 5 then 'Делта СД' else 'Бета Пей ЕАД' end, case when shape = 3 then x when shape <> 5 then y end, shape in (1, 2, 3), null, case when shape = 1 then '+35932' || (k + 1000000) else '' end, '' from ({plain(TWO)}) where shape <> 6"""


@query(_TOLD)
def party_statements(spark, folder):
    out = parties.parties(_pages(spark, folder).select("page", "domain", "text"))
    return out.select(F.col("page").cast("long").alias("k"), "nth", "name", "eik", "operator", "address", F.array_join("phones", ",").alias("phones"), F.array_join("emails", ",").alias("emails"))


@query(f"select k, case when shape = 1 then '+3592' || (k + 1000000) when shape in (5, 6) then '+3592' || (k + 1000000) || ',+3598' || (k + 1000000) else '' end as phones from ({plain(TWO)})")
def own_contacts(spark, folder):
    pages = _pages(spark, folder)
    named = parties.parties(pages.select("page", "domain", "text"))
    whole = F.array(F.concat(F.lit("+3592"), (F.col("k") + 1000000).cast("string")), F.concat(F.lit("+3598"), (F.col("k") + 1000000).cast("string")))
    contacts = pages.select("page", "domain", whole.alias("phones"), F.array().cast("array<string>").alias("emails"))
    return parties.own_contacts(contacts, named, pages.select("domain", F.col("x").alias("eik"))).select(F.col("page").cast("long").alias("k"), F.array_join("phones", ",").alias("phones"))


@query(f"select k, case shape when 3 then 'Гама Трейд EOOD' when 0 then 'Алфа ' || k || ' ЕООД' when 4 then 'Алфа ' || k || ' АД' when 6 then 'Диверсо Хеър ЕООД' else 'Алфа ' || k || ' ООД' end as name from ({plain(TWO)}) where shape <> 5")
def parties_of_resolved(spark, folder):
    pages = _pages(spark, folder)
    named = parties.parties(pages.select("page", "domain", "text"))
    return parties.named_as(named, pages.select("domain", F.col("x").alias("eik"))).select(F.col("page").cast("long").alias("k"), "name")


_SHOP = f"select c_custkey as k, c_custkey % 8 as shape, concat(b, cast({_CHECK} as string)) as eik from (select c_custkey, lpad(cast(c_custkey * 7919 % 100000000 as string), 8, '0') as b from {{customer}})"
#: A sentence each: owned, terms of, founded, courier (none), number right after (of a site's maker, and of a trader), sole trader, prose before it.
SENTENCES = (
    "Интернет магазинът е собственост на Диверсо {k} ЕООД.",
    "С настоящите Общи условия Корнел {k} ЕООД уведомява потребителите",
    "„Панколита {k}“ ООД е създадена през 2011 г. в гр.Варна.",
    "Доставка чрез Еконт Експрес ООД до офис {k}.",
    "Сайтът е на магазин, изработен от Студио Дизайн ООД, ЕИК {eik}",
    "Поръчки приема Алфа Трейд {k} АД, ЕИК {eik}",
    "Между клиента и Куриер {k} СД се сключва договор, а Бета {k} ООД пренася",
    "Дружеството ООД номер {k} не е име",
)


def _shops(spark, folder, *pieces):
    rows = synthesised(spark, folder, _SHOP, ("customer",), dealt=True)
    html = F.concat(*[F.concat(F.lit("<p>"), p, F.lit("</p>")) for p in pieces])
    for c in ("k", "eik"):
        html = F.replace(html, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return rows.select(F.col("k").alias("page"), "shape", "eik", html.alias("html"))


def _by_shape(texts) -> object:
    return F.element_at(F.array(*map(F.lit, texts)), F.col("shape").cast("int") + 1)


@query(f"select k as page, case shape when 0 then 'Диверсо ' || k || ' ЕООД' when 1 then 'Корнел ' || k || ' ЕООД' when 2 then 'Панколита ' || k || ' ООД' when 4 then 'Студио Дизайн ООД' when 5 then 'Алфа Трейд ' || k || ' АД' when 6 then 'Куриер ' || k || ' СД' end as company from ({plain(_SHOP)})")
def contextual_companies(spark, folder):
    pages = _shops(spark, folder, F.lit("Начало"), F.lit("доставка чрез Пратка Бърза ООД"), _by_shape(SENTENCES), F.lit("собственост на Друга Фирма ООД"))
    # The last piece tells another one; it counts only where no piece before it does.
    return lines.contextual_companies(lines.piece_rows(pages).where("i < 3"))


@query(f"select k as page, case when shape in (0, 1, 2, 5) then 'ж.к. Люлин ' || k || ', бл. 705, вх. В' when shape = 6 then 'гр. Варна, ул. Дълга ' || k end as address from ({plain(_SHOP)})")
def contact_block_addresses(spark, folder):
    k = F.col("shape")
    spot = F.lit("Елвесет ж.к. Люлин {k}, бл. 705, вх. В")
    mail, filler = F.lit("пишете на info{k}@shop.example"), F.lit("работно време")
    before = F.when(k == 0, mail).otherwise(filler)
    # shapes: mail three before; in the piece; phone two after; mail four after; an office in prose; one after; with a town; no number
    own = F.when(k == 1, F.concat(spot, F.lit(" +359 877 211 226"))).when(k == 6, F.lit("гр. Варна, ул. Дълга {k}, тел. +359 877 211 226")).when(k == 7, F.lit("ж.к. Люлин, a@b.example")).otherwise(spot)
    pages = _shops(
        spark, folder, before, filler, filler, own,
        F.when(k == 5, mail).otherwise(filler), F.when(k == 2, F.lit("+359 2 123 45 67")).otherwise(filler), filler, F.when(k == 3, mail).otherwise(filler),
    )
    return lines.contact_block_addresses(lines.piece_rows(pages))


@query(f"select k as page, case when shape <> 7 then eik end as number from ({plain(_SHOP)})")
def numbers_after_labels(spark, folder):
    eik, k = F.col("eik"), F.col("shape")
    part = lambda a, n: F.substring(eik, a, n)
    value = F.when(k < 3, eik).when(k == 3, F.concat(F.lit("BG "), eik, F.lit(", гр. София 1000"))).when(k == 4, F.concat(part(1, 3), F.lit(" "), part(4, 3), F.lit(" "), part(7, 3))).when(k == 7, F.concat(F.lit("тел. "), eik))
    spread = F.concat(part(1, 3), F.lit("</p><p>"), part(4, 3), F.lit("</p><p>"), part(7, 3))
    pages = _shops(spark, folder, F.lit("Фирма"), F.when(k % 2 == 0, "ЕИК:").otherwise("БУЛСТАТ №"), F.coalesce(value, spread), F.lit("край"))
    return lines.numbers_after_labels(lines.piece_rows(pages), "eik")


#: An organisation each: in a graph within a list within a graph; of two kinds; within another one; the last of a list and a
#: foreign number; one whose number is not a text, and a block that isn't JSON; six of them, of which five count.
GRAPHS = (
    '{"@graph":[{"@type":"WebSite","name":"no"},[{"@graph":[{"@type":"Organization","legalName":"Firm {k}","taxID":"{x}"}]}]]}',
    '{"@type":["Thing","Store"],"name":"Firm {k}","vatID":"BG{x}","sameAs":["https://a.example","https://b.example"]}',
    '{"@type":"WebPage","publisher":{"@type":"CORPORATION","name":"Outer {k}","department":{"@type":"LocalBusiness","name":"Inner {k}","identifier":"{x}"}}}',
    '[{"@type":"Store","name":"First {k}","vatID":"DE{x}"},{"@type":"Store","name":"Last {k}"}]',
    '{broken</script><script type="application/ld+json">{"@type":"OnlineStore","taxID":7{x},"name":"Firm {k}"}',
    '[{"@type":"Store","name":"n1"},{"@type":"Store","name":"n2"},{"@type":"Store","name":"n3"},{"@type":"Store","name":"n4"},{"@type":"Store","name":"n5"},{"@type":"Store","taxID":"{x}","name":"n6"}]',
)


def _organisations(spark, folder):
    rows = synthesised(spark, folder, TWO, ("supplier",)).withColumn("g", F.col("k") % 6)
    block = F.element_at(F.array(*map(F.lit, GRAPHS)), F.col("g").cast("int") + 1)
    html = F.concat(F.lit('<p>{"@type":"Store"}</p><script type="application/ld+json">'), block, F.lit("</script>"))
    for c in ("k", "x"):
        html = F.replace(html, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return structured.organisations(rows.select(F.col("k").alias("page"), html.alias("html")))


_FIRM = "case when g in (0, 1, 4) then 'Firm ' || k when g = 2 then 'Outer ' || k when g = 3 then 'Last ' || k else 'n6' end"


@query(f"""with t as (select *, k % 6 as g from ({plain(TWO)})) select k as page, 1 as nth, case when g = 0 then {_FIRM} end as legal_name, case when g <> 0 then {_FIRM} end as name, case when g in (0, 5) then x end as tax_id, case when g = 1 then 'BG' || x end as vat_id, null as identifier, case when g = 1 then '["https://a.example","https://b.example"]' end as same_as from t
union all select k, 2, null, case g when 2 then 'Inner ' || k when 3 then 'First ' || k else 'n5' end, null, case when g = 3 then 'DE' || x end, case when g = 2 then x end, null from t where g in (2, 3, 5) union all select k, n, null, 'n' || (7 - n), null, null, null, null from t, unnest([3, 4, 5]) as u(n) where g = 5""")
def structured_organisations(spark, folder):
    return _organisations(spark, folder).select("page", "nth", "legal_name", "name", "tax_id", "vat_id", "identifier", "same_as")


@query(f"with t as (select *, k % 6 as g from ({plain(TWO)})) select 'shop' || k as domain, x as eik, 'structured' as branch, 3 as tier, case g when 0 then 'Firm ' || k when 1 then 'Firm ' || k when 2 then 'Inner ' || k else 'n6' end as name from t where g in (0, 1, 2, 5)")
def structured_claims(spark, folder):
    orgs = _organisations(spark, folder)
    told = structured.numbers(orgs).where("eik is not null").join(orgs.select("page", "nth", F.coalesce("legal_name", "name").alias("name")), ["page", "nth"])
    domain = F.concat(F.lit("shop"), F.col("page").cast("string"))
    stated = told.select(domain.alias("domain"), domain.alias("host"), "page", "eik", "name")
    none = lambda ddl: spark.createDataFrame([], ddl)
    claims = verbs.evidence(none("domain string, host string, page long, eik string, vat string, company string"), none("domain string, host string, page long, name string, eik string, operator boolean"), none("domain string, eik string, name string"), none("domain string, host string, page long, eik string, text string"), stated)
    return claims.select("domain", "eik", "branch", "tier", "name")


#: Nested and open tags, a script within a comment's marks, entities, a mark in quotes, a link around a block, a phone.
BROKEN = "<div><div><div>Shop {k} <b>is <i>open</i></b><p>Fish &amp; chips<br>1 &lt; 2<script>if (a < b) x = '</p><p>no'; // {k}</script> and more<!-- <p>no {k}</p> --><td>cell<a title='a > b' href=\"/terms?k={k}\">Terms <div>of {k}</div></a><A HREF=tel:+359{k}>call</a><a name=x>none</a><a href='mailto:a{k}@shop.example?subject=x'>mail"


@query("""select c_custkey as page, 'Shop ' || c_custkey || ' is open|Fish & chips|1 < 2 and more|cellTerms|of ' || c_custkey || '|callnonemail' as pieces, '/terms?k=' || c_custkey || '=Terms of ' || c_custkey || '|tel:+359' || c_custkey || '=call' as links, 'a' || c_custkey || '@shop.example' as mails, '+359' || c_custkey as phones from customer""")
def page_reader(spark, folder):
    rows = synthesised(spark, folder, "select c_custkey as page from {customer}", ("customer",), dealt=True)
    html = F.replace(F.lit(BROKEN), F.lit("{k}"), F.col("page").cast("string"))
    out = rows.select("page", reader.page_parts(html).alias("p")).select("page", "p.*")
    links = F.transform("links", lambda x: F.concat_ws("=", x["href"], x["text"]))
    return out.select("page", F.array_join("pieces", "|").alias("pieces"), F.array_join(links, "|").alias("links"), F.array_join("mails", "|").alias("mails"), F.array_join("phones", "|").alias("phones"))
