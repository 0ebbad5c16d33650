"""The company profile over every customer: six shapes of what pages and registers say, and what follows for each field."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import company
from ..sources.tables import synthesised
from .registry import plain, query

#: A shape each: the register knows it; the VAT register does, and a page names another company; not VAT registered, with a
#: VAT number on a page; two hosts with two phones; declared for the shop; nobody known, and the site blocks.
SHOPS = "select c_custkey as k, c_custkey % 6 as shape, concat('shop', cast(c_custkey as string), '.example') as domain, case when c_custkey % 6 < 5 then cast(100000000 + c_custkey as string) end as eik, concat('Алфа ', cast(c_custkey as string), ' ООД') as name, concat('гр. София, ул. Дълга ', cast(c_custkey as string)) as seat, 1000000 + c_custkey as n from {customer}"

_S = plain(SHOPS).replace("as string", "as varchar")
_FIELDS = "unnest(['eik', 'legal_name', 'legal_form', 'registered_address', 'phone', 'email', 'vat_number', 'vat_status', 'domain_association'])"


@query(f"""select domain, field, value, case when value is not null and field = 'vat_status' then 'verified' when value is null then case when reason in ('site_blocked', 'vat_register_unavailable', 'no_eik') then 'unavailable' else 'not_found' end
 when field = 'phone' then case when shape = 3 then 'conflicting' else 'corroborated' end when field = 'legal_name' and shape = 1 then 'conflicting'
 when field in ('eik', 'legal_name', 'legal_form', 'registered_address') and shape = 0 or field = 'vat_number' and shape < 2 or field = 'domain_association' and shape = 4 then 'verified' when field = 'registered_address' and shape > 1 or field = 'vat_number' then 'published' else 'corroborated' end as status, case when value is null then reason end as reason,
 case shape when 0 then 'verified' when 1 then 'conflicting' when 5 then 'unverified' else 'published' end as identity, shape < 5 and field not in ('email', 'vat_status') and (field <> 'vat_number' or shape = 2) as disclosed from (select *,
 case when field = 'vat_status' then case when shape < 2 then 'valid' when shape = 2 then 'not_registered' end when shape = 5 or field = 'email' then null when field = 'eik' then eik when field = 'legal_name' then case when shape < 2 then upper(name) else name end when field = 'legal_form' then 'ООД' when field = 'registered_address' then seat
  when field = 'phone' then case when shape = 3 then '+359 32 ' else '+359 2 ' end || substr(n::varchar, 1, 3) || ' ' || substr(n::varchar, 4) when field = 'vat_number' then case when shape < 3 then 'BG' || eik end else domain end as value,
 case when field in ('phone', 'email') then case when shape = 5 then 'site_blocked' else 'checked' end when field in ('vat_number', 'vat_status') then case when shape = 5 then 'no_eik' when shape > 2 then 'vat_register_unavailable' end when field = 'domain_association' then 'no_first_party_link' else 'registry_no_record' end as reason from (select *, {_FIELDS} as field from ({_S})))""")
def company_profile(spark, folder):
    s = synthesised(spark, folder, SHOPS, ("customer",), dealt=True)
    known = s.where("shape < 5")
    no = F.lit(False)
    lit = lambda v, kind="string": F.lit(v).cast(kind)
    one = known.select("domain", F.lit(1).alias("page"), F.concat(F.lit("https://www."), "domain", F.lit("/contact")).alias("url"), no.alias("archived"), no.alias("legal"), F.when(F.col("shape") == 1, "Бета Друга ООД").otherwise(F.col("name")).alias("company"), "eik", F.col("seat").alias("address"), F.when(F.col("shape") == 2, F.concat(F.lit("bg "), "eik")).alias("vat"))
    two = known.select("domain", F.lit(2).alias("page"), F.concat(F.lit("https://help."), "domain", F.lit("/terms")).alias("url"), no.alias("archived"), F.lit(True).alias("legal"), F.col("name").alias("company"), "eik", lit(None).alias("address"), lit(None).alias("vat"))
    pages = one.unionByName(two)
    phone = lambda area: F.array(F.concat(F.lit(f"+359 {area} "), F.col("n").cast("string")))
    none = F.array().cast("array<string>").alias("emails")
    contacts = known.select("domain", F.lit(1).alias("page"), phone("2").alias("phones"), none).unionByName(known.select("domain", F.lit(2).alias("page"), F.when(F.col("shape") == 3, phone("32")).otherwise(phone("2")).alias("phones"), none))
    answers = s.where("shape < 3").select("eik", F.when(F.col("shape") < 2, "confirmed").otherwise("not_found").alias("state"), F.when(F.col("shape") < 2, F.concat(F.lit("АЛФА "), F.col("k").cast("string"), F.lit(" - ООД"))).alias("name"), F.when(F.col("shape") < 2, F.col("seat")).alias("address"))
    records = s.where("shape = 0").select("eik", F.upper("name").alias("name"), F.lit("ООД").alias("form"), "seat", lit(None).alias("phone"), lit(None).alias("email"), lit(None).alias("website"))
    declared = s.where("shape = 4").select("domain", "eik", lit(None).alias("name"))
    named = spark.createDataFrame([], "domain string, page int, nth int, name string, eik string, address string")
    site = F.when(F.col("shape") == 5, "blocked").otherwise("ok").alias("site")
    out = company.company_profile(s.select("domain", "eik", site), pages, named, contacts, answers, records, declared)
    return out.select("domain", "field", "value", "status", "reason", "identity", "disclosed")
