"""The company profile on small tables: groups by agreement, wording by authority, odd rows."""

from pyspark.sql import functions as F

from tradelens.functions import agreement
from tradelens.operators import company

ROW = "domain string, field string, value string, key string, type string, url string, archived boolean, seq string"


def told(spark, *rows):
    df = spark.createDataFrame([("a.bg", f, v, k, t, u, False, str(i)) for i, (f, v, k, t, u) in enumerate(rows)], ROW)
    return {r.field: (r.value, r.status, r.n_values, r.n_sources) for r in company.grouped(df).collect()}


SITE, HELP = "https://www.a.bg/x", "https://help.a.bg/"


def test_wording_of_the_strongest_and_one_voice_a_host(spark):
    got = told(
        spark,
        ("legal_name", "Алфа Трейд", "Алфа Трейд ООД", "company_site", SITE),
        ("legal_name", "АЛФА ТРЕЙД ООД", "АЛФА ТРЕЙД ООД", "vat_register", None),
        ("registered_address", "Long street 5, Sofia", "Long street 5, Sofia", "company_site", SITE),
        ("registered_address", "Sofia, Long street 5", "Sofia, Long street 5", "company_site", "https://a.bg/y"),
        ("legal_form", "ООД", "ООД", "company_site", SITE),
        ("legal_form", "ЕООД", "ЕООД", "company_document", SITE),
    )
    assert got == {"legal_name": ("АЛФА ТРЕЙД ООД", "corroborated", 1, 2), "registered_address": ("Long street 5, Sofia", "published", 1, 2), "legal_form": ("ЕООД", "conflicting", 2, 1)}


def test_many_values_conflict_only_between_origins(spark):
    got = told(spark, ("phone", "1", "1", "company_site", SITE), ("phone", "2", "2", "company_site", SITE), ("email", "a@a.bg", "a@a.bg", "company_site", SITE), ("email", "b@a.bg", "b@a.bg", "company_site", SITE), ("email", "b@a.bg", "b@a.bg", "registry", None))
    assert got == {"phone": ("1", "published", 2, 1), "email": ("b@a.bg", "verified", 2, 2)}
    got = told(spark, ("phone", "1", "1", "company_site", SITE), ("phone", "2", "2", "company_site", HELP), ("phone", "3", "3", "registry", None))
    assert got == {"phone": ("3", "conflicting", 3, 1)}


def test_no_rows(spark):
    assert company.grouped(spark.createDataFrame([], ROW)).collect() == []
    assert company.names_same("НаспърсБългария ЕООД", "Наспърс България - ЕООД") and not company.names_same("А ООД", "Б ООД")
    assert company.addresses_same("гр. София, ул. Дълга 5", "Дълга 5 София") and not company.addresses_same("", "ул. Дълга 5")


def test_a_source_is_read_a_few_times_and_not_once_a_field(spark):
    """Pages were read and joined again for each field's rows, 8 times here."""
    read = spark.sparkContext.accumulator(0)

    def task(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    page = "domain string, page int, url string, archived boolean, legal boolean, company string, eik string, address string, vat string"
    pages = spark.createDataFrame([(f"{i}.bg", 1, f"https://{i}.bg/x", False, False, f"Алфа {i} ООД", str(100000000 + i), "гр. София, ул. Дълга 5", f"BG{100000000 + i}") for i in range(40)], page).mapInArrow(task, page)
    none = lambda schema: spark.createDataFrame([], schema)
    resolved = pages.select("domain", "eik").localCheckpoint()
    began = read.value
    rows = company.candidates(resolved, pages, none("domain string, page int, nth int, name string, eik string, address string"), none("domain string, page int, phones array<string>, emails array<string>"), none("eik string, state string, name string, address string"), none("eik string, name string, form string, seat string, phone string, email string, website string"), none("domain string, eik string, name string"))
    got = {(r.field, r.value) for r in rows.where("domain = '7.bg'").collect()}
    assert got == {("eik", "100000007"), ("legal_name", "Алфа 7 ООД"), ("legal_form", "ООД"), ("registered_address", "гр. София, ул. Дълга 5"), ("vat_number", "BG100000007"), ("domain_association", "7.bg")}
    assert (read.value - began) / 40 <= 6
    plan = spark.range(1).select(agreement.legal_form(F.lit("а").cast("string")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan  # words were split again for each form
