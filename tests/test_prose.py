"""What prose says of companies, on small texts and odd rows."""

import pytest
from pyspark.sql import functions as F

from tradelens.operators import lines, parties

ID = "123456786"


@pytest.fixture(scope="module")
def ids(spark):
    from tradelens.functions.identifiers import identifier_or_null

    ok = [r.v for r in spark.range(10, 60).select(identifier_or_null(F.format_string("17534580%d", F.col("id") % 10)).alias("v")).where("v is not null").distinct().collect()]
    more = [r.v for r in spark.range(10).select(identifier_or_null(F.format_string("20842100%d", "id")).alias("v")).where("v is not null").collect()]
    return ok[0], more[0]


def told(spark, *texts):
    df = spark.createDataFrame([(str(i), "shop.bg", x) for i, x in enumerate(texts)], "page string, domain string, text string")
    return parties.parties(df).orderBy("page", "nth").collect()


def test_a_statement_is_not_given_to_the_neighbour(spark, ids):
    a, b = ids
    rows = told(spark, f"Администратор на shop.bg е „Тест Търговия“ ЕООД, ЕИК {a}. Плащанията се обработват от „Пей Сървисиз“ ЕАД, ЕИК {b}.")
    assert [(r.name, r.eik, r.operator) for r in rows] == [("Тест Търговия ЕООД", a, True), ("Пей Сървисиз ЕАД", b, False)]


def test_words_that_end_in_a_form_are_no_companies(spark, ids):
    rows = told(spark, "T-SHIRTS | MOTORHEAD MOTORHEAD NO REMORSE", "in case of FLOOD or fire", f"Наспърс Класифайдс БългарияЕООД, ЕИК {ids[0]}", None, "", "ЕООД", "„А“ ООД")
    assert [(r.page, r.name, r.eik) for r in rows] == [("2", "Наспърс Класифайдс България ЕООД", ids[0])]


def test_a_party_named_again_keeps_its_first_place_and_its_role(spark, ids):
    a = ids[0]
    rows = told(spark, f"Договор с Алфа Трейд ООД, ЕИК {a}. Оператор на shop.bg е АЛФА Трейд ООД, ЕИК {a}.", "операторът shop.bg и „Бета“ ООД", "shop.bg operated by the company „Бета“ ООД", "„Бета“ ООД означава оператор на shop.bg")
    assert [(r.page, r.name, r.operator) for r in rows] == [("0", "Алфа Трейд ООД", True), ("1", "Бета ООД", True), ("2", "Бета ООД", True), ("3", "Бета ООД", False)]
    assert "Оператор на shop.bg" in rows[0].snippet


def test_twenty_parties_and_what_comes_after_them(spark):
    names = [chr(ord("А") + i) for i in range(25)]
    text = " ".join(f"„Фирма {c}“ ООД." for c in names) + " Оператор на shop.bg е „Фирма А“ ООД. Гама Делта ООД."
    rows = told(spark, text)
    assert [r.name for r in rows] == [f"Фирма {c} ООД" for c in names[:20]]
    # The place that says it comes after the twentieth party.
    assert not any(r.operator for r in rows)


def test_quoted_names_come_first_and_a_long_text_is_read_in_part(spark):
    rows = told(spark, "Гама Делта ООД, „Алфа“ ООД", "x " * 300_000 + "„Алфа“ ООД")
    assert [(r.page, r.name) for r in rows] == [("0", "Алфа ООД"), ("0", "Гама Делта ООД")]


def test_own_contacts_of_pages_without_parties(spark):
    contacts = spark.createDataFrame([("1", "a.bg", ["+3591"], ["x@a.bg"]), ("2", "b.bg", [], None)], "page string, domain string, phones array<string>, emails array<string>")
    named = parties.parties(spark.createDataFrame([], "page string, domain string, text string"))
    got = parties.own_contacts(contacts, named, spark.createDataFrame([("a.bg", ID)], "domain string, eik string")).orderBy("page").collect()
    assert [tuple(r) for r in got] == [("1", "a.bg", ID, ["+3591"], ["x@a.bg"]), ("2", "b.bg", None, [], None)]


VALUES = {
    "„Алфа Трейд“ - ЕООД, ЕИК 1": "Алфа Трейд ЕООД",
    "е собственост на Диверсо Хеър ЕООД": "Диверсо Хеър ЕООД",
    "ЕТ „Иван Петров - 67“": "ЕТ Иван Петров - 67",
    "ЕООД": None,
    "„ООД“ ООД": None,
    "we ship worldwide": None,
    "Powered by Studio Ltd": None,
    "Panco Ltd.": "Panco Ltd.",
    "A B C D E F G H I ООД": None,
    "ПРОДАД": None,
    "": None,
    None: None,
}


def test_company_values(spark):
    df = spark.createDataFrame([(k, v) for k, v in VALUES.items()], "raw string, want string").select("raw", "want", lines.company_value(F.col("raw")).alias("got"))
    assert [tuple(r) for r in df.where("not (want <=> got)").collect()] == []


SAID = "е собственост на Алфа Трейд ООД, ЕИК 1"
#: Pieces longer than 2000 characters, and what the whole of each says.
LONG = (
    ("дума " * 500 + SAID, "Алфа Трейд ООД"),
    ("дума " * 60_000 + SAID, "Алфа Трейд ООД"),
    ("Куриер ООД носи " * 20_000 + "„Бета“ АД със седалище Варна, " + SAID, "Бета АД"),
    # Character 2000 ends a form, but not the word; the name, but not what is said of it.
    ("x" * 1975 + " е собственост на Алфа АДмин", None),
    ("x" * 1990 + " „Алфа“ АД, ЕИК 1", "Алфа АД"),
    # The words before count up to 60 characters from the name.
    ("x" * 3000 + " собственост" + " " * 49 + "Алфа АД", "Алфа АД"),
    ("x" * 3000 + " собственост" + " " * 50 + "Алфа АД", None),
    # No word and no run of marks is read again from each of its characters.
    *((part * (100_000 // len(part)) + " " + SAID, "Алфа Трейд ООД") for part in ("А", "А-", "-", " ", "„", "А ", "ЕООДх", "А😀")),
    ("А" + "-" * 100_000 + ", " + SAID, "Алфа Трейд ООД"),
)


def test_a_long_piece_is_read_to_its_end(spark):
    df = spark.createDataFrame([(i, piece) for i, (piece, _) in enumerate(LONG)], "page int, piece string").withColumn("i", F.lit(0))
    got = {r.page: r.company for r in lines.contextual_companies(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LONG)}


def test_addresses_by_their_block(spark):
    page = "<p>{}</p>" * 3
    pages = spark.createDataFrame([
        (1, "<p>info@elveszett.example +359 877 211 226 Elveszett ж.к. Люлин 7, бл. 705, вх. В</p>"),
        (2, page.format("Офис на Куриер", "ул. Дълга 5", "работно време")),
        (3, page.format("+359 877 211 226", "без адрес", "ул. Дълга 5")),
        (4, None), (5, ""),
        (6, "<div>ЕИК</div><div>175</div><div>345</div><div>805</div>"),
    ], "page int, html string")
    got = {r.page: (r.address, r.eik) for r in lines.shaped_fields(pages).collect()}
    assert got == {1: ("ж.к. Люлин 7, бл. 705, вх. В", None), 2: (None, None), 3: ("ул. Дълга 5", None), 6: (None, "175345805")}
    assert lines.shaped_fields(pages.where("false")).collect() == []
    assert [r.address for r in spark.createDataFrame([("и адрес на управление: гр. София, ж.к. Гевгелийски, бл. 2",), ("Sofia | Bulgaria",), (None,)], "a string").select(lines.address_value(F.col("a")).alias("address")).collect()] == ["гр. София, ж.к. Гевгелийски, бл. 2", None, None]
