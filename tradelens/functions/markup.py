"""Text, labels, contacts and structured data of pages, as columns. Regular expressions over whole pages, no parser:
tags that are not closed end at the next tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import email_key, identifier_or_null, phone_key
from .web import emails_in, stripped

#: Named character references that pages of shops use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}
#: Tags that begin a new piece of text.
BLOCKS = "address|article|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|section|table|td|th|tr|ul"
#: Labels of fields in English and Bulgarian.
LABELS = {
    "eik": "ЕИК|БУЛСТАТ|UIC|EIK|company number|registration number",
    "vat": "ДДС номер|ДДС №|ИН по ЗДДС|VAT number|VAT No|VAT ID|VAT",
    "address": "седалище и адрес на управление|адрес|registered address|address",
    "phone": "телефон|тел|phone|tel",
    "company": "фирма|търговец|дружество|company|trader",
}
#: Words by which prose says who runs a shop.
OPERATOR = "is operated by|operated by|is run by|is owned by|се управлява от|собственост на|се оперира от"
FORM = "ЕООД|ООД|ЕАД|АД|EOOD|OOD|EAD|AD|Ltd|LLC|GmbH"
#: Roles that registers and pages give people.
ROLES = "управител|представляващ|собственик|manager|director|owner|representative"
#: Kinds of organisation in structured data.
ORGANISATIONS = ("organization", "corporation", "localbusiness", "store", "onlinestore", "onlinebusiness", "company")


def unescaped(text: Column) -> Column:
    for name, mark in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def chunks(html: Column) -> Column:
    """Visible pieces of text in order: cut at block tags and line ends, white space collapsed, empty ones left out."""
    bare = F.regexp_replace(stripped(html), r"(?is)<script[^>]*>.*?</script>", "")
    cut = F.regexp_replace(bare, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n")
    flat = unescaped(F.regexp_replace(cut, r"<[^>]*>", ""))
    pieces = F.transform(F.split(flat, r"\n"), lambda c: F.trim(F.regexp_replace(c, r"[\s\x{a0}]+", " ")))
    return F.filter(pieces, lambda c: c != "")


def labelled(pieces: Column, field: str) -> Column:
    """What follows the field's earliest label (the longest at one place), in the same piece or, where the label ends its
    piece, in the next; the first such piece counts."""
    names = "|".join(sorted(LABELS[field].split("|"), key=len, reverse=True))
    label = rf"(?iu)^(?:.*?[^\p{{L}}])??(?:{names})(?![\p{{L}}])\s*[.:№#-]*\s*"
    padded = F.concat(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), F.array(F.lit("")))
    pairs = F.arrays_zip(pieces.alias("own"), padded.alias("after"))
    found = F.transform(F.filter(pairs, lambda p: p["own"].rlike(label)), lambda p: F.when(F.regexp_replace(p["own"], label, "") == "", p["after"]).otherwise(F.regexp_replace(p["own"], label, "")))
    return F.get(F.filter(found, lambda v: v != ""), F.lit(0))


def once(value: Column, f):
    """f of a value that is computed once, however often f names it: lambda variables are bound, columns are repeated."""
    return F.transform(F.array(value), f)[0]


def six_fields(html: Column) -> Column:
    """struct(company, eik, vat, address, phone, email) of a page; each null where the page doesn't tell it.

    Identifiers are taken from labelled text alone; e-mails and +359 phones anywhere. The page is cut into pieces once.
    """
    return once(chunks(html), lambda pieces: _fields(html, pieces))


def _fields(html: Column, pieces: Column) -> Column:
    digits = F.regexp_extract(F.regexp_replace(F.coalesce(labelled(pieces, "eik"), F.lit("")), r"(?<=[0-9])[ .-](?=[0-9])", ""), r"^(?:BG)?([0-9]{13}|[0-9]{9})(?![0-9])", 1)
    vat = F.regexp_extract(F.upper(F.regexp_replace(F.coalesce(labelled(pieces, "vat"), F.lit("")), r"(?<=[0-9G])[ .-](?=[0-9])", "")), r"^([A-Z]{2})?([0-9]{9,13})(?![0-9])", 0)
    address, text = labelled(pieces, "address"), F.array_join(pieces, "\n")
    phone = F.coalesce(phone_key(F.regexp_extract(F.coalesce(labelled(pieces, "phone"), F.lit("")), r"^([+0-9][0-9 ()/.-]{5,20})", 1)), F.get(_phones(html, text), F.lit(0)))
    company = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(labelled(pieces, "company"), F.lit("")), rf"(?u)^(.{{1,120}}?[ \"”](?:{FORM}))(?![\p{{L}}])", 1), F.lit("")), company_line(pieces))
    good = F.length(address).between(8, 200) & address.rlike("[0-9]")
    return F.struct(
        company.alias("company"),
        F.nullif(digits, F.lit("")).alias("eik"),
        F.when(vat.rlike("^[0-9]"), F.concat(F.lit("BG"), vat)).when(vat != "", vat).alias("vat"),
        F.coalesce(F.when(good, address), address_line(pieces)).alias("address"),
        phone.alias("phone"),
        F.get(_emails(html, text), F.lit(0)).alias("email"),
    )


#: Abbreviations and words that begin a settlement, and those that begin a thoroughfare.
SETTLEMENT, THOROUGHFARE = r"гр\.|град|с\.|село", r"ул\.|бул\.|ж\.?к\.?|кв\.|пл\.|площад|шосе"


def address_line(pieces: Column) -> Column:
    """An address without a label: a piece that opens with a settlement, of three words at most, before a thoroughfare."""
    shape = rf"(?iu)^(?:[0-9]{{4}},?\s*)?(?:{SETTLEMENT})\s*\p{{L}}+(?:\s\p{{L}}+){{0,2}}\s*,\s*(?:{THOROUGHFARE}).*$"
    return F.get(F.filter(pieces, lambda c: F.length(c).between(8, 300) & c.rlike(shape) & c.rlike("[0-9]")), F.lit(0))


def company_line(pieces: Column) -> Column:
    """A company without a label: a piece of 2 to 10 words and at most 150 characters whose last word is a legal form."""
    form = rf"^(?:{FORM})$"
    last = lambda c: F.element_at(F.split(c, " "), -1)
    return F.get(F.filter(pieces, lambda c: (F.length(c) <= 150) & F.size(F.split(c, " ")).between(2, 10) & last(c).rlike(form) & ~c.rlike("[0-9]")), F.lit(0))


def _phones(html: Column, text: Column) -> Column:
    links = F.regexp_extract_all(html, F.lit(r'(?i)href="tel:([^"]+)"'), 1)
    prose = F.regexp_extract_all(text, F.lit(r"(\+359[0-9 ()/.-]{7,16})"), 1)
    return F.array_distinct(F.filter(F.transform(F.concat(links, prose), phone_key), lambda p: p.isNotNull()))


def phones(html: Column) -> Column:
    """Keys of phones in tel: links and of +359 numbers in the text, in this order, each once."""
    return _phones(html, F.array_join(chunks(html), "\n"))


def _emails(html: Column, text: Column) -> Column:
    links = F.regexp_extract_all(html, F.lit(r'(?i)href="mailto:([^"?]+)'), 1)
    return F.array_distinct(F.filter(F.transform(F.concat(links, emails_in(text)), email_key), lambda e: e.isNotNull()))


def emails(html: Column) -> Column:
    """Keys of addresses in mailto: links and in the text, in this order, each once."""
    return _emails(html, F.array_join(chunks(html), "\n"))


#: Words of pages that hold a trader's legal text.
LEGAL = ("terms", "conditions", "privacy", "legal", "imprint", "impressum", "contact", "about", "условия", "поверителност", "контакти", "за нас", "лични данни")


def is_legal(url: Column, text: Column) -> Column:
    """Whether the address or the text's first 600 characters hold a word of legal or contact pages."""
    head = F.lower(F.concat_ws(" ", url, F.substring(text, 1, 600)))
    return F.exists(F.array(*map(F.lit, LEGAL)), lambda w: F.contains(head, w))


def mentions(text: Column) -> Column:
    """array<struct(name, eik, operator)>: names with a legal form, an identifier within 60 characters after, and whether
    words before say that it runs the shop."""
    name = rf"(?u)((?:(?:{OPERATOR})\s+)?)[\"„“]?((?:\p{{Lu}}[\p{{L}}0-9&-]*\s){{1,7}})[\"”“]?\s?({FORM})(?![\p{{L}}])((?:[^0-9\n]{{0,60}}(?:[0-9]{{13}}|[0-9]{{9}})(?![0-9]))?)"
    part = lambda n: F.regexp_extract_all(text, F.lit(name), n)
    rows = F.arrays_zip(part(1).alias("op"), part(2).alias("stem"), part(3).alias("form"), part(4).alias("tail"))
    return F.transform(
        rows,
        lambda m: F.struct(
            F.concat_ws(" ", F.trim(m["stem"]), m["form"]).alias("name"),
            identifier_or_null(F.regexp_extract(m["tail"], r"([0-9]+)$", 1)).alias("eik"),
            (m["op"] != "").alias("operator"),
        ),
    )


def people(text: Column) -> Column:
    """array<struct(name, role)>: a role, then two or three capitalised words."""
    said = rf"(?u)(?i:({ROLES}))\s*[:–-]?\s+((?:\p{{Lu}}\p{{Ll}}+[ -]){{1,2}}\p{{Lu}}\p{{Ll}}+)"
    rows = F.arrays_zip(F.regexp_extract_all(text, F.lit(said), 2).alias("name"), F.transform(F.regexp_extract_all(text, F.lit(said), 1), lambda r: F.lower(r)).alias("role"))
    return F.array_distinct(rows)


def structured(html: Column) -> Column:
    """array<struct(kind, name, tax_id, vat_id, email, phone)> of JSON-LD blocks: organisations at the top, in a list at
    the top, or in @graph; text that isn't JSON counts as nothing."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    one = "struct<`@type`:string,legalName:string,name:string,taxID:string,vatID:string,email:string,telephone:string>"
    objects = F.flatten(
        F.transform(
            blocks,
            lambda b: F.concat(
                F.coalesce(F.from_json(F.get_json_object(b, "$.@graph"), f"array<{one}>"), F.array().cast(f"array<{one}>")),
                F.coalesce(F.when(F.trim(b).startswith("["), F.from_json(b, f"array<{one}>")).otherwise(F.array(F.from_json(b, one))), F.array().cast(f"array<{one}>")),
            ),
        )
    )
    kept = F.filter(objects, lambda o: F.lower(o["@type"]).isin(*ORGANISATIONS))
    return F.transform(kept, lambda o: F.struct(o["@type"].alias("kind"), F.coalesce(o["legalName"], o["name"]).alias("name"), o["taxID"].alias("tax_id"), o["vatID"].alias("vat_id"), o["email"].alias("email"), o["telephone"].alias("phone")))
