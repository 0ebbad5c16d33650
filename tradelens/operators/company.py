"""The profile of the company behind a domain: every field's candidates from pages, registers and declarations as one table,
grouped by agreement, each with its value, status and why there is none.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import agreement, identifiers
from ..functions.agreement import ADDRESS_STOP, FORMS
from ..sources.tables import scoped, written
from . import verbs

#: Kinds of sources, strongest first; which of them settle a field, and which corroborate it.
AUTHORITY = ("registry", "vat_register", "declaration", "company_document", "company_site", "company_archive", "public_source")
SETTLES = {"eik": ("registry",), "legal_name": ("registry",), "legal_form": ("registry",), "registered_address": ("registry",), "phone": ("registry",), "email": ("registry",), "vat_number": ("vat_register",), "vat_status": ("vat_register",), "domain_association": ("registry", "declaration")}
CORROBORATES = {"eik": ("vat_register", "declaration"), "legal_name": ("vat_register", "declaration"), "legal_form": ("vat_register",), "registered_address": ("vat_register",)}
MULTI_VALUED = ("phone", "email")
FIELDS = tuple(SETTLES)
CANDIDATE = "domain string, field string, value string, key string, type string, url string, archived boolean, seq string"


def _words(name: str) -> set[str]:
    return {w for w in re.findall(r"[^\W_]+", name.lower()) if len(w) > 2 and w not in FORMS}


def names_same(a: str, b: str) -> bool:
    """agreement.names_agree for two texts: half the words of the shorter name, or the same letters without forms."""
    x, y = _words(a), _words(b)
    glued = ["".join(w for w in re.findall(r"[^\W_]+", t.lower()) if w not in FORMS) for t in (a, b)]
    return bool(x and y and len(x & y) >= max(1, min(len(x), len(y)) // 2)) or glued[0] == glued[1]


def addresses_same(a: str, b: str) -> bool:
    """agreement.addresses_agree for two texts: one's words within the other's, or four fifths of the fewer shared, two at least."""
    x, y = ({w for w in re.findall(r"[^\W_]+", t.lower()) if w not in ADDRESS_STOP and not re.fullmatch("[0-9]{4}", w)} for t in (a, b))
    small = min(len(x), len(y))
    return bool(small) and (x <= y or y <= x or len(x & y) >= max(2, int(small * 0.8)))


def page_type(archived: Column, legal: Column) -> Column:
    return F.when(archived, "company_archive").when(legal, "company_document").otherwise("company_site")


def candidates(resolved: DataFrame, pages: DataFrame, named: DataFrame, contacts: DataFrame, answers: DataFrame, records: DataFrame, declared: DataFrame) -> DataFrame:
    """Every source's word on every field (CANDIDATE), in the order they come: pages, then registers, then declarations.

    resolved: domain, eik; pages: domain, page, url, archived, legal, company, eik, address, vat; named: domain, page, nth,
    name, eik, address (see parties); contacts: domain, page, phones, emails of the company itself (see
    parties.own_contacts); answers: eik, state, name, address; records: eik, name, form, seat, phone, email, website;
    declared: domain, eik, name.
    """
    own = resolved.select("domain", F.col("eik").alias("own"))
    page = pages.join(own, "domain").withColumns({"type": page_type(F.col("archived"), F.col("legal")), "mine": F.regexp_replace(F.coalesce("eik", F.lit("")), "[^0-9]", "") == F.col("own")})
    at = page.select("domain", "page", "url", "archived", "type", "own")
    said = named.select("domain", "page", "nth", "name", F.col("eik").alias("told"), "address").join(at, ["domain", "page"])

    def entry(field: str, value: Column, key: Column | None = None, order: str = "1", n: Column | None = None, when: Column | None = None) -> Column:
        """A row that a row of a source makes, unless `when` fails."""
        row = F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), (value if key is None else key).cast("string").alias("key"), F.lit(order).alias("order"), (F.lit(0) if n is None else n).cast("int").alias("n"))
        return row if when is None else F.when(when, row)

    def read(df: DataFrame, name: str | None = None, address: str | None = None, any_name: bool = False) -> DataFrame:
        """df with what its name and address say: each is read once, however many rows it makes. A declared name often lacks
        its form, so any is taken as it is."""
        if name:
            df = df.withColumn("bare", F.col(name) if any_name else agreement.clean_name(F.col(name)))
            df = df.withColumns({"shown": agreement.display_name(F.col("bare")), "named": F.col("bare").isNotNull() if any_name else agreement.plausible_name(F.col("bare")), "form_of": agreement.legal_form(F.col("bare"))})
        if address:
            df = df.withColumn("place", agreement.clean_address(F.col(address)))
            df = df.withColumns({"place_shown": agreement.display_address(F.col("place")), "placed": agreement.plausible_address(F.col("place"))})
        return df

    def names(order: str, n: Column | None = None, when: Column | None = None, forms: bool = True) -> list[Column]:
        has = F.col("named") if when is None else when & F.col("named")
        return [entry("legal_name", F.col("shown"), F.col("bare"), order, n, has), *([entry("legal_form", F.col("form_of"), None, order, n, has)] if forms else [])]

    def address(order: str, n: Column | None = None, when: Column | None = None) -> Column:
        return entry("registered_address", F.col("place_shown"), F.col("place"), order, n, F.col("placed") if when is None else when & F.col("placed"))

    def rows(df: DataFrame, *entries: Column) -> DataFrame:
        """All rows of a source at once: it is read and joined once."""
        has = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("url", "archived", "page")}
        each = df.select("domain", "type", has["url"].cast("string").alias("url"), F.coalesce(has["archived"].cast("boolean"), F.lit(False)).alias("archived"), has["page"].cast("string").alias("page"), F.explode(F.array(*entries)).alias("e")).where("e.key is not null and e.key <> ''")
        seq = F.concat_ws("/", "e.order", F.lpad(F.coalesce("page", F.lit("")), 12, "0"), F.lpad(F.coalesce("e.n", F.lit(0)).cast("string"), 6, "0"))
        return each.select("domain", "e.field", "e.value", "e.key", "type", "url", "archived", seq.alias("seq"))

    mine, nth, last = F.col("mine"), F.col("nth"), F.lit(999)
    called = said.where("told = own")
    register = records.join(own.withColumnRenamed("own", "eik"), "eik").withColumn("type", F.lit("registry"))
    vat = answers.where("state = 'confirmed'").join(own.withColumnRenamed("own", "eik"), "eik").withColumn("type", F.lit("vat_register"))
    shops = declared.join(own, "domain").where("eik = own").withColumn("type", F.lit("declaration"))
    listed = lambda c: F.transform(c, lambda x, i: F.struct(F.lit(c).alias("kind"), x.alias("raw"), i.alias("i")))
    told = contacts.join(at, ["domain", "page"]).select("domain", "page", "url", "archived", "type", F.explode(F.concat(*(F.coalesce(listed(c), F.array().cast("array<struct<kind: string, raw: string, i: int>>")) for c in ("phones", "emails")))).alias("c"))
    told = told.select("domain", "page", "url", "archived", "type", "c.*")
    raw, is_phone = F.col("raw"), F.col("kind") == "phones"
    parts = [
        rows(
            read(page, "company", "address"),
            entry("eik", F.col("own"), when=mine),
            *names("1", last, mine),
            address("1", last, mine),
            entry("vat_number", identifiers.vat_key(F.col("vat"))),
            entry("domain_association", F.col("domain"), when=mine),
        ),
        rows(read(called, "name", "address"), entry("eik", F.col("own"), n=nth), *names("1", nth), address("1", nth), entry("domain_association", F.col("domain"), n=nth)),
        rows(
            read(register, "name", "seat"),
            entry("eik", F.col("eik"), order="2"),
            *names("2", forms=False),
            entry("legal_form", agreement.legal_form(F.col("form")), order="0"),
            address("2"),
            entry("phone", identifiers.phone_display(F.col("phone")), identifiers.phone_key(F.col("phone")), "2"),
            entry("email", identifiers.email_key(F.col("email")), order="2"),
            entry("domain_association", F.col("domain"), order="2", when=F.contains(F.lower("website"), F.col("domain"))),
        ),
        rows(read(vat, "name", "address"), entry("eik", F.col("eik"), order="3"), *names("3"), address("3"), entry("vat_number", F.concat(F.lit("BG"), F.col("eik")), order="2")),
        rows(read(shops, "name", any_name=True), entry("eik", F.col("own"), order="5"), *names("4"), entry("domain_association", F.col("domain"), order="0")),
        rows(told, entry("phone", identifiers.phone_display(raw), identifiers.phone_key(raw), n=F.col("i"), when=is_phone), entry("email", identifiers.email_key(raw), n=F.col("i"), when=~is_phone)),
    ]
    out = written(reduce(DataFrame.unionByName, parts), "candidates")
    # The same company under another number, in a text of the domain's own.
    other = said.where("told is not null and told <> own").select("*", agreement.clean_name(F.col("name")).alias("n"))
    known = out.where("field = 'legal_name'").select("domain", F.col("key").alias("known")).distinct()
    clash = other.join(known, "domain").where(agreement.names_agree(F.col("n"), F.col("known"))).select("domain", "page", "nth", "told", "url", "archived", "type").distinct()
    return out.unionByName(rows(clash, entry("eik", F.col("told"), order="4", n=nth)))


def _listed(kinds: dict[str, tuple[str, ...]]) -> Column:
    """Whether the row's type is one of its field's."""
    out = F.lit(False)
    for field, types in kinds.items():
        out = out | ((F.col("field") == field) & F.col("type").isin(*types))
    return out


def _led(rows: DataFrame, same: dict) -> DataFrame:
    """rows (domain, field, key, seq and others) of fields whose values are one by a predicate (same), with leader: the key
    that each is grouped with. In order of arrival a key joins the first leader that agrees with it, or leads itself; rows
    of one domain and field stay in one task, which holds their leaders alone (as in profiles.fuzzy_groups).
    """
    import pyarrow as pa

    names = rows.columns

    def task(batches):
        own, leaders = None, []
        for b in batches:
            out = []
            for domain, field, key in zip(*(b.column(names.index(c)).to_pylist() for c in ("domain", "field", "key")), strict=True):
                if (domain, field) != own:
                    own, leaders = (domain, field), []
                found = next((x for x in leaders if x == key or same[field](x, key)), None) if key is not None else None
                if found is None and key is not None:
                    leaders.append(found := key)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, "leader"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", leader string"
    return rows.repartition("domain", "field").sortWithinPartitions("domain", "field", "seq", "key").mapInArrow(task, ddl)


def grouped(rows: DataFrame) -> DataFrame:
    """domain, field, value, status, n_values, n_sources, disclosed of candidates: values that agree are one group, in order
    of arrival; names and addresses by their words, all others by their keys.

    A group shows its strongest source's wording. The strongest group is the field's, then the one of most sources, then
    the first; of fields with many values it is the first group that all origins (kind, archived or not, host) share, where
    there is one. Two groups conflict; of fields with many values only origins that share none do.
    """
    rank = F.array_position(F.array(*map(F.lit, AUTHORITY)), F.col("type"))
    host = F.regexp_replace(F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^https?://([^/:?#]+)", 1), r"^www\.", "")
    kind = F.when(F.col("type").isin("registry", "vat_register"), F.col("type")).otherwise("first_party")
    fuzzy = {"legal_name": names_same, "registered_address": addresses_same}
    named = F.col("field").isin(*fuzzy)
    rows = rows.where("domain is not null and field is not null").withColumn("host", host)
    # Copies meet first, dealt by all that tells rows apart; then a field's rows meet once, and what follows is by field.
    once = lambda df: df.groupBy("domain", "field", "key", "type", "archived", "host").agg(F.min(F.struct("seq", "value")).alias("w"), F.count(F.lit(1)).alias("sources")).select("domain", "field", "key", "type", "archived", "host", "w.*", "sources")
    led = once(rows.where(~named)).withColumn("leader", F.col("key")).unionByName(_led(once(rows.where(named)), fuzzy)).repartition("domain", "field")
    origin, voice = F.concat_ws("|", "type", F.col("archived").cast("string"), "host"), F.concat_ws("|", kind, "host", F.col("archived").cast("string"))
    led = led.select("domain", "field", "leader", origin.alias("origin"), voice.alias("voice"), F.struct(rank.alias("authority"), "seq", "value").alias("wording"), "seq", "sources", _listed(SETTLES).alias("settles"), _listed(CORROBORATES).alias("official"), F.col("type").startswith("company_").alias("site"))
    led = led.withColumn("nth_origin", F.dense_rank().over(Window.partitionBy("domain", "field").orderBy("origin")))
    many = F.col("field").isin(*MULTI_VALUED)
    # Each level counts what the one below it tells apart: origins of a voice, voices of a group, groups of a field.
    sums = {"wording": F.min, "seq": F.min, "sources": F.sum, "settles": F.max, "official": F.max, "site": F.max, "nth_origin": F.max}
    all_of = [f(c).alias(c) for c, f in sums.items()]
    by = ["domain", "field", "leader"]
    origins = led.groupBy(*by, "voice", "origin").agg(*all_of)
    voices = origins.groupBy(*by, "voice").agg(*all_of, F.count(F.lit(1)).alias("in_origins"))
    groups = voices.groupBy(*by).agg(*all_of, F.sum("in_origins").alias("in_origins"), F.count(F.lit(1)).alias("voices"))
    # A group that all origins share is in as many as there are: the last origin's number.
    groups = groups.withColumn("origins", F.max("nth_origin").over(Window.partitionBy("domain", "field")))
    shared = many & (F.col("origins") > 1) & (F.col("in_origins") == F.col("origins"))
    best = F.min(F.struct((~F.col("shared")).alias("late"), F.col("wording.authority").alias("authority"), (-F.col("sources")).alias("s"), "seq", F.col("wording.value").alias("value"), "settles", "official", "voices", "sources"))
    out = groups.withColumn("shared", shared).groupBy("domain", "field").agg(best.alias("b"), F.count(F.lit(1)).alias("n_values"), F.max("origins").alias("origins"), F.bool_or("shared").alias("any_shared"), F.max("site").alias("disclosed"))
    conflict = F.when(many, (F.col("origins") > 1) & ~F.col("any_shared")).otherwise(F.col("n_values") > 1)
    status = F.when(conflict, "conflicting").when(F.col("b.settles"), "verified").when(F.col("b.official") | (F.col("b.voices") > 1), "corroborated").otherwise("published")
    return out.select("domain", "field", F.col("b.value").alias("value"), status.alias("status"), "n_values", F.col("b.sources").alias("n_sources"), "disclosed")


@scoped
def company_profile(resolved: DataFrame, pages: DataFrame, named: DataFrame, contacts: DataFrame, answers: DataFrame, records: DataFrame, declared: DataFrame, register_available: bool = True) -> DataFrame:
    """One row a domain and field: value, status, reason, n_values, n_sources, disclosed (by the site itself), coverage and
    the domain's identity. Tables as in candidates; resolved: domain, eik (null where none), site (its state).

    A field without a value is unavailable where its source could not be asked (a blocked site or no page for contacts, a
    register that isn't connected, a VAT register that gave no answer), else not found. The VAT status is the VAT
    register's word. The identity is verified by the register; corroborated by the VAT register unless names conflict;
    else conflicting, published or unverified.
    """
    told = grouped(candidates(resolved, pages, named, contacts, answers, records, declared))
    n = pages.groupBy("domain").agg(F.count(F.lit(1)).alias("n_pages"))
    vat = answers.groupBy("eik").agg(F.max(F.col("state") == "confirmed").alias("vat_ok"), F.max(F.col("state").isin("confirmed", "not_found")).alias("vat_told"))
    reg = records.select("eik").distinct().withColumn("reg_ok", F.lit(True))
    own = resolved.select("domain", "eik", "site").join(n, "domain", "left").join(vat, "eik", "left").join(reg, "eik", "left")
    own = own.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("vat_ok", "vat_told", "reg_ok")})
    # At most a row a field, so that a domain's are one map: its name's row stands beside the others without a window.
    told = told.where(F.col("field").isin(*FIELDS)).groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "status", "n_values", "n_sources", "disclosed")))).alias("told"))
    own = own.join(told, "domain", "left").withColumn("name", F.element_at("told", "legal_name"))
    every = own.select("*", F.explode(F.array(*map(F.lit, FIELDS))).alias("field")).withColumn("of", F.element_at("told", F.col("field"))).select("*", "of.*")
    field, known = F.col("field"), F.col("eik").isNotNull()
    blocked = F.col("site").isin("blocked", "temporarily_unavailable", "failed")
    contact, official = field.isin(*MULTI_VALUED), field.isin("eik", "legal_name", "legal_form", "registered_address")
    reason = (
        F.when(contact, F.when(F.col("n_pages").isNotNull(), "checked").otherwise(F.when(blocked, "site_blocked").otherwise("no_pages")))
        .when(official, F.lit("registry_no_record" if register_available else "registry_unconfigured"))
        .when(field == "vat_number", F.when(F.col("vat_told"), "not_vat_registered").otherwise(F.when(known, "vat_register_unavailable").otherwise("no_eik")))
        .when(field == "vat_status", F.when(~known, "no_eik").otherwise("vat_register_unavailable"))
        .otherwise("no_first_party_link")
    )
    gone = reason.isin("site_blocked", "no_pages", "registry_unconfigured", "vat_register_unavailable", "no_eik")
    word = F.when((field == "vat_status") & known & F.col("vat_told"), F.when(F.col("vat_ok"), "valid").otherwise("not_registered"))
    out = every.withColumn("value", F.coalesce(word, "value"))
    out = out.withColumn("status", F.when(word.isNotNull(), "verified").otherwise(F.coalesce("status", F.when(gone, "unavailable").otherwise("not_found"))))
    out = out.withColumn("reason", F.when(F.col("value").isNull(), reason)).withColumn("coverage", verbs.coverage_of(F.col("status"), F.col("value")))
    clash = F.coalesce(F.col("name.status") == "conflicting", F.lit(False))
    identity = F.when(F.col("reg_ok"), "verified").when(F.col("vat_ok") & ~clash, "corroborated").when(clash, "conflicting").when(known | F.col("name.value").isNotNull(), "published").otherwise("unverified")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("domain", "field", "value", "status", "reason", zero("n_values"), zero("n_sources"), F.coalesce("disclosed", F.lit(False)).alias("disclosed"), "coverage", identity.alias("identity"))
