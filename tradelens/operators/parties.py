"""Companies that a page's prose names, what it says of each, and whether it says that one runs the shop.

Names are found by their legal form: an Arrow UDTF reads each text once and gives a row a name with what stands around
it. What the words around say is told by column expressions; one row a party is kept by windows over the page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import email_key, identifier_or_null, phone_key

#: Legal forms after a name; the first one only after a quoted name, since it ends many words in capitals.
QUOTED_ONLY = ("ЕТ",)
FORMS = ("ЕООД", "ООД", "ЕАД", "АД", "КДА", "КД", "СД", "EOOD", "OOD", "EAD")
#: Stems of words that say who runs a shop.
RUNS = ("дминистратор", "оператор", "собственик", "собственост", "стопанисва", "управлява", "поддържа", "търговец", "доставчик", "operator", "owner", "administrator", "operated by", "owned by", "provider")
#: Words that may stand between such a word or the shop's address and the company's name.
BETWEEN = ("е", "са", "от", "на", "и", "дружеството", "дружество", "фирмата", "фирма", "компанията", "търговеца", "търговецът", "търговец", "is", "by", "the", "company", "a", "an", "of")
#: Words by which a list of terms goes on to the next one.
DEFINES = ("означава", "озн.", "means", "shall mean")
#: Words that no company's name begins with.
NO_NAME = ("и", "на", "от", "the")
#: Labels of a register number, of a seat, and words that end a seat.
NUMBER = r"(?:ЕИК|БУЛСТАТ|UIC|EIK|Identification\s+Code(?:\s*/\s*Number)?)"
SEAT = r"седалище\s+и\s+адрес\s+на\s+управление"
SEAT_ENDS = r"ЕИК|БУЛСТАТ|тел|e-?mail|ел\.\s*поща|представлява|вписан|регистрира|I\.\s"
#: Characters: a text's part that is read, what is looked at before and after a name, and where a number may stand.
READ, BEFORE, AFTER, NUMBER_WITHIN, SEAT_WITHIN, ROLE_WITHIN = 400_000, 250, 500, 300, 400, 400
#: Connecting words at most, and parties of a page.
CONNECTORS, PARTIES = 6, 20

#: Marks around names, and the shapes of a form and of capitalised words before it.
_OPEN, _CLOSE = "„“\"«", "”“\"»"
_MARK = re.compile(rf"(?:{'|'.join((*FORMS, *QUOTED_ONLY))})(?![A-Za-zА-Яа-я])")
_CAPITALISED = re.compile(r"(?<!\w)(?:[A-ZА-Я][\w.&'-]+\s+){0,5}[A-ZА-Я][\w.&'-]+$")
OCCURRENCE = "page string, domain string, quoted boolean, at int, name string, before string, after string, snippet string"


def names_in(text: str) -> list[tuple[bool, int, int, str]]:
    """(quoted, start, end, name) of each name with a legal form, in order; from each form back to what it belongs to.

    A quoted name stands between marks on one line, of 2 to 80 characters; any other one is up to six capitalised words.
    A form may be glued to a lower-case letter, never to a capital one, which would make it the end of a word."""
    out, free = [], 0
    for m in _MARK.finditer(text):
        form, begin = m.group(), m.start()
        glued = begin > 0 and text[begin - 1].isalnum()
        if glued and not text[begin - 1].islower():
            continue
        head = text[:begin].rstrip() if not glued else text[:begin]
        if not glued and head[-1:] in ("-", "–", ",") and head:
            head = head[:-1].rstrip()
        stem = head[:-1].rstrip() if head[-1:] in tuple(_CLOSE) and head else None
        if stem is not None:
            at = max(stem.rfind(c, max(0, len(stem) - 84)) for c in {*_OPEN, *_CLOSE})
            inner = stem[at + 1 :].strip() if at >= 0 and stem[at] in _OPEN else ""
            if 2 <= len(inner) <= 80 and "\n" not in inner:
                out.append((True, at, m.end(), f"{inner} {form}"))
                free = m.end()
            continue
        if form in QUOTED_ONLY:
            continue
        near = head[max(free, len(head) - 300) :]
        if (run := _CAPITALISED.search(near)) and (glued or begin > len(head)):
            out.append((False, len(head) - len(near) + run.start(), m.end(), f"{run.group()} {form}"))
            free = m.end()
    return [x for x in out if len(x[3]) <= 90 and x[3].split()[0].casefold() not in NO_NAME]


@F.arrow_udtf(returnType=OCCURRENCE)
class NameRows:
    """page, domain, text to a row a name."""

    def eval(self, batch):
        import pyarrow as pa

        cols = [[] for _ in range(8)]
        for page, domain, text in zip(*(batch.column(c).to_pylist() for c in ("page", "domain", "text")), strict=True):
            flat = " ".join((text or "").split())[:READ]
            for quoted, start, end, name in names_in(flat):
                row = (page, domain, quoted, start, name, flat[max(0, start - BEFORE) : start], flat[end : end + AFTER], flat[max(0, start - 120) : end + 160][:320])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), *(pa.string(),) * 4)
        yield pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(OCCURRENCE.split(", "), cols, kinds, strict=True)})


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), text, F.lit("\\E"))


def _passage(after: Column, reach: int) -> Column:
    """What follows a name until the next company or the next term that is defined; the first character may be a mark."""
    words = "|".join((*FORMS, *QUOTED_ONLY))
    stop = rf"(?iu)^(.(?:(?![{_OPEN}»]|(?<!\p{{L}})(?:{words})(?!\p{{L}})|означава|\bmeans\b).)*).*$"
    return F.regexp_replace(F.substring(after, 1, reach), "(?s)" + stop, "$1")


def runs_shop(before: Column, after: Column, domain: Column) -> Column:
    """Whether the words say that the company between `before` and `after` runs the shop of this domain.

    Before: a word of running and the address, both, the later one followed by at most six connecting words up to the
    name. After: both within the company's own passage, which ends at the next company or defined term."""
    site, left = F.lower(domain), F.lower(before)
    words = "|".join(re.escape(w) for w in RUNS)
    gap = F.regexp_replace(left, F.concat(F.lit(rf"(?su)^.*(?:{words}|"), _quoted(site), F.lit(")")), F.lit(""))
    between = F.filter(F.split(gap, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    joined = (F.size(between) <= CONNECTORS) & F.forall(between, lambda w: w.isin(*BETWEEN)) & ~_any(gap, DEFINES)
    said_before = F.contains(left, site) & _any(left, RUNS) & joined
    right = F.lower(_passage(after, ROLE_WITHIN))
    defined = F.regexp_replace(right, r"(?su)(?:" + "|".join(re.escape(w) for w in DEFINES) + ").*$", "")
    return F.coalesce(said_before | (F.contains(defined, site) & _any(defined, RUNS)), F.lit(False))


def stated_number(after: Column) -> Column:
    """The identifier that a label gives within 300 characters; null unless it holds."""
    # What may stand between the label and the number.
    label = rf"(?iu){NUMBER}(?:\s*/\s*БУЛСТАТ)?\s*(?:по\s+БУЛСТАТ)?[\s:№-]*(?:BG)?\s*([0-9]{{9}}(?:[0-9]{{4}})?)(?![\p{{L}}\p{{N}}_])"
    return identifier_or_null(F.nullif(F.regexp_extract(F.substring(after, 1, NUMBER_WITHIN), label, 1), F.lit("")))


def stated_seat(after: Column) -> Column:
    """The seat's address up to the next clause."""
    seat = rf"(?su)(?i:{SEAT})\s*(?i:в\s+)?[:–-]?\s*(.{{8,160}}?)(?=\s*[,;]?\s*(?i:{SEAT_ENDS})|\.\s+[A-Za-zА-Яа-я]|$)"
    return F.nullif(F.regexp_replace(F.regexp_extract(F.substring(after, 1, SEAT_WITHIN), seat, 1), r"^[ ,;]+|[ ,;]+$", ""), F.lit(""))


def _keys(passage: Column, pattern: str, key) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(passage, F.lit(pattern), 1), key), lambda x: x.isNotNull()))


def occurrences(pages: DataFrame) -> DataFrame:
    """page, domain, seq, name, eik, operator, snippet, address, phones, emails of every name; quoted ones come first."""
    told = NameRows(pages.select(F.col("page").cast("string"), F.col("domain").cast("string"), F.col("text").cast("string")).asTable())
    own = _passage(F.col("after"), AFTER)
    phone = r"(?iu)(?<!\p{L})(?:тел(?:ефон)?|gsm|моб(?:илен)?|phone|tel)\.?\s*[:№]?\s*(\+?[0-9][0-9 ()/.-]{5,18}[0-9])"
    return told.select(
        "page", "domain",
        F.struct((~F.col("quoted")).alias("bare"), F.col("at")).alias("seq"),
        "name",
        stated_number(F.col("after")).alias("eik"),
        runs_shop(F.col("before"), F.col("after"), F.col("domain")).alias("operator"),
        "snippet",
        stated_seat(F.col("after")).alias("address"),
        _keys(own, phone, phone_key).alias("phones"),
        _keys(own, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", email_key).alias("emails"),
    )


def parties(pages: DataFrame) -> DataFrame:
    """pages: page, domain, text. One row a party of a page: page, domain, nth, name, eik, operator, snippet, address,
    phones, emails.

    A party is a name (case aside) with its number. It has what its first place says, but one that says it runs the shop
    gives operator and snippet. The first 20 parties of a page count, and places up to the last one's first. Null texts
    and texts without a company have no rows; pages whose key repeats count as one page.
    """
    page = Window.partitionBy("page")
    # One exchange by page serves the windows and the aggregate.
    rows = occurrences(pages).repartition("page").withColumn("key", F.struct(F.lower("name").alias("n"), F.coalesce("eik", F.lit("")).alias("e")))
    rows = rows.withColumn("opens", F.min("seq").over(Window.partitionBy("page", "key")))
    rows = rows.withColumn("nth", F.dense_rank().over(page.orderBy("opens"))).withColumn("last", F.max(F.when(F.col("nth") == PARTIES, F.col("opens"))).over(page))
    rows = rows.where((F.col("nth") <= PARTIES) & (F.col("last").isNull() | (F.col("seq") <= F.col("last"))))
    first = lambda c: F.min_by(c, "seq").alias(c)
    said = F.min_by(F.when(F.col("operator"), F.col("snippet")), F.when(F.col("operator"), F.col("seq")))
    out = rows.groupBy("page", "key", "nth").agg(first("domain"), first("name"), first("eik"), F.bool_or("operator").alias("operator"), F.coalesce(said, F.min_by("snippet", "seq")).alias("snippet"), first("address"), first("phones"), first("emails"))
    return out.drop("key")


def own_contacts(contacts: DataFrame, named: DataFrame, resolved: DataFrame) -> DataFrame:
    """page, domain, eik, phones, emails: what a page tells of the company that the domain was resolved to.

    contacts: page, domain, phones, emails of the whole page. Where a page names more than one number, only the
    company's own passage counts; elsewhere the whole page does. resolved: domain, eik.
    """
    rows = named.join(resolved.select("domain", F.col("eik").alias("own_eik")), "domain", "left")
    mine = F.col("eik") == F.col("own_eik")
    per = rows.groupBy("page").agg(F.count_distinct("eik").alias("n"), F.min_by(F.when(mine, F.struct("phones", "emails")), F.when(mine, F.col("nth"))).alias("own"))
    none = F.array().cast("array<string>")
    many = F.coalesce(F.col("n") > 1, F.lit(False))
    out = contacts.join(per, "page", "left").join(resolved, "domain", "left")
    pick = lambda c: F.when(many, F.coalesce(F.col("own")[c], none)).otherwise(F.col(c)).alias(c)
    return out.select("page", "domain", "eik", pick("phones"), pick("emails"))


def named_as(named: DataFrame, resolved: DataFrame) -> DataFrame:
    """The parties whose number is the one that the page's domain was resolved to."""
    return named.join(resolved.select("domain", "eik"), ["domain", "eik"])
