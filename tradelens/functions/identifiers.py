"""Company identifiers, VAT numbers, phones and e-mails: validation and comparison keys, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate groups of an identifier.
SEPARATORS = " \t\n\r-./:,;()[]"
#: Weights of the published check-digit rule, first and second pass.
NINE, NINE_AGAIN = (1, 2, 3, 4, 5, 6, 7, 8), (3, 4, 5, 6, 7, 8, 9, 10)
THIRTEEN, THIRTEEN_AGAIN = (2, 7, 3, 5), (4, 9, 5, 7)


def strip_separators(value: Column) -> Column:
    return F.translate(F.trim(value), SEPARATORS, "")


def _digit(number: Column, from_right: int) -> Column:
    return F.floor(number / 10**from_right).cast("bigint") % 10 if from_right else number % 10


def _check(number: Column, size: int, weights: tuple[int, ...], again: tuple[int, ...]) -> Column:
    """The check digit after the `size` digits of a number; plain arithmetic on one bigint."""
    total = lambda ws: sum((_digit(number, size - 1 - i) * w for i, w in enumerate(ws)), F.lit(0)) % 11
    once, twice = total(weights), total(again)
    return F.when(once < 10, once).otherwise(twice % 10)


def identifier_kind(value: Column) -> Column:
    """9 or 13 for digit strings of that length, else null."""
    d = strip_separators(value)
    return F.when(d.rlike("^([0-9]{9}|[0-9]{13})$"), F.length(d))


def identifier_valid(value: Column) -> Column:
    """Whether the check digits hold; false for null and for any other shape.

    The digits are bound to a lambda's variable, since each weight names them: written out, the expression would hold the
    value dozens of times, and whatever the value is made of as often.
    """

    def holds(d: Column) -> Column:
        part = lambda first, n: F.substring(d, first, n).try_cast("bigint")
        nine = lambda x: _check(x, 8, NINE, NINE_AGAIN)
        last = lambda x: _check(x, 4, THIRTEEN, THIRTEEN_AGAIN)
        right = F.transform(F.array(part(1, 8)), nine)[0] == part(9, 1)
        return F.when(d.rlike("^[0-9]{9}$"), right).when(d.rlike("^[0-9]{13}$"), right & (F.transform(F.array(part(9, 4)), last)[0] == part(13, 1)))

    return F.coalesce(F.transform(F.array(strip_separators(value)), holds)[0], F.lit(False))


def identifier_or_null(value: Column) -> Column:
    return F.when(identifier_valid(value), strip_separators(value))


def vat_parts(value: Column) -> Column:
    """struct(country, number); null where the shape is wrong or a BG number is neither 9 nor 13 digits."""
    d = F.upper(strip_separators(value))
    country, number = F.regexp_extract(d, "^([A-Z]{2})[0-9A-Z]{2,13}$", 1), F.regexp_extract(d, "^[A-Z]{2}([0-9A-Z]{2,13})$", 1)
    good = (country != "") & ((country != "BG") | number.rlike("^([0-9]{9}|[0-9]{13})$"))
    return F.when(good, F.struct(country.alias("country"), number.alias("number")))


def vat_key(value: Column) -> Column:
    """BG and 9 or 13 digits, whether or not the prefix was written; null otherwise."""
    number = F.regexp_extract(F.upper(F.regexp_replace(value, r"[\s.-]", "")), r"^(?:BG)?([0-9]{9}|[0-9]{13})$", 1)
    return F.when(number != "", F.concat(F.lit("BG"), number))


def phone_key(value: Column) -> Column:
    """E.164 of a +359 number with 7 to 9 national digits; null otherwise.

    The country is written +359, 00359, or 359 before at least eight digits, or it is the one of a trunk 0 in a number of
    8 to 10 digits. One trunk 0 that stayed after the country is dropped. Short codes are no numbers.
    """
    d = F.regexp_replace(value, "[^0-9+]", "")
    rest = lambda n: F.substring(d, n + 1, 30)
    national = F.when(d.startswith("+359"), rest(4)).when(d.startswith("00359"), rest(5)).when(d.startswith("359") & (F.length(d) >= 11), rest(3))
    national = national.when(d.startswith("0") & F.length(d).between(8, 10), rest(1))
    national = F.regexp_replace(national, "^0", "")
    return F.when(national.rlike("^[0-9]{7,9}$"), F.concat(F.lit("+359"), national))


def email_key(value: Column) -> Column:
    """Lower case, without scheme, query and brackets or marks at the ends; null where it isn't an address or names a file
    of a page (an image, a style, a script)."""
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"^mailto:", ""), r"\?.*$", "")
    v = F.regexp_replace(v, r"^[ .,;:<>()\[\]]+|[ .,;:<>()\[\]]+$", "")
    return F.when(v.rlike(r"^[a-z0-9._%+-]{1,64}@[a-z0-9.-]{1,253}\.[a-z]{2,10}$") & ~v.rlike(r"\.(png|jpg|jpeg|gif|svg|webp|css|js)$"), v)


def phone_display(value: Column) -> Column:
    """A key's digits grouped: 2 of the capital and 700, 800, 900 by themselves, else a prefix of two digits; null for no
    phone."""
    key = phone_key(value)
    n = F.substring(key, 5, 9)
    capital, rate = n.startswith("2"), F.substring(n, 1, 3).isin("700", "800", "900")
    head = F.when(capital, 1).when(rate, 3).otherwise(2)
    middle = F.when(rate, 2).otherwise(3)
    parts = [F.substring(n, F.lit(1), head), F.substring(n, head + 1, middle), F.nullif(F.substring(n, head + middle + 1, F.lit(9)), F.lit(""))]
    return F.when(key.isNotNull(), F.concat_ws(" ", F.lit("+359"), *parts))


#: Mail hosts that anyone can use.
FREE_MAIL = ("gmail.com", "abv.bg", "mail.bg", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "proton.me")
#: Hosts of public bodies and couriers that legal texts name.
INSTITUTIONS = ("cpdp.bg", "kzp.bg", "nra.bg", "nap.bg", "europa.eu", "government.bg", "gov.bg", "mvr.bg", "bnb.bg", "econt.com", "speedy.bg")
#: Mailboxes of a function and not of a person.
ROLES = (
    "info office contact contacts kontakt kontakti sales support help shop store order orders poruchki zakazi hello admin service obsluzhvane "
    "reklamacii reklamacia returns billing accounting legal privacy gdpr dpo noreply no-reply web webshop online marketing team enquiries enquiry "
    "inquiries"
).split()


def email_kind(email: Column, site: Column) -> Column:
    """corporate (the site's own host), institution, corporate (a function's mailbox, or one that holds the site's name),
    published_contact (any other), in this order; null for no address."""
    key = email_key(email)
    host, local = F.substring_index(key, "@", -1), F.substring_index(key, "@", 1)
    own = (host == site) | host.endswith(F.concat(F.lit("."), site))
    public = F.exists(F.array(*map(F.lit, INSTITUTIONS)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    label = bare(F.substring_index(site, ".", 1))
    named = (F.length(label) >= 5) & F.contains(bare(local), label)
    role = local.rlike(rf"^({'|'.join(ROLES)})([._-]?[a-z0-9_]*)?$")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(key.isNull(), None).when(yes(own), "corporate").when(public, "institution").when(role | yes(named), "corporate").otherwise("published_contact")


def is_free_mail(email: Column) -> Column:
    return F.substring_index(email_key(email), "@", -1).isin(*FREE_MAIL)


def email_hash(email: Column) -> Column:
    """What stands for an address where it must not be told: 16 hex digits."""
    return F.substring(F.sha2(F.lower(F.trim(email)), 256), 1, 16)
