"""Whether two names or two addresses mean the same, as columns: true, false, or null where one says nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms, longer ones first where one begins another.
FORMS = ("еоод", "оод", "еад", "ад", "ет", "eood", "ood", "ead", "ad", "et", "ltd", "llc", "gmbh", "inc")
#: Words of addresses that don't tell one from another.
ADDRESS_STOP = ("гр", "ул", "бул", "жк", "ж", "к", "бл", "вх", "ет", "ап", "no", "str", "st", "bul", "city", "floor", "office", "офис", "област", "община")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}0-9]+)"), 1)


def legal_form(name: Column) -> Column:
    """The first legal form by the order of FORMS that is a word of the name, in capitals; null without one."""
    return F.upper(F.get(F.array_intersect(F.array(*map(F.lit, FORMS)), words(name)), F.lit(0)))


def name_words(name: Column) -> Column:
    """The distinct words of more than two characters, legal forms left out."""
    return F.filter(F.array_distinct(words(name)), lambda w: (F.length(w) > 2) & ~w.isin(*FORMS))


def name_matches(a: Column, b: Column) -> Column:
    """Half the words of the shorter name, one at least, are shared; null where either has none."""
    x, y = name_words(a), name_words(b)
    least = F.least(F.size(x), F.size(y))
    need = F.greatest(F.lit(1), F.floor(least / 2))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) >= need)


def glued(name: Column) -> Column:
    """The name's letters and digits without spaces and legal forms."""
    return F.array_join(F.filter(words(name), lambda w: ~w.isin(*FORMS)), "")


def names_agree(a: Column, b: Column) -> Column:
    """name_matches(), or the same letters once spaces, marks and forms are gone."""
    same = (glued(a) == glued(b)) & (glued(a) != "")
    return F.when(same, True).otherwise(name_matches(a, b))


def same_company(a: Column, b: Column) -> Column:
    """Strict: one name's words all are the other's; false where either has none."""
    x, y = name_words(a), name_words(b)
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & inside, F.lit(False))


def address_key(address: Column) -> Column:
    """The distinct words of an address, without stop words and four-digit postal codes."""
    return F.filter(F.array_distinct(words(address)), lambda w: ~w.isin(*ADDRESS_STOP) & ~w.rlike("^[0-9]{4}$"))


def addresses_agree(a: Column, b: Column) -> Column:
    """All words of the shorter are shared, or four fifths of them and two at least; null where either has none."""
    x, y = address_key(a), address_key(b)
    small, both = F.least(F.size(x), F.size(y)), F.size(F.array_intersect(x, y))
    return F.when(small > 0, (both == small) | (both >= F.greatest(F.lit(2), F.floor(small * 0.8))))


def wording_key(name: Column) -> Column:
    """What two spellings of one name share: its words, joined."""
    return F.array_join(words(name), " ")


def display_name(name: Column) -> Column:
    """Quotes out, one space between words, no dash before a legal form."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, r"[\"'„“”«»]", " "), r"\s+", " "))
    return F.regexp_replace(plain, rf"(?iu)\s*[-–—]\s*({'|'.join(FORMS)})$", " $1")


def display_address(address: Column) -> Column:
    """A space after abbreviations and commas, none before; long words of capitals only get their first."""
    spaced = F.regexp_replace(F.regexp_replace(address, r"(?u)(\p{L})\.(?=[\p{L}0-9])", "$1. "), r"\s*,\s*", ", ")
    parts = F.split(F.trim(F.regexp_replace(spaced, r"\s+", " ")), " ")
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike(r"^\p{Lu}{4,},?$"), F.initcap(w)).otherwise(w)), " ")


def clean_name(name: Column) -> Column:
    """What follows the last colon: labels that stayed before a name go."""
    return F.when(F.contains(name, F.lit(":")), F.trim(F.substring_index(name, ":", -1))).otherwise(name)


def clean_address(address: Column) -> Column:
    """The address without a label before it; the whole of it where nothing else would stay."""
    bare = F.trim(F.regexp_replace(address, r"(?isu)^.*?адрес(?:\s+на\s+управление)?\s*[:–-]\s*", ""), F.lit(" ,;"))
    return F.coalesce(F.nullif(bare, F.lit("")), address)


def plausible_name(name: Column) -> Column:
    """A name of at most 90 characters with a legal form; not one that holds digits and ends in the sole trader's form
    (a line about goods). False for null."""
    goods = F.upper(name).rlike(r"(?u)(?<!\p{L})ЕТ[^\p{L}0-9]*$") & name.rlike("[0-9]")
    return F.coalesce((name != "") & (F.length(name) <= 90) & legal_form(name).isNotNull() & ~goods, F.lit(False))


#: Words and abbreviations of places.
PLACE = r"гр\.|град|ул\.|бул\.|ж\.?к\.?|кв\.|с\.|обл|област|шосе|път|площад|пл\.|зона"


def plausible_address(address: Column) -> Column:
    """10 to 300 characters with a digit and a word of places; false for null."""
    return F.coalesce(F.length(address).between(10, 300) & address.rlike("[0-9]") & address.rlike(f"(?iu)({PLACE})"), F.lit(False))


def core_name(name: Column) -> Column:
    """The words in capitals without quotes, dashes and legal forms: what a register is searched by."""
    parts = F.split(F.trim(F.regexp_replace(F.replace(F.upper(name), F.lit('"'), F.lit(" ")), r"\s+", " ")), " ")
    return F.array_join(F.filter(parts, lambda w: ~w.isin("ЕООД", "ООД", "ЕАД", "АД", "ЕТ", "-")), " ")
