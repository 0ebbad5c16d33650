"""Organisations in the structured data of pages: JSON of any nesting, read as VARIANT and walked a level at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import identifier_or_null, vat_parts
from ..sources.tables import scoped, written

#: Kinds of organisation, and what is read of one.
KINDS = ("organization", "corporation", "localbusiness", "store", "onlinestore", "onlinebusiness", "organisation")
FIELDS = {"legal_name": "legalName", "name": "name", "tax_id": "taxID", "vat_id": "vatID", "identifier": "identifier", "url": "url", "same_as": "sameAs"}
#: Blocks of a page, characters of a block, members of a list, records of a page, and levels of nesting.
BLOCKS, CHARACTERS, MEMBERS, RECORDS, LEVELS = 10, 200_000, 50, 5, 64

_BLOCK = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _field(v: Column, name: str) -> Column:
    """A text as it is, a list as JSON; null for anything else."""
    one = F.try_variant_get(v, f'$["{name}"]', "variant")
    return F.when(_kind(one) == "STRING", F.try_variant_get(v, f'$["{name}"]', "string")).when(_kind(one) == "ARRAY", F.to_json(one))


@scoped
def organisations(pages: DataFrame, levels: int = LEVELS) -> DataFrame:
    """pages: page, html. One row an organisation: page, nth (from 1) and FIELDS, null where it has no text or list there.

    The first ten blocks of a page count; one that isn't JSON counts as nothing. Organisations stand at any depth (down to
    `levels`), also within each other; the first five of a page that tell a field are taken: a block before the next one,
    an object before what it holds, and of several members the last first (objects' members go by their names). Pages
    without any have no rows.
    """
    spark = pages.sparkSession
    block = F.posexplode(F.slice(F.regexp_extract_all("html", F.lit(_BLOCK), 1), 1, BLOCKS)).alias("b", "text")
    parsed = F.try_parse_json(F.substring(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")), 1, CHARACTERS))
    level = pages.select("page", block).select("page", F.array("b").alias("path"), parsed.alias("v")).where("v is not null")
    found = None
    for _ in range(levels):
        level = written(level.withColumn("kind", _kind(F.col("v"))).where("kind in ('OBJECT', 'ARRAY')"), "json-level")
        if level.isEmpty():
            break
        told = F.try_variant_get("v", '$["@type"]', "variant")
        types = F.when(_kind(told) == "ARRAY", F.try_variant_get(told, "$", "array<string>")).otherwise(F.array(F.try_variant_get(told, "$", "string")))
        own = F.exists(types, lambda t: F.coalesce(F.lower(t).isin(*KINDS), F.lit(False)))
        here = level.where("kind = 'OBJECT'").where(own).select("page", "path", *(_field(F.col("v"), n).alias(c) for c, n in FIELDS.items())).where(F.coalesce(*FIELDS).isNotNull())
        found = here if found is None else found.unionByName(here)
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = inner.where(f"kind = 'OBJECT' or pos < {MEMBERS}").select("page", F.concat("path", F.array(-F.col("pos"))).alias("path"), F.col("value").alias("v"))
    if found is None:
        return pages.select("page", F.lit(1).alias("nth"), *(F.lit(None).cast("string").alias(c) for c in FIELDS)).where("false")
    place = F.row_number().over(Window.partitionBy("page").orderBy("path"))
    return found.withColumn("nth", place).where(F.col("nth") <= RECORDS).select("page", "nth", *FIELDS)


def numbers(orgs: DataFrame) -> DataFrame:
    """page, nth, field, eik, foreign: what organisations say their numbers are. A VAT number of another country is foreign;
    otherwise an identifier that holds, with or without the country's prefix. Lists and numbers that don't hold are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in ("tax_id", "vat_id", "identifier")))).alias("n")
    rows = orgs.select("page", "nth", each).select("page", "nth", "n.*").where("raw is not null and not startswith(raw, '[')")
    parts = vat_parts(F.col("raw"))
    abroad = F.when(parts["country"] != "BG", F.concat(parts["country"], parts["number"]))
    eik = F.when(abroad.isNull(), identifier_or_null(F.coalesce(F.when(parts["country"] == "BG", parts["number"]), F.col("raw"))))
    return rows.select("page", "nth", "field", eik.alias("eik"), abroad.alias("foreign")).where("eik is not null or foreign is not null")
