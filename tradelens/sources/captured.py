"""Readers of captured bytes: bodies in any charset, PDF text, register XML, JSON files, an inbox of files."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .pdf import pdf_text

#: The parts of a seat's address in a deed, in the order they are written.
SEAT = ("Settlement", "PostCode", "HousingEstate", "Street", "StreetNumber", "Block", "Entrance", "Floor", "Apartment")
#: Fields of a deed that name a person.
PEOPLE = ("Manager", "Representative", "Representative101", "Representative102", "Representative103", "Procurator")
#: States of a deed.
STATES = {"N": "registered", "E": "registered", "C": "closed", "L": "closed"}

#: An element of a message: its number, those of the elements around it, its path of local names, text and attributes.
_FACT = "struct<seq: int, up: array<int>, path: string, text: string, attributes: map<string, string>>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml_facts(messages: DataFrame, root: str) -> DataFrame:
    """messages: body (XML). One row an element named `root`: its attributes, and the elements below in document order as
    facts (_FACT), by Arrow. Elements that the message erases are left out with all they hold; what isn't XML has no rows.
    Names count without their namespaces; blank texts are null."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"attributes map<string, string>, facts array<{_FACT}>"
    kinds = to_arrow_schema(StructType.fromDDL(ddl))

    def below(top: ElementTree.Element) -> list[dict]:
        out, todo = [], [(e, "", ()) for e in reversed(top)]
        while todo:
            e, path, up = todo.pop()
            if e.get("FieldOperation") == "Erase":
                continue
            here = f"{path}/{_local(e.tag)}"
            out.append({"seq": len(out), "up": list(up), "path": here, "text": (e.text or "").strip() or None, "attributes": list(e.attrib.items())})
            todo += [(x, here, (*up, len(out) - 1)) for x in reversed(e)]
        return out

    def task(batches):
        for b in batches:
            rows = []
            for body in b.column(0).to_pylist():
                try:
                    whole = ElementTree.fromstring(body) if body else None
                except ElementTree.ParseError:
                    continue
                if whole is not None:
                    rows += [{"attributes": list(e.attrib.items()), "facts": below(e)} for e in whole.iter() if _local(e.tag) == root]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return messages.select(F.col("body").cast("string")).mapInArrow(task, ddl)


def _at(path: str, within: Column | None = None) -> Column:
    """The facts whose path ends so, of those within an element of this number where one is given."""
    return F.filter("facts", lambda f: f["path"].endswith(f"/{path}") & (F.lit(True) if within is None else F.array_contains(f["up"], within)))


def _last(values: Column) -> Column:
    told = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(told) > 0, F.element_at(told, -1))


def _texts(path: str, within: Column | None = None) -> Column:
    return F.filter(F.transform(_at(path, within), lambda f: f["text"]), lambda t: t.isNotNull())


def deeds(messages: DataFrame) -> DataFrame:
    """messages: body, the XML of a register's message. One row a deed: eik, name, legal_form, status, address, capital,
    registered, website, phone, email, people (name, role). Of a field that stands more than once the last one that says
    something counts, of dates the first one. Only the fields named here are read; a person's number never is."""
    attribute = lambda name: F.element_at("attributes", F.lit(name))
    status = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair)), F.coalesce(attribute("DeedStatus"), F.lit(""))), F.lit("unknown"))
    seat = F.transform(_at("Seat"), lambda s: F.nullif(F.concat_ws(", ", *(F.get(_texts(f"Seat/Address/{part}", s["seq"]), F.lit(0)) for part in SEAT)), F.lit("")))
    funds = F.transform(_at("Funds"), lambda f: F.when(f["text"].isNotNull(), F.trim(F.concat_ws(" ", f["text"], F.element_at(f["attributes"], F.lit("currency"))))))

    def person(f: Column) -> Column:
        role = F.get(F.transform(_at("Person", f["seq"]), lambda p: F.nullif(F.trim(F.element_at(p["attributes"], F.lit("Position"))), F.lit(""))), F.lit(0))
        return F.struct(F.get(_texts("Person/Name", f["seq"]), F.lit(0)).alias("name"), F.coalesce(role, F.substring_index(f["path"], "/", -1)).alias("role"))

    people = F.transform(F.filter("facts", lambda f: F.substring_index(f["path"], "/", -1).isin(*PEOPLE)), person)
    return xml_facts(messages, "Deed").select(
        attribute("UIC").alias("eik"),
        attribute("CompanyName").alias("name"),
        attribute("LegalForm").alias("legal_form"),
        status.alias("status"),
        _last(seat).alias("address"),
        _last(funds).alias("capital"),
        F.get(_texts("EntryDate"), F.lit(0)).alias("registered"),
        *(_last(_texts(f"Seat/Contacts/{tag}")).alias(column) for column, tag in (("website", "URL"), ("phone", "Phone"), ("email", "EMail"))),
        F.filter(people, lambda p: p["name"].isNotNull()).alias("people"),
    )


#: How far into a body its own charset is looked for, and what bodies without one are in.
PRESCAN, USUAL = 4096, "windows-1251"
_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_META = re.compile(rb"<meta[^>]{0,500}?charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", re.IGNORECASE)
_HEADER = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", re.IGNORECASE)


def encodings(body: bytes, content_type: str | None) -> Iterator[str]:
    """The encodings to try, surest first: a byte order mark, what the transport says, what the markup says, UTF-8, the
    usual one of the language."""
    for mark, name in _BOMS:
        if body.startswith(mark):
            yield name
    if m := _HEADER.search(content_type or ""):
        yield m[1]
    if m := _META.search(body[:PRESCAN]):
        yield m[1].decode("ascii")
    yield "utf-8"
    yield USUAL


def decode_body(body: bytes | None, content_type: str | None) -> str | None:
    """The text in the first encoding that tells every byte, else in UTF-8 with replacements."""
    if body is None:
        return None
    for name in encodings(body, content_type):
        try:
            return codecs.decode(body, name, "strict").removeprefix("﻿")
        except (LookupError, UnicodeDecodeError, TypeError):
            pass
    return body.decode("utf-8", "replace")


def with_text(fetches: DataFrame) -> DataFrame:
    """fetches: body, content_type, ... Adds text (of a PDF, or the decoded body) and text_error (why there is none, or that
    a PDF's text is cut short). By Arrow, a file at a time."""

    @F.pandas_udf("text string, error string")
    def read(body, kind):
        import pandas as pd

        def one(b, k):
            if b is None:
                return None, "no_body"
            b = bytes(b)
            return pdf_text(b) if b.startswith(b"%PDF-") else (decode_body(b, k), None)

        return pd.DataFrame([one(b, k) for b, k in zip(body, kind, strict=True)], columns=["text", "error"], dtype=object)

    return fetches.withColumn("_read", read("body", "content_type")).select("*", "_read.text", F.col("_read.error").alias("text_error")).drop("_read")


def sitemap(xml: Column, words: tuple[str, ...] = (), most: int | None = None) -> Column:
    """The addresses of a sitemap in order, each once; those that hold one of the words, `most` of them, where given."""
    found = F.array_distinct(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1))
    if words:
        found = F.filter(found, lambda u: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(u), w)))
    return found if most is None else F.slice(found, 1, most)


def json_file(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document a file; the schema is given, so nothing is read to infer it."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_answers(answers: DataFrame, schema: str, path: str = "$") -> DataFrame:
    """answers: status, body, ... Adds rows (an array of the schema at the path of the body's JSON) and state: found or
    not_found, and unavailable where the answer is no success or no JSON."""
    raw = F.get_json_object("body", path)
    rows = F.from_json(raw, f"array<{schema}>")
    good = F.coalesce(F.col("status").between(200, 299), F.lit(False)) & F.col("body").isNotNull() & F.try_parse_json("body").isNotNull()
    state = F.when(~good, "unavailable").when(F.coalesce(F.size(rows), F.lit(0)) > 0, "found").otherwise("not_found")
    return answers.withColumn("rows", F.when(good, rows)).withColumn("state", state)


def inbox(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """A stream over files put in a folder, `most` a trigger, each deleted once it is taken."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", most).option("cleanSource", "delete").load(path)
