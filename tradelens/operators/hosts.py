"""Hosts by captured answers: registrable domains by a rule table, name records, fingerprints, registration dates, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import suffixes


def registrable_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts: host; rules: suffix, kind (rule, wildcard, exception). Adds domain: one label more than the public suffix.

    An exception beats the others, then the longest suffix; a wildcard's suffix has one label more than its row; without
    a rule the last label is public. A host that is a suffix itself has none. Suffixes meet rules by equality.
    """
    each = hosts.select("host").distinct().select("host", F.posexplode(suffixes(F.col("host"))).alias("at", "suffix"))
    met = each.join(rules, "suffix")
    # at counts the labels before the suffix; the public suffix begins at label `start`.
    start = F.when(F.col("kind") == "exception", F.col("at") + 1).when(F.col("kind") == "wildcard", F.col("at") - 1).otherwise(F.col("at"))
    best = met.withColumn("start", start).where("start >= 0").groupBy("host").agg(F.min_by("start", F.struct((F.col("kind") != "exception").alias("late"), "start")).alias("start"))
    own = F.split("host", r"\.")
    first = F.coalesce("start", F.size(own) - 1)
    domain = F.when(first > 0, F.array_join(F.slice(own, first, F.size(own) - first + 1), "."))
    return hosts.join(best, "host", "left").withColumn("domain", domain).drop("start")


def dns_table(answers: DataFrame, most: int = 10) -> DataFrame:
    """answers: host, type, data. One row a (host, type): the first `most` distinct values in order, joined."""
    one = answers.select("host", "type", F.lower("data").alias("data")).distinct()
    return one.groupBy("host", "type").agg(F.array_join(F.slice(F.sort_array(F.collect_list("data")), 1, most), ",").alias("values"))


def fingerprints(answers: DataFrame) -> DataFrame:
    """answers: host, type, data, seq. The first CNAME, else the addresses in order: hosts that answer alike share it."""
    cname = F.min_by(F.when(F.col("type") == "CNAME", F.lower("data")), F.when(F.col("type") == "CNAME", F.col("seq")))
    addresses = F.array_join(F.sort_array(F.collect_set(F.when(F.col("type").isin("A", "AAAA"), F.col("data")))), ",")
    return answers.groupBy("host").agg(F.coalesce(cname, F.nullif(addresses, F.lit(""))).alias("fingerprint"))


def real_hosts(hosts: DataFrame, probes: DataFrame) -> DataFrame:
    """hosts: domain, host, fingerprint; probes: domain, fingerprint of a name that can't exist. Those that answer, and not
    as the wildcard does."""
    met = hosts.join(probes.select("domain", F.col("fingerprint").alias("_p")), "domain", "left")
    return met.where(F.col("fingerprint").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("_p"))).drop("_p")


def registration(answers: DataFrame) -> DataFrame:
    """answers: domain, status (of the answer), body (its JSON). state (ok, not_found, unavailable), registrar, the dates of
    three events, the domain's states and its first eight name servers; who registered it isn't read.

    A registrar is an entity of that role; its name is the value of the last "fn" in its card, an array of properties whose
    fourth member is the value. Of several registrars the last one with a name counts. Bodies that aren't JSON objects are
    unavailable."""
    entity = "array<struct<roles:array<string>,vcardArray:string>>"
    kind = f"struct<events:array<struct<eventAction:string,eventDate:string>>,entities:{entity},status:array<string>,nameservers:array<struct<ldhName:string>>>"
    d = answers.select("domain", F.col("status").alias("code"), F.try_parse_json("body").isNotNull().alias("json"), F.from_json("body", kind).alias("d"))
    good = (F.coalesce("code", F.lit(0)) == 200) & F.coalesce("json", F.lit(False)) & F.col("d").isNotNull()
    last = lambda rows: F.when(F.size(rows) > 0, F.element_at(rows, -1))
    when = lambda action: F.try_to_timestamp(last(F.filter("d.events", lambda e: e["eventAction"] == action))["eventDate"])

    def card(e: Column) -> Column:
        properties = F.from_json(F.get(F.from_json(e["vcardArray"], "array<string>"), F.lit(1)), "array<array<string>>")
        return last(F.transform(F.filter(properties, lambda x: F.get(x, F.lit(0)) == "fn"), lambda x: F.get(x, F.lit(3))))

    names = F.transform(F.filter("d.entities", lambda e: F.coalesce(F.array_contains(e["roles"], "registrar"), F.lit(False))), card)
    own = lambda c: F.when(good, c)
    return d.select(
        "domain",
        F.when(good, "ok").when(F.col("code") == 404, "not_found").otherwise("unavailable").alias("state"),
        own(last(F.filter(names, lambda x: x.isNotNull()))).alias("registrar"),
        own(when("registration")).alias("registered"),
        own(when("expiration")).alias("expires"),
        own(when("last changed")).alias("changed"),
        own(F.coalesce("d.status", F.array().cast("array<string>"))).alias("states"),
        own(F.slice(F.coalesce(F.col("d.nameservers.ldhName"), F.array().cast("array<string>")), 1, 8)).alias("name_servers"),
    )


def archived_copy(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """wanted: url, at; snapshots: url, stamp (14 digits), status, body. The newest good copy not after `at`, or none."""
    good = snapshots.where((F.col("status") == 200) & F.col("stamp").rlike("^[0-9]{14}$")).withColumn("_t", F.to_timestamp("stamp", "yyyyMMddHHmmss"))
    met = wanted.join(good.select("url", "_t", "stamp"), "url").where("_t <= at").groupBy("url", "at").agg(F.max("stamp").alias("stamp"))
    return wanted.join(met, ["url", "at"], "left").join(snapshots.where("status = 200").select("url", "stamp", "body").dropDuplicates(["url", "stamp"]), ["url", "stamp"], "left")
