"""Data-subject requests, restricted fields, jobs that are under way, register rows, and values that a model offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def request_state(events: DataFrame) -> DataFrame:
    """events: request, seq, action (open, restrict, erase, resolve), field. The fold of a request's events in order, as
    aggregates: the last status, what is restricted, whether it is erased."""
    status = F.max_by(F.when(F.col("action") == "resolve", "resolved").otherwise("open"), F.when(F.col("action").isin("open", "resolve"), F.col("seq")))
    fields = F.array_join(F.sort_array(F.collect_set(F.when(F.col("action") == "restrict", F.col("field")))), ",")
    return events.groupBy("request").agg(F.coalesce(status, F.lit("open")).alias("status"), fields.alias("restricted"), F.max(F.col("action") == "erase").alias("erased"), F.count(F.lit(1)).alias("n_events"))


def without_restricted(fields: DataFrame, restrictions: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """fields: eik, field, value. Allowed fields alone, less those that a restriction (eik, field) names."""
    return fields.where(F.col("field").isin(*allowed)).join(restrictions, ["eik", "field"], "left_anti")


def in_flight(jobs: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """key, order, joined: whether a job that an earlier request of the key began still runs at the start.

    A request that joins begins no job, so this is a fold; it streams over rows sorted by key and start with one end
    time as its state. Requests without a start join nothing. Jobs of one key stay in one task.
    """
    import pyarrow as pa

    def task(batches):
        own, until = object(), None
        for b in batches:
            joined = []
            for k, s, e in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if k != own:
                    own, until = k, None
                hit = until is not None and s is not None and s < until
                joined.append(hit)
                if not hit and e is not None:
                    until = e
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(joined, pa.bool_())], names=[*b.schema.names[:2], "joined"])

    rows = jobs.select(key, order, F.unix_micros(F.col(start).cast("timestamp")).alias("_s"), F.unix_micros(F.col(end).cast("timestamp")).alias("_e"))
    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, order)) + ", joined boolean"
    return rows.repartition(key).sortWithinPartitions(key, "_s", order).mapInArrow(task, ddl)


def people_union(rows: DataFrame) -> DataFrame:
    """rows: eik, name, role, verified, seq. One row a name whatever its case, verified rows first, then the earliest."""
    best = F.max_by(F.struct("name", "role", "verified"), F.struct("verified", -F.col("seq"))).alias("b")
    return rows.groupBy("eik", F.lower("name").alias("_n")).agg(best).select("eik", "b.name", "b.role", "b.verified")


def declarations(domains: DataFrame, rows: DataFrame, most: int = 5) -> DataFrame:
    """domains: domain; rows: domain, platform, seq, owner. Rows that name the domain; if there are none, those whose
    platform does; `most` a domain, in order. Owners' identifiers are taken from their text."""
    named = rows.select(F.lower("domain").alias("_d"), F.lit(1).alias("priority"), "seq", "owner").unionByName(rows.select(F.lower("platform").alias("_d"), F.lit(2).alias("priority"), "seq", "owner"))
    met = domains.join(named, F.col("domain") == F.col("_d")).drop("_d")
    best = Window.partitionBy("domain").orderBy("priority", "seq")
    first = met.groupBy("domain").agg(F.min("priority").alias("_p"))
    out = met.join(first, "domain").where("priority = _p").withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    eik = F.nullif(F.regexp_extract("owner", r"(?:^|[^0-9])([0-9]{13}|[0-9]{9})(?:[^0-9]|$)", 1), F.lit(""))
    return out.select("domain", "seq", "priority", eik.alias("eik"))


def model_fill(profile: DataFrame, offers: DataFrame, page_values: DataFrame, most: int) -> DataFrame:
    """profile: domain, field, value, status; offers: domain, field, value; page_values: domain, value.

    Fields without a value whose status is not_found or unavailable take the offered value where a page of the domain
    holds it, the first `most` fields of a domain by name.
    """
    eligible = profile.where("value is null and status in ('not_found', 'unavailable')")
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("field"))
    asked = eligible.withColumn("_n", nth).where(F.col("_n") <= most).select("domain", "field")
    offered = asked.join(offers.groupBy("domain", "field").agg(F.min("value").alias("offer")), ["domain", "field"])
    backed = offered.join(page_values.select("domain", F.col("value").alias("offer")), ["domain", "offer"], "left_semi")
    out = profile.join(backed, ["domain", "field"], "left")
    return out.select("domain", "field", F.coalesce("value", "offer").alias("value"), F.when(F.col("offer").isNotNull(), "model").otherwise(F.col("status")).alias("status"))
