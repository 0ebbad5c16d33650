"""Published answers against what was found: coverage, shortfalls, false alarms, gaps, the published worklist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = ("found", "not_found", "conflicting", "unavailable")


def coverage(truth: DataFrame, found: DataFrame) -> DataFrame:
    """truth: shop, field, published, value; found: shop, field, value (null: nothing readable). One row a (shop, field).

    Published: an agreeing value is found; only nulls or no row, unavailable or not_found; else conflicting. Not
    published: any value conflicts.
    """
    met = truth.alias("t").join(found.withColumn("_row", F.lit(1)).alias("f"), ["shop", "field"], "left")
    agrees = F.max(F.coalesce(F.col("f.value") == F.col("t.value"), F.lit(False)))
    got = met.groupBy("shop", "field").agg(F.max("t.published").alias("published"), agrees.alias("agrees"), F.count("f.value").alias("n_values"), F.count("f._row").alias("n_rows"))
    kind = F.when(F.col("published") & F.col("agrees"), "found").when(F.col("n_values") > 0, "conflicting").when(F.col("published") & (F.col("n_rows") > 0), "unavailable").otherwise("not_found")
    return got.select("shop", "field", kind.alias("coverage"))


def crosstab(rows: DataFrame) -> DataFrame:
    """field and a count of each coverage."""
    return rows.groupBy("field").agg(*(F.count_if(F.col("coverage") == c).alias(f"n_{c}") for c in COVERAGE), F.count(F.lit(1)).alias("n"))


def reproduced(shortfalls: DataFrame, reported: DataFrame, bridge: DataFrame) -> DataFrame:
    """shortfalls: shop, kind; reported: shop, code; bridge: kind, code. Adds reproduced: a code of the kind was reported."""
    met = shortfalls.join(bridge, "kind", "left").join(reported.distinct().withColumn("_hit", F.lit(True)), ["shop", "code"], "left")
    return met.groupBy("shop", "kind").agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("reproduced"))


def false_alarms(shortfalls: DataFrame, reported: DataFrame, bridge: DataFrame) -> DataFrame:
    """Reported codes that no shortfall of the shop accounts for."""
    return reported.distinct().join(shortfalls.join(bridge, "kind").select("shop", "code"), ["shop", "code"], "left_anti")


def worklist(rows: DataFrame, most: int = 10) -> DataFrame:
    """rows: shop, code, severity (1 worst), observed. A shop's distinct codes by severity, worst first, `most` of them
    as JSON, with counts and the last sight.

    A code is one row a shop before codes are gathered, so a list is as long as there are codes.
    """
    codes = rows.groupBy("shop", "code").agg(F.min("severity").alias("severity"), F.count(F.lit(1)).alias("times"), F.max("observed").alias("observed"))
    listed = F.slice(F.sort_array(F.collect_list(F.struct("severity", "code", "times"))), 1, most)
    out = codes.groupBy("shop").agg(listed.alias("l"), F.count(F.lit(1)).alias("n_codes"), F.sum("times").alias("n_rows"), F.max("observed").alias("observed"))
    return out.select("shop", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["severity"], x["code"], x["times"])), ",").alias("codes"), F.to_json("l").alias("json"), "n_codes", "n_rows", "observed")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    rows.write.mode("overwrite").json(path)
