"""Field profiles: values with their sources become one status a field; disclosure findings become a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flags import any_of, packed

#: What each finding adds to the score.
WEIGHTS = {"no_id": 50, "bad_id": 40, "no_address": 20, "no_contact": 20, "no_email": 10, "no_phone": 10, "no_company": 10, "names_differ": 10, "no_vat": 0}


def assess(merchants: DataFrame) -> DataFrame:
    """merchants: shop, eik, eik_ok, address, email, phone, company, n_names, vat. Adds findings, score, verdict."""
    no_mail, no_phone = F.col("email").isNull(), F.col("phone").isNull()
    tests = {
        "no_id": F.col("eik").isNull(),
        "bad_id": F.col("eik").isNotNull() & ~F.col("eik_ok"),
        "no_address": F.col("address").isNull(),
        "no_contact": no_mail & no_phone,
        "no_email": no_mail & ~no_phone,
        "no_phone": ~no_mail & no_phone,
        "no_company": F.col("company").isNull(),
        "names_differ": F.col("n_names") > 1,
        "no_vat": F.col("vat").isNull(),
    }
    findings = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))
    score = sum((F.when(t, F.lit(WEIGHTS[k])).otherwise(0) for k, t in tests.items()), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    verdict = F.when(score < 20, "ok").when(score < 50, "suspect").otherwise("noncompliant")
    return merchants.select("shop", findings.alias("findings"), score.cast("int").alias("score"), verdict.alias("verdict"))


def finding_counts(assessed: DataFrame) -> DataFrame:
    return assessed.select(F.explode("findings").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def first_per_field(pages: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The first value that isn't null, by page order, of each field."""
    return pages.groupBy(key).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def field_status(values: DataFrame) -> DataFrame:
    """values: domain, field, key, authority (1 strongest), authoritative, official, voice. One row a (domain, field)."""
    groups = values.groupBy("domain", "field", "key").agg(F.min("authority").alias("authority"), F.count(F.lit(1)).alias("sources"), F.max("authoritative").alias("verified"), F.max("official").alias("official"), F.count_distinct("voice").alias("voices"))
    best = F.min(F.struct("authority", (-F.col("sources")).alias("s"), "key", "verified", "official", "voices"))
    out = groups.groupBy("domain", "field").agg(best.alias("b"), F.count(F.lit(1)).alias("n_values"))
    status = F.when(F.col("n_values") > 1, "conflicting").when(F.col("b.verified"), "verified").when(F.col("b.official") | (F.col("b.voices") > 1), "corroborated").otherwise("published")
    return out.select("domain", "field", F.col("b.key").alias("value"), "n_values", status.alias("status"))


def shared_value_status(values: DataFrame) -> DataFrame:
    """Multi-valued fields; values as in field_status, with origin. A key that all origins have is the value, else the best
    one is: the strongest authority, then the most sources, then the smallest key. Conflicting where more than one origin
    shares no key; else verified, corroborated or published as the value's own sources make it."""
    # Copies meet first, dealt by all that tells rows apart; then a field's rows meet once, and what follows is by field.
    once = values.where("domain is not null and field is not null").groupBy("domain", "field", "key", "origin", "voice").agg(F.min("authority").alias("authority"), F.count(F.lit(1)).alias("n"), F.bit_or(packed([F.col("authoritative"), F.col("official")])).alias("said"))
    met = once.repartition("domain", "field")

    def first_of(*by: str) -> Column:
        """1 in one row of those that have the same values, in that of a null none."""
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("key", "origin", "voice"))
        return F.when(F.col(by[-1]).isNotNull() & (nth == 1), 1).otherwise(0)

    marked = met.withColumns({"new_voice": first_of("domain", "field", "key", "voice"), "new_in": first_of("domain", "field", "key", "origin"), "new_origin": first_of("domain", "field", "origin")})
    keys = marked.groupBy("domain", "field", "key").agg(F.sum("new_in").alias("in_origins"), F.sum("new_origin").alias("origins"), F.sum("new_voice").alias("voices"), F.min("authority").alias("authority"), F.sum("n").alias("sources"), F.bit_or("said").alias("said"))
    # A key that all origins have is in as many as any key is.
    order = ["authority", (-F.col("sources")).alias("s"), "key", any_of("said", 0).alias("verified"), any_of("said", 1).alias("official"), "voices"]
    out = keys.groupBy("domain", "field").agg(F.min(F.struct(*order)).alias("any"), F.min(F.struct((-F.col("in_origins")).alias("i"), *order)).alias("most"), F.sum("origins").alias("origins"), F.max("in_origins").alias("in_origins"), F.count(F.lit(1)).alias("n_values"))
    shared = (F.col("origins") > 1) & (F.col("in_origins") == F.col("origins"))
    out = out.withColumn("any_shared", shared).withColumn("b", F.when(shared, F.col("most").dropFields("i")).otherwise(F.col("any")))
    status = F.when((F.col("origins") > 1) & ~F.col("any_shared"), "conflicting").when(F.col("b.verified"), "verified").when(F.col("b.official") | (F.col("b.voices") > 1), "corroborated").otherwise("published")
    return out.select("domain", "field", F.col("b.key").alias("value"), "n_values", status.alias("status"))


def profile_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("field").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("verified", "corroborated", "published", "conflicting")), F.count(F.lit(1)).alias("n"))


def fuzzy_groups(values: DataFrame, agree, keys: list[str]) -> DataFrame:
    """values: domain, field, value, seq, authority. Adds leader: the value that each one is grouped with, in order of
    arrival: it joins the first group whose first value agrees with it, or begins one. agree is a Python predicate.

    Equal values are one before they are compared, with the earliest arrival; then each (domain, field) streams by, sorted,
    with its leaders as the state. A value costs as many comparisons as there are leaders before it; rows of one
    (domain, field) stay in one task, since each group depends on those before.
    """
    import pyarrow as pa

    def task(batches):
        own, leaders = None, []
        for b in batches:
            out = []
            for *key, value, _ in zip(*(b.column(i).to_pylist() for i in range(len(keys) + 2)), strict=True):
                if key != own:
                    own, leaders = key, []
                found = next((x for x in leaders if x == value or agree(x, value)), None)
                if found is None:
                    leaders.append(found := value)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys) + 1)), pa.array(out, pa.string())], names=[*keys, "value", "leader"])

    once = values.where("value is not null").groupBy(*keys, "value").agg(F.min("seq").alias("seq"))
    ddl = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys) + ", value string, leader string"
    led = once.repartition(*keys).sortWithinPartitions(*keys, "seq", "value").select(*keys, "value", "seq").mapInArrow(task, ddl)
    return values.join(led, [*keys, "value"], "left")


def words_agree(a: str, b: str) -> bool:
    """Half the words of the shorter, one at least, are shared."""
    x, y = set(a.lower().split()), set(b.lower().split())
    return bool(x and y) and len(x & y) >= max(1, min(len(x), len(y)) // 2)
