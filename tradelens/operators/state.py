"""Current state from snapshots and logs: upserts, retention, caches, budgets, request control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def upsert_domains(old: DataFrame, new: DataFrame) -> DataFrame:
    """domain, first_seen, last_checked: the first sight stays, the check is the newest."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, "domain", "full_outer").select("domain", F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"), F.coalesce("n.last_checked", "o.last_checked").alias("last_checked"))


def upsert_entities(old: DataFrame, new: DataFrame, tracked: list[str]) -> DataFrame:
    """Tracked columns take the new value where there is one; changed names those that both have and that differ."""
    joined = old.alias("o").join(new.alias("n"), "eik", "full_outer")
    merged = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in tracked]
    changed = F.array_compact(F.array(*(F.when(F.col(f"o.{c}") != F.col(f"n.{c}"), F.lit(c)) for c in tracked)))
    return joined.select("eik", *merged, F.array_join(changed, ",").alias("changed"))


def replace_people(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities that the new rows name have those people alone; the others keep theirs."""
    return old.join(new.select("eik").distinct(), "eik", "left_anti").unionByName(new)


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows by key: a new value that isn't null replaces the old one, but for the columns `keep`, whose first
    value stays."""
    rest = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(*((f"o.{c}", f"n.{c}") if c in keep else (f"n.{c}", f"o.{c}"))).alias(c)
    return o.join(n, keys, "full_outer").select(*keys, *map(pick, rest))


def link(old: DataFrame, new: DataFrame) -> DataFrame:
    """domain, eik, confidence, basis, linked_at: the newest statement of each link; the first time stays."""
    return merge(old, new, ["domain", "eik"], ("linked_at",))


def subscribe(old: DataFrame, new: DataFrame) -> DataFrame:
    """eik, provider, subscribed_at, last_event."""
    return merge(old, new, ["eik", "provider"], ("subscribed_at",))


def append_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence is only ever added to; rows that are there already (by all their columns) aren't added again."""
    return old.unionByName(new.join(old, [c for c in old.columns if c != "seen_at"], "left_anti"))


def put_records(records: DataFrame, entities: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new: eik, name, seat, status, record. The register's records with the new ones, and the entities they change."""
    return merge(records, new.select(*records.columns), ["eik"]), upsert_entities(entities, new, ["name", "seat", "status"])


def use_budget(usage: DataFrame, calls: DataFrame) -> DataFrame:
    """usage: day, n; calls: day. The count of each day with the calls added."""
    more = calls.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return usage.unionByName(more).groupBy("day").agg(F.sum("n").alias("n"))


def stale(entities: DataFrame, before: str, most: int) -> DataFrame:
    """entities: eik, checked. Those checked before a time (or never), oldest first."""
    return entities.where(F.col("checked").isNull() | (F.col("checked") < F.to_timestamp(F.lit(before)))).orderBy(F.asc_nulls_first("checked"), "eik").limit(most)


def reverified(entities: DataFrame, answers: DataFrame) -> DataFrame:
    """entities: eik, name, seat, status; answers: eik, state (confirmed, not_found, unavailable), name, seat. Confirmed
    answers give name, seat and the status of a registered number, others the status of none; outages change nothing."""
    told = answers.where("state <> 'unavailable'")
    good = F.col("state") == "confirmed"
    new = told.select("eik", F.when(good, F.col("name")).alias("name"), F.when(good, F.col("seat")).alias("seat"), F.when(good, "vat_registered").otherwise("not_in_vies").alias("status"))
    known = new.join(entities.select("eik"), "eik", "left_semi")
    return upsert_entities(entities, known, ["name", "seat", "status"])


def purge(tables: dict[str, DataFrame], as_of: str, days: int = 180, results: int = 600, cached: int = 7 * 86400) -> dict[str, DataFrame]:
    """What stays of domains (domain, last_checked), links (domain, eik), evidence (domain, eik), entities (eik),
    subscriptions (eik), roles (eik, person), people (person) and cache (kind, stored_at).

    Domains not checked for `days` go with their evidence and links; then entities that no link names go with all that
    hangs on them; then people without a role. Results live for `results` seconds, whatever else is cached for `cached`.
    """
    now = F.to_timestamp(F.lit(as_of))
    out = dict(tables)
    # What others hang on is computed once, as a table.
    out["domains"] = written(tables["domains"].where(F.col("last_checked") >= now - F.expr(f"interval {days} days")), "domains")
    for t in ("links", "evidence"):
        out[t] = tables[t].join(out["domains"].select("domain"), "domain", "left_semi")
    out["links"] = written(out["links"], "links")
    held = written(out["links"].select("eik").distinct(), "held")
    for t in ("entities", "subscriptions", "roles", "evidence"):
        out[t] = out[t].join(held, "eik", "left_semi")
    out["roles"] = written(out["roles"], "roles")
    out["people"] = tables["people"].join(out["roles"].select("person").distinct(), "person", "left_semi")
    age = F.unix_timestamp(now) - F.unix_timestamp("stored_at")
    out["cache"] = tables["cache"].where(~((F.col("kind") == "result") & (age > results)) & (age <= cached))
    return out


def evicted(jobs: DataFrame, most: int) -> DataFrame:
    """jobs: job, finished, updated. Finished jobs beyond the `most` newest jobs, oldest first to go; running ones stay.

    The newest are found by range partitions, not in one task."""
    placed = paged(jobs.where("finished"), [F.desc("updated"), F.asc("job")], 1)
    running = jobs.where("not finished").agg(F.count(F.lit(1)).alias("n")).first().n  # one row
    return placed.where(F.col("page") > max(0, most - running)).select("job")


def orphans(entities: DataFrame, links: DataFrame) -> DataFrame:
    return entities.join(links.select("eik"), "eik", "left_anti")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, by a partial aggregate (no window, so a hot key costs a row a task)."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(key).agg(best).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, ttl_seconds: int, values: list[str]) -> DataFrame:
    """Each left row with the newest right row of its key not after it and within the TTL (hits), or nulls.

    A fresh right row lies in the left row's stretch of `ttl_seconds` or in the one before, so each right row goes to
    two stretches, and keys are dealt out by stretch: a hot key is split by time. Right rows of one time: the largest
    values count. Rows without a time meet nothing.
    """
    stretch = lambda t: F.floor(F.unix_timestamp(t) / ttl_seconds)
    r = right.select(key, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(time).alias("_put"), *values).alias("_v")).where("_t is not null")
    r = r.withColumn("_part", F.explode(F.array(stretch("_t"), stretch("_t") + 1)))
    rest = [c for c in left.columns if c not in (key, time)]
    l_ = left.select(key, F.col(time).alias("_t"), F.lit(1).alias("_side"), *rest, stretch(time).alias("_part"))
    w = Window.partitionBy(key, "_part").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = l_.unionByName(r, allowMissingColumns=True).withColumn("_last", F.last("_v", True).over(w)).where("_side = 1")
    fresh = F.unix_timestamp("_t") - F.unix_timestamp("_last._put") < ttl_seconds
    return out.select(key, F.col("_t").alias(time), *rest, *(F.when(fresh, F.col(f"_last.{v}")).alias(v) for v in values), F.coalesce(fresh, F.lit(False)).alias("hit"))


def trailing_counts(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """n_trailing: events of the key within the `seconds` up to each event, itself and its peers included.

    What counts lies in the event's stretch of `seconds` or the one before, so each event goes to its own stretch and,
    as a mere time, to the next; a hot key is split by time. Events without a time count one another.
    """
    size = seconds * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    timed = events.withColumn("_at", at).withColumn("_part", F.floor(F.col("_at") / size))
    echo = timed.where("_part is not null").select(key, "_at", (F.col("_part") + 1).alias("_part"), F.lit(True).alias("_echo"))
    w = Window.partitionBy(key, "_part").orderBy("_at").rangeBetween(-size, 0)
    out = timed.unionByName(echo, allowMissingColumns=True).withColumn("n_trailing", F.count(F.lit(1)).over(w))
    return out.where("_echo is null").drop("_at", "_part", "_echo")


def _stretches(rows: DataFrame, key: str, micros: int) -> DataFrame:
    """rows with _at (microseconds) and _island: runs of stretches of `micros` of a key that all have rows.

    Between two islands a whole stretch is idle, so nothing that looks back by `micros` passes from one to the next.
    """
    timed = rows.withColumn("_part", F.floor(F.col("_at") / micros))
    by_key = Window.partitionBy(key).orderBy("_part")
    parts = timed.select(key, "_part").distinct().withColumn("_island", F.col("_part") - F.row_number().over(by_key))
    own, other = timed.alias("x"), parts.alias("y")
    met = own.join(other, F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")) & F.col("x._part").eqNullSafe(F.col("y._part")))
    return met.select("x.*", "y._island").drop("_part")


def admit(requests: DataFrame, key: str, time: str, order: str, most: int, seconds: int) -> DataFrame:
    """Sliding log with feedback: a request passes while fewer than `most` accepted ones are within the window.

    Requests stream by, sorted, through a fold whose state is the last `most` accepted times; no group is gathered.
    A key is dealt out by its idle gaps of a window and more, across which no state passes. Refused requests leave no
    trace; requests without a time are refused.
    """
    from ..streaming.limits import admitter

    window = seconds * 1_000_000
    rows = requests.select(key, order, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"))
    dealt = _stretches(rows, key, window + 1).repartition(key, "_island").sortWithinPartitions(key, "_island", "_at", order)
    kinds = rows.schema
    ddl = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in (key, order)) + ", accepted boolean"
    return dealt.select(key, order, "_island", "_at").mapInArrow(admitter(most, window), ddl)


def daily_budget(calls: DataFrame, time: str, order: str, most: int) -> DataFrame:
    """nth and allowed: the first `most` calls of each day. A call's rank is that within its minute and the number of
    calls in the day's minutes before, so a day is split into its 1440 minutes."""
    day, minute = F.to_date(time), F.date_trunc("minute", F.col(time))
    timed = calls.withColumn("_day", day).withColumn("_minute", minute)
    sizes = timed.groupBy("_day", "_minute").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_minute").alias("_m"), "_before")
    met = timed.join(sizes, F.col("_minute").eqNullSafe(F.col("_m")))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_minute").orderBy(time, order))
    return met.withColumn("nth", nth).withColumn("allowed", F.col("nth") <= most).drop("_day", "_minute", "_m", "_before")


def job_state(events: DataFrame, job: str, stage: str, time: str, order: str) -> DataFrame:
    """The furthest stage, the last event's type and how many came, of each job."""
    return events.groupBy(job).agg(F.max(stage).alias("stage"), F.max_by("event_type", F.struct(time, order)).alias("last_type"), F.count(F.lit(1)).alias("n_events"))


def paged(rows: DataFrame, order: list, size: int) -> DataFrame:
    """rows with their page of `size` in a total order: numbered by range partitions, each from its offset."""
    ranged = written(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_p")), "ranges")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))  # a row a partition
    offsets = counts.select("_p", (F.sum("_size").over(Window.orderBy("_p")) - F.col("_size")).alias("_offset"))
    number = F.col("_offset") + F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_p").withColumn("page", F.ceil(number / size).cast("int")).drop("_p", "_offset")
