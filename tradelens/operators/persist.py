"""What a check leaves in the store, and the job that keeps the store fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store
from . import state

#: Days after which an entity's official facts are told again, and providers that an entity is subscribed to.
REVERIFY_DAYS, PROVIDERS = 30, ("vat-poll", "register")


def persist(store: Store, checks: DataFrame, source: str | None = None, batch: int | None = None) -> bool:
    """One commit of a batch of checks; False where this batch was persisted before.

    checks: domain, url, at, status, eik, verified (by an official source), name, seat, entity_status, confidence,
    basis, site (the acquisition's state), people (name, role), evidence (tier, url, claim, content_hash). Of several checks
    of a domain the newest counts. Only a verified company becomes an entity, with its link, subscriptions and people;
    an official fact that differs from the stored one is audited. Evidence is added once, whenever it was seen; a site that
    could not be read is evidence of that.
    """
    base = store.state()
    if source is not None and store.applied(source, batch, base):
        return False
    old = {t: store.read(t, base) for t in store.tables}
    new = checks.groupBy("domain").agg(F.max_by(F.struct(*[c for c in checks.columns if c != "domain"]), "at").alias("c")).select("domain", "c.*")
    known = new.where("verified and eik is not null")
    domains = state.merge(old["domains"], new.select("domain", "url", F.col("at").alias("first_seen"), F.col("at").alias("last_checked"), "status"), ["domain"], ("first_seen",))

    facts = known.groupBy("eik").agg(F.max_by(F.struct("name", "seat", F.col("entity_status").alias("status"), F.col("at").alias("checked")), "at").alias("f")).select("eik", "f.*")
    entities = state.upsert_entities(old["entities"], facts, ["name", "seat", "status", "checked"])
    differs = F.filter(F.split("changed", ","), lambda c: (c != "") & (c != "checked"))
    audit = entities.where(F.size(differs) > 0).select(F.col("checked").alias("at"), F.lit("official_record_changed").alias("action"), "eik", F.array_join(differs, ",").alias("detail"))

    links = state.link(old["links"], known.select("domain", "eik", "confidence", "basis", F.col("at").alias("linked_at")))
    providers = F.explode(F.array(*map(F.lit, PROVIDERS))).alias("provider")
    subscriptions = state.subscribe(old["subscriptions"], facts.select("eik", providers, F.col("checked").alias("subscribed_at"), F.lit("active").alias("last_event")))
    people = state.replace_people(old["people"], known.where("size(people) > 0").select("eik", F.explode("people").alias("p")).select("eik", "p.name", "p.role").distinct())

    told = new.select("domain", F.when(F.col("verified"), F.col("eik")).alias("eik"), F.explode("evidence").alias("e"), "at").select("domain", "eik", "e.tier", "e.url", "e.claim", "e.content_hash", F.col("at").alias("seen_at"))
    unread = new.where("site <> 'ok'").select("domain", F.when(F.col("verified"), F.col("eik")).alias("eik"), F.lit("company_source").alias("tier"), "url", F.concat(F.lit("direct acquisition: "), "site").alias("claim"), F.lit(None).cast("string").alias("content_hash"), F.col("at").alias("seen_at"))
    seen = told.unionByName(unread)
    keys = [c for c in seen.columns if c != "seen_at"]
    every = old["evidence"].unionByName(seen).groupBy(*keys).agg(F.min("seen_at").alias("seen_at"))  # equal but for the time is the same, nulls too

    changes = {"domains": domains, "entities": entities, "links": links, "subscriptions": subscriptions, "people": people, "evidence": every, "audit": old["audit"].unionByName(audit)}
    return store.commit(changes, base, source, batch)


def sink(store: Store, source: str):
    """For writeStream.foreachBatch: each batch of checks is persisted once, also where a restart hands it over again."""
    return lambda checks, batch: persist(store, checks, source, batch) and None


def entity(store: Store, eik: str) -> DataFrame:
    """The stored entity of an identifier: no row where there is none."""
    return store.read("entities").where(F.col("eik") == eik)


def refresh(store: Store, answers: DataFrame, records: DataFrame, as_of: str, most: int = 20, days: int = REVERIFY_DAYS) -> dict[str, int]:
    """The periodic job, as one commit: the `most` entities whose facts are oldest are told again by answers (eik, state,
    name, seat; outages change nothing), records that a register delivered (eik, name, seat, status, record) go in, and what
    retention no longer allows goes out. Counts of each."""
    base = store.state()
    old = {t: store.read(t, base) for t in store.tables}
    now = F.to_timestamp(F.lit(as_of))
    before = F.date_format(now - F.expr(f"interval {days} days"), "yyyy-MM-dd HH:mm:ss")
    limit = store.spark.range(1).select(before).first()[0]
    due = state.stale(old["entities"], limit, most).select("eik")
    told = answers.join(due, "eik", "left_semi")
    fresh = state.reverified(old["entities"].drop("checked"), told)
    times = old["entities"].select("eik", "checked").join(told.where("state <> 'unavailable'").select("eik", now.alias("n")), "eik", "left").select("eik", F.coalesce("n", "checked").alias("checked"))
    entities = fresh.join(times, "eik", "left")
    held, entities2 = state.put_records(old["records"], entities.select("eik", "name", "seat", "status"), records)
    entities2 = entities2.join(entities.select("eik", "checked"), "eik", "left").select("eik", "name", "seat", "status", F.when(F.col("eik").isNotNull(), F.coalesce("checked", now)).alias("checked"))

    # The register's own records hold an entity as a link does.
    kept = {"domains": old["domains"], "links": old["links"], "evidence": old["evidence"], "entities": entities2, "subscriptions": old["subscriptions"], "roles": old["people"].withColumn("person", F.col("name")), "people": old["people"].select(F.col("name").alias("person")).distinct(), "cache": store.spark.createDataFrame([], "kind string, stored_at timestamp")}
    left = state.purge(kept, as_of)
    stays = left["entities"].unionByName(entities2.join(records.select("eik"), "eik", "left_semi")).distinct()
    gone = old["domains"].join(left["domains"].select("domain"), "domain", "left_anti").count()
    changed = told.where("state <> 'unavailable'").count()
    count = {"reverified": changed, "records": records.count(), "purged_domains": gone}
    note = store.spark.range(1).select(now.alias("at"), F.lit("refreshed").alias("action"), F.lit(None).cast("string").alias("eik"), F.lit(json_of(count)).alias("detail"))
    changes = {"entities": stays, "records": held, "domains": left["domains"], "links": left["links"], "evidence": left["evidence"], "subscriptions": left["subscriptions"], "people": left["roles"].select("eik", "name", "role"), "audit": old["audit"].unionByName(note)}
    store.commit(changes, base)
    return count


def json_of(count: dict[str, int]) -> str:
    return ", ".join(f"{k} {v}" for k, v in count.items())
