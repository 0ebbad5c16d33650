"""Admission of requests by several limits at once: the whole service's day, each client's window, each target's window.

The day's limit couples all requests: what it refuses leaves no trace in a client's log, so a client's later request may
pass. Decisions are made by speculation over stretches of time: every stretch is folded on its own, in parallel, from the
log that its predecessor ended with in the round before, until no stretch would begin otherwise than it did. Then every
decision is the one of a fold over all requests in order.
"""

from __future__ import annotations

from collections import defaultdict, deque
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scoped, written
from . import state

#: Requests of a rolling day, of a client and of a target, each with its seconds.
DAY, CLIENT, TARGET = (400, 86_400), (8, 300), (5, 600)


def coupled(day: tuple[int, int], client: tuple[int, int]):
    """A fold over Arrow batches sorted by stretch, time, order: columns stretch, order, at (microseconds), client, log (of
    the row that opens a stretch: times and clients of accepted requests). Each request's decision, and a row at each
    stretch's end with the log that it leaves; memory holds one log."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("at", pa.int64()), ("client", pa.string())]))
    (most, span), (own_most, own_span) = ((n, s * 1_000_000) for n, s in (day, client))
    keep = max(span, own_span)

    def task(batches):
        now, order_kind, log, days, own = None, None, deque(), deque(), defaultdict(deque)

        def take(t, who):
            log.append((t, who))
            days.append(t)
            own[who].append(t)

        def told():
            return [{"at": t, "client": c} for t, c in log]

        def rows(stretches, orders, decisions, logs):
            return pa.RecordBatch.from_arrays([pa.array(stretches, pa.int64()), orders, decisions, logs], names=["stretch", "order", "decision", "log"])

        def left(ended):
            return rows([x for x, _ in ended], pa.nulls(len(ended), order_kind), pa.nulls(len(ended), pa.string()), pa.array([x for _, x in ended], kind))

        for b in batches:
            stretches, ats, opens, order_kind = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(1).is_null().to_numpy(zero_copy_only=False), b.schema.field(1).type
            said, ended = np.full(b.num_rows, -1, np.int8), []
            bounds = [0, *(np.flatnonzero(np.diff(stretches)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for i, end in zip(bounds, bounds[1:], strict=False):
                if stretches[i] != now:
                    if now is not None:
                        ended.append((now, told()))
                    now = int(stretches[i])
                    for x in (log, days, own):
                        x.clear()
                while i < end:
                    if opens[i]:
                        for x in b.column(4)[i].as_py() or ():
                            take(x["at"], x["client"])
                        i += 1
                        continue
                    at = int(ats[i])
                    while log and at - log[0][0] > keep:
                        t, c = log.popleft()
                        while own[c] and own[c][0] <= t:
                            own[c].popleft()
                        if not own[c]:
                            del own[c]
                    while days and at - days[0] > span:
                        days.popleft()
                    if len(days) >= most:
                        # Until its oldest request is a day old, the day refuses all and nothing changes.
                        to = i + int(np.searchsorted(ats[i:end], days[0] + span, side="right")) if days else end
                        said[i:to] = 0
                        i = to
                        continue
                    who = b.column(3)[i].as_py()
                    mine = own.get(who, ())
                    while mine and at - mine[0] > own_span:
                        mine.popleft()
                    if len(mine) >= own_most:
                        said[i] = 1
                    else:
                        take(at, who)
                        said[i] = 2
                    i += 1
            here = np.flatnonzero(said >= 0)
            if len(here):
                decisions = pa.DictionaryArray.from_arrays(pa.array(said[here]), pa.array(["day", "client", "passed"])).cast(pa.string())
                yield rows(stretches[here], b.column(1).take(pa.array(here)), decisions, pa.nulls(len(here), kind))
            if ended:
                yield left(ended)
        if now is not None:
            yield left([(now, told())])

    return task


@scoped
def admit(requests: DataFrame, client: str, target: str, time: str, order: str, day: tuple[int, int] = DAY, per_client: tuple[int, int] = CLIENT, per_target: tuple[int, int] = TARGET, rows: int = 1_000_000) -> DataFrame:
    """order, decision of each request: untimed, day, client, target or accepted.

    Limits hold in this order, in each a request passes while fewer than so many accepted ones are so many seconds old or
    less. What the day or the client refuses leaves no trace; what the target refuses has counted for both by then.
    order tells requests apart and orders those of one time; those without a time are refused. A null client or target is
    one of its own. rows: requests of a stretch, about, which one task folds; any number gives the same decisions. While
    the day is full most of the time, each stretch hangs on the one before, and rounds are as many as stretches.
    """
    kind = requests.schema[order].dataType.simpleString()
    all_ = requests.select(F.col(order).alias("order"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(client).cast("string").alias("client"), F.col(target).cast("string").alias("target"))
    ranges = all_.where("at is not null").repartitionByRange(max(1, -(-requests.count() // rows)), "at")
    timed = written(ranges.withColumn("stretch", F.spark_partition_id().cast("long")), "requests")
    log = "array<struct<at: bigint, client: string>>"
    in_order = Window.orderBy("stretch")  # one row a stretch
    chain = timed.groupBy("stretch").agg(F.min("at").alias("begins")).withColumns({"next": F.lead("stretch").over(in_order), "then": F.lead("begins").over(in_order)})
    chain = written(chain, "stretches")
    begun = chain.select("stretch", F.array().cast(log).alias("log"))
    # A round folds the first stretches that would begin otherwise, as many as tasks run at once: only the very first one of
    # them is sure to be final, and all the others may have to be folded again.
    at_once = requests.sparkSession.sparkContext.defaultParallelism
    todo, folded, final, ends = begun, [], {}, None
    while True:
        numbers = [r.stretch for r in todo.select("stretch").collect()]  # of stretches, one for about `rows` requests
        # By their numbers, so that files of other stretches are not read.
        work = timed.where(F.col("stretch").isin(numbers)).select("stretch", "order", "at", "client", F.lit(None).cast(log).alias("log"))
        opening = todo.select("stretch", F.lit(None).cast(kind).alias("order"), F.lit(-(2**63)).alias("at"), F.lit(None).cast("string").alias("client"), "log")
        dealt = opening.unionByName(work).repartition("stretch").sortWithinPartitions("stretch", F.col("order").isNotNull(), "at", "order")
        new = written(dealt.mapInArrow(coupled(day, per_client), f"stretch long, order {kind}, decision string, log {log}"), "folded")
        final |= dict.fromkeys(numbers, len(folded))
        folded.append(new)
        left = new.where("order is null").select("stretch", "log")
        # What was not folded again stays as it was.
        ends = left if ends is None else written(ends.where(~F.col("stretch").isin(numbers)).unionByName(left), "ends")
        # A stretch begins with what its predecessor left, of which only what is young enough at its start counts.
        young = F.filter("log", lambda x: F.col("then") - x["at"] <= max(day[1], per_client[1]) * 1_000_000)
        handed = ends.join(chain.where("next is not null"), "stretch").select(F.col("next").alias("stretch"), young.alias("log"))
        other = handed.join(begun.withColumnRenamed("log", "was"), "stretch").where(~F.col("log").eqNullSafe(F.col("was"))).select("stretch", "log")
        todo = written(other.orderBy("stretch").limit(at_once), "todo")
        if todo.isEmpty():
            break
        begun = written(begun.join(todo.select("stretch"), "stretch", "left_anti").unionByName(todo), "begun")
    # Each stretch's decisions are those of the last round that folded it.
    rounds = [(new, [s for s, r in final.items() if r == i]) for i, new in enumerate(folded)]
    told = reduce(DataFrame.unionByName, [new.where(F.col("order").isNotNull() & F.col("stretch").isin(own)) for new, own in rounds if own] or [folded[0]])
    met = timed.join(told.select("order", "decision"), "order")
    passed = state.admit(met.where("decision = 'passed'").select("target", "order", F.timestamp_micros("at").alias("at")), "target", "at", "order", *per_target)
    final = F.when(F.col("decision") != "passed", F.col("decision")).when(F.col("accepted"), "accepted").otherwise("target")
    out = met.join(passed.select("order", "accepted"), "order", "left").select("order", final.alias("decision"))
    return out.unionByName(all_.where("at is null").select("order", F.lit("untimed").alias("decision"))).withColumnRenamed("order", order)
