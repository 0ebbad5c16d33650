"""Queries about limits over the whole log of events: users are clients, types are targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission
from ..sources.tables import table, work_path
from ..streaming import limits
from .registry import query

#: Requests and seconds: of a rolling day, a client, a target.
DAY, CLIENT, TARGET = (200, 86_400), (1, 7_200), (10, 21_600)

_PASS = "len(list_filter({0}, lambda x: e.t - x{2} <= {1}))"
#: One event after the other, with the logs that are young enough.
ADMITTED = f"""with recursive e as materialized (select row_number() over (order by ts, event_id) as i, event_id, epoch_us(ts) as t, user_id as c, event_type as g from events),
s as (select 0::bigint as i, null::bigint as event_id, null::varchar as decision, cast([] as struct(t bigint, c bigint)[]) as log, cast([] as struct(t bigint, g varchar)[]) as asked
union all
select i, event_id, case when n >= {DAY[0]} then 'day' when m >= {CLIENT[0]} then 'client' when k >= {TARGET[0]} then 'target' else 'accepted' end,
 case when n < {DAY[0]} and m < {CLIENT[0]} then list_append(log, {{'t': t, 'c': c}}) else log end, case when n < {DAY[0]} and m < {CLIENT[0]} and k < {TARGET[0]} then list_append(asked, {{'t': t, 'g': g}}) else asked end
 from (select *, len(log) as n, len(list_filter(log, lambda x: x.c = c and t - x.t <= {CLIENT[1]}000000)) as m, len(list_filter(asked, lambda x: x.g = g)) as k
  from (select e.*, list_filter(s.log, lambda x: e.t - x.t <= {DAY[1]}000000) as log, list_filter(s.asked, lambda x: e.t - x.t <= {TARGET[1]}000000) as asked from s join e on e.i = s.i + 1)))
select event_id, decision from s where i > 0"""


@query(ADMITTED)
def coupled_limits(spark, folder):
    return admission.admit(table(spark, folder, "events"), "user_id", "event_type", "ts", "event_id", DAY, CLIENT, TARGET)


#: One log a type of event; the newest events still wait for the watermark.
STREAMED = """with recursive e as materialized (select row_number() over (partition by event_type order by ts, event_id) as i, event_id, epoch_us(ts) as t, event_type as g from events),
s as (select 0::bigint as i, g, null::bigint as event_id, null::bigint as t, null::boolean as accepted, cast([] as bigint[]) as log from (select distinct g from e)
union all
select e.i, e.g, e.event_id, e.t, len(kept) < 8, case when len(kept) < 8 then list_append(kept, e.t) else kept end
 from (select s.i, s.g, e.event_id, e.t, list_filter(s.log, lambda x: e.t - x <= 7200000000) as kept from s join e on e.i = s.i + 1 and e.g = s.g) k join e on e.event_id = k.event_id)
select g as event_type, event_id, accepted from s where i > 0 and t // 1000 <= (select max(t) // 1000 - 600000 from e)"""


@query(STREAMED)
def rate_limit_stream(spark, folder):
    path = f"{folder}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(f"{path[:-1]}[t]")
    keyed = events.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return limits.run_to_table(limits.admit_stream(keyed, "event_type", 8, 7200), work_path(spark, "limits"))
