"""The sliding log as a stream: arrival order doesn't matter, a restart goes on, late requests are left out."""

import random

from pyspark.sql import functions as F

from tradelens.operators import state
from tradelens.streaming import limits

SCHEMA = "client string, ts timestamp, event_id long"


def test_a_restarted_stream_decides_as_the_batch_does(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.choice("abc"), 1_700_000_000 + i * 7 + rng.randrange(7), i) for i in range(600)]
    df = spark.createDataFrame(rows, "client string, at long, event_id long").select("client", F.timestamp_seconds("at").alias("ts"), "event_id")
    # Files overlap by less than the watermark's lateness, and each is in no order.
    parts = [df.where(f"event_id % 200 < 190 and event_id div 200 = {k} or event_id % 200 >= 190 and event_id div 200 = {k - 1}") for k in range(3)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = limits.admit_stream(stream, "client", 3, 100, "5 minutes")
    seen = []
    for k, part in enumerate(parts):
        part.orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k:  # the first two files are read by one run, the third after a restart
            seen.append(limits.run_to_table(told, f"{tmp_path}/work").collect())
    assert 0 < len(seen[0]) < len(seen[1])
    whole = df.where("not (event_id >= 590)")
    newest = whole.agg(F.max(F.unix_timestamp("ts"))).first()[0]
    want = {r.event_id: r.accepted for r in state.admit(whole, "client", "ts", "event_id", 3, 100).collect()}
    at = {r[2]: r[1] for r in rows}
    got = {r.event_id: r.accepted for r in seen[1]}
    assert got == {i: ok for i, ok in want.items() if at[i] <= newest - 300} and False in got.values()


def test_waiting_requests_are_arrays_and_answers_come_in_parts(monkeypatch):
    import numpy as np
    import pandas as pd

    class Rows:
        def __init__(self):
            self.rows = []

        def appendValue(self, row):
            self.rows.append(row)

        def appendList(self, rows):
            self.rows += rows

        def put(self, rows):
            self.rows = list(rows)

        def get(self):
            return iter(self.rows)

        def exists(self):
            return bool(self.rows)

        def clear(self):
            self.rows = []

    class Handle:
        def getListState(self, name, schema):
            return Rows()

        def registerTimer(self, at):
            pass

    class Times:
        def getCurrentWatermarkInMs(self):
            return 4000

    monkeypatch.setattr(limits, "ROWS", 100, raising=False)
    one = limits.SlidingLog(3, 500_000)
    one.init(Handle())
    rng = random.Random(4)
    at = [rng.randrange(5_000_000) for _ in range(1000)]
    for i in range(0, 1000, 250):
        one.handleInputRows(("a",), iter([pd.DataFrame({"ts": np.array(at[i : i + 250], "datetime64[us]"), "event_id": range(i, i + 250)})]), Times())
    assert len(one.waiting.rows) < 20  # not one for each request
    told = list(one.handleExpiredTimer(("a",), Times(), None))
    assert len(told) > 5 and max(map(len, told)) <= 100
    order = sorted((t, i) for i, t in enumerate(at) if t <= 4_000_000)
    want = limits.fold([], [t for t, _ in order], 3, 500_000)[1]
    assert [tuple(r) for p in told for r in p[["event_id", "accepted"]].itertuples(index=False)] == [(i, ok) for (_, i), ok in zip(order, want, strict=True)]
    assert len(one._waiting()[0]) == 1000 - len(order)
