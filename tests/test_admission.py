"""Coupled limits against a plain replay, whatever the stretches, and odd rows."""

import collections
import random

import pytest

from tradelens.operators import admission


def replay(rows, day, client, target):
    """What each limit says, one request after the other."""
    logs, out = collections.defaultdict(list), {}

    def full(key, at, limit):
        logs[key] = [t for t in logs[key] if at - t <= limit[1]]
        return len(logs[key]) >= limit[0]

    for order, at, who, what in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        if full("day", at, day):
            out[order] = "day"
        elif full(("client", who), at, client):
            out[order] = "client"
        else:
            logs["day"].append(at)
            logs["client", who].append(at)
            out[order] = "target" if full(("target", what), at, target) else "accepted"
            if out[order] == "accepted":
                logs["target", what].append(at)
    return out | {r[0]: "untimed" for r in rows if r[1] is None}


@pytest.mark.parametrize("rows", [90, 10_000])
def test_decisions_are_those_of_one_fold(spark, rows):
    size, rng = rows, random.Random(11)
    rows = [(i, rng.randrange(600), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None])) for i in range(400)]
    rows += [(900, None, "a", "x"), (901, 0, "a", "x"), (902, 0, "a", "x")]
    limits = (20, 90), (4, 30), (3, 40)
    df = spark.createDataFrame(rows, "id long, at long, who string, what string").selectExpr("id", "timestamp_seconds(at) as at", "who", "what")
    got = {r.id: r.decision for r in admission.admit(df, "who", "what", "at", "id", *limits, rows=size).collect()}
    want = replay(rows, *limits)
    assert got == want and set(want.values()) == {"day", "client", "target", "accepted", "untimed"}
    assert admission.admit(df.where("false"), "who", "what", "at", "id").collect() == []


def test_a_full_day_is_passed_over_and_rounds_fold_few_stretches(spark, monkeypatch):
    import pyarrow as pa

    read = []

    class Clients:
        """A column that tells how many of its values were looked at."""

        def __init__(self, column):
            self.column = column

        def __getitem__(self, i):
            read.append(i)
            return self.column[i]

        def to_pylist(self):
            read.extend(range(len(self.column)))
            return self.column.to_pylist()

    class Batch:
        def __init__(self, b):
            self.b, self.schema, self.num_rows = b, b.schema, b.num_rows

        def column(self, i):
            return Clients(self.b.column(i)) if i == 3 else self.b.column(i)

    kind = pa.list_(pa.struct([("at", pa.int64()), ("client", pa.string())]))
    n, second = 5000, 1_000_000
    b = pa.RecordBatch.from_arrays([pa.array([0] * (n + 1)), pa.array([None, *range(n)], pa.int64()), pa.array([-(2**63), *(i * second // 10 for i in range(n))]), pa.array([None, *(str(i) for i in range(n))]), pa.nulls(n + 1, kind)], names=["stretch", "order", "at", "client", "log"])
    out = [r for x in admission.coupled((5, 60), (9, 60))([Batch(b)]) for r in x.to_pylist()]
    passed = [r["order"] for r in out if r["decision"] == "passed"]
    want = replay([(i, i / 10, str(i), None) for i in range(n)], (5, 60), (9, 60), (n, 1))
    assert passed == [i for i, x in want.items() if x != "day"] and len(out) == n + 1
    assert len(read) < 100
    # Rounds fold at most as many stretches as tasks run at once, once each was folded.
    sizes = []
    monkeypatch.setattr(admission, "written", lambda df, tag, own=admission.written: (lambda out: (tag == "todo" and sizes.append(out.count()), out)[1])(own(df, tag)))
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 2)
    rows = spark.range(400).selectExpr("id", "timestamp_seconds(id) as at", "cast(id % 3 as string) as who", "'x' as what")
    got = {r.id: r.decision for r in admission.admit(rows, "who", "what", "at", "id", (4, 30), (2, 30), (9, 5), rows=50).collect()}
    assert got == replay([(i, i, str(i % 3), "x") for i in range(400)], (4, 30), (2, 30), (9, 5))
    assert max(sizes) == 2
