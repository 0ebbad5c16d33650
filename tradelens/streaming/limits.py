"""Request control over a stream: the sliding log with feedback of operators.state.admit, kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def fold(log: list[int], times: list[int], most: int, window: int) -> tuple[list[int], list[bool]]:
    """Which of the sorted times pass, and the log of the last `most` accepted ones."""
    out = []
    for t in times:
        ok = len(log) < most or t - log[0] > window
        out.append(ok)
        if ok:
            log = [*log[-(most - 1) :], t] if most > 1 else [t]
    return log, out


def admitter(most: int, window: int):
    """fold() over Arrow batches sorted by key, island, time, order (columns in the order key, order, island, time);
    the log goes along from batch to batch and starts anew with each island."""
    import pyarrow as pa

    def task(batches):
        own, log = None, []
        for b in batches:
            keys, islands, times = (b.column(k).to_pylist() for k in (0, 2, 3))
            ok = []
            for key, island, t in zip(keys, islands, times, strict=True):
                if (key, island) != own:
                    own, log = (key, island), []
                if t is None:
                    ok.append(False)
                    continue
                log, one = fold(log, [t], most, window)
                ok += one
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=[*b.schema.names[:2], "accepted"])

    return task


#: Requests of a row of the waiting state, and of a frame of answers, at most.
ROWS = 10_000


class SlidingLog(StatefulProcessor):
    """The sliding log of one key. Requests wait until the watermark has passed them, so that decisions follow event time,
    whatever order they came in; then the log of accepted ones decides. They wait as arrays, a row of the state for each
    part that came, and are sorted as arrays: 16 bytes a request and as many for its place. A timer a window after the
    last accepted request lets the state go."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at long")
        self.waiting = handle.getListState("waiting", "at array<bigint>, event_id array<bigint>")

    def _wait(self, at: np.ndarray, ids: np.ndarray) -> None:
        for i in range(0, len(at), ROWS):
            self.waiting.appendValue((at[i : i + ROWS].tolist(), ids[i : i + ROWS].tolist()))
        self.handle.registerTimer(-(-int(at.min()) // 1000))  # one timer: when it fires, all that the watermark has passed is told

    def _waiting(self) -> tuple[np.ndarray, np.ndarray]:
        """Times and ids of all that waits, by time, of equal times by id."""
        parts = [(np.array(r[0], np.int64), np.array(r[1], np.int64)) for r in self.waiting.get()] if self.waiting.exists() else []
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, at))
        return at[order], ids[order]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if len(part):
                self._wait(part["ts"].astype("datetime64[us]").astype("int64").to_numpy(), part["event_id"].to_numpy(np.int64))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        at, ids = self._waiting()
        n = int(np.searchsorted(at, passed, side="right"))
        log = [x[0] for x in self.log.get()] if self.log.exists() else []
        if n:
            for i in range(0, n, ROWS):
                to = min(n, i + ROWS)
                log, ok = fold(log, at[i:to].tolist(), self.most, self.window)
                yield pd.DataFrame({"key": [key[0]] * len(ok), "event_id": ids[i:to], "accepted": ok})
            self.waiting.clear()
            if n < len(at):
                self._wait(at[n:], ids[n:])
            self.log.put([(t,) for t in log])
            self.handle.registerTimer((log[-1] + self.window) // 1000 + 1)
        elif log and not len(at) and passed - log[-1] > self.window:
            self.log.clear()

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, key: str, most: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """requests: key, ts, event_id. One row a request: key, event_id, accepted, once the watermark, `late` behind the
    newest request, has passed it; requests that come later than that are left out.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Restarted from its checkpoint, the
    stream goes on with the log and the waiting requests that it had.
    """
    timed = requests.select(F.col(key).alias("key"), "ts", "event_id").withWatermark("ts", late)
    kind = requests.schema[key].dataType.simpleString()
    out = timed.groupBy("key").transformWithStateInPandas(SlidingLog(most, seconds * 1_000_000), f"key {kind}, event_id long, accepted boolean", "Append", "EventTime")
    return out.withColumnRenamed("key", key)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream gives for all that its source holds now, as a table below `folder`, where its checkpoint is too: a
    second call goes on where the first one ended."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
