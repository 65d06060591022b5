"""Keyed state machines over a stream, with timers: claims that free themselves and life cycles that are forgotten.

Both run in event time. Rows of a key are taken in the order of their time
within a batch; a timer that the watermark passes fires also for keys that
get no more rows. What a timer would do and what a later row finds are the
same, so results don't depend on how rows fall into batches, as long as no row
is older than the newest of the batches before (such rows come too late).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlake.streaming.journal import TRANSITIONS

STALE_MS = 15 * 60 * 1000
FORGET_MS = 24 * 3600 * 1000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(rows: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """A key's rows in order of the first two columns; without frames between, which cost more than the few rows of a key."""
    return sorted((r for frame in rows for r in zip(*(frame[c].tolist() for c in columns), strict=True)), key=lambda r: r[:2])


class Claims(StatefulProcessor):
    """One holder a key. A claim is freed by its holder's completion, or by itself ``stale_ms`` after it was made."""

    def __init__(self, stale_ms: int = STALE_MS):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "worker long, since long")

    def _free(self, worker: int, since: int) -> tuple:
        return (-1, since + self.stale_ms, worker, "free", True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        # the state is read and written once a key and batch, not once a row: each access is a message to the JVM
        held = before = tuple(self.held.get()) if self.held.exists() else None
        for at, seq, worker, kind in _ordered(rows, "ms", "seq", "worker", "kind"):
            if held and held[1] + self.stale_ms <= at:
                out.append(self._free(*held))
                held = None
            if kind == "claim":
                ok = held is None
                held = (worker, at) if ok else held
            else:
                ok = held is not None and held[0] == worker
                held = None if ok else held
            out.append((seq, at, worker, kind, ok))
        if held != before:
            if before:
                self.handle.deleteTimer(before[1] + self.stale_ms)
            if held:
                self.held.update(held)
                self.handle.registerTimer(held[1] + self.stale_ms)
            else:
                self.held.clear()
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            worker, since = self.held.get()
            if since + self.stale_ms == expiredTimerInfo.getExpiryTimeInMs():
                self.held.clear()
                yield self._rows(key, [self._free(worker, since)])

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["seq", "ms", "worker", "kind", "accepted"])
        return frame.assign(key=key[0])[["key", "seq", "ms", "worker", "kind", "accepted"]]

    def close(self) -> None:
        pass


class LifeCycle(StatefulProcessor):
    """States by ``TRANSITIONS``, from created on. ``forget_ms`` after it came to an end a key is forgotten, and begins anew with its next row."""

    def __init__(self, forget_ms: int = FORGET_MS):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        # the state is read and written once a key and batch, not once a row: each access is a message to the JVM
        wants = _ordered(rows, "ms", "seq", "wanted")
        state, since = before = tuple(self.now.get()) if self.now.exists() else ("created", wants[0][0])
        for at, seq, wanted in wants:
            if state not in TRANSITIONS and since + self.forget_ms <= at:
                state, since = "created", at
            ok = wanted in TRANSITIONS.get(state, ())
            if ok:
                state, since = wanted, at
            out.append((key[0], seq, ok, state))
        self.now.update((state, since))
        if (state, since) != before:
            if before[0] not in TRANSITIONS:
                self.handle.deleteTimer(before[1] + self.forget_ms)
            if state not in TRANSITIONS:
                self.handle.registerTimer(since + self.forget_ms)
        yield pd.DataFrame(dict(zip(("key", "seq", "accepted", "state"), map(list, zip(*out, strict=True)), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            state, since = self.now.get()
            if state not in TRANSITIONS and since + self.forget_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.now.clear()
        yield from ()

    def close(self) -> None:
        pass


CLAIMED = "key string, seq long, ms long, worker long, kind string, accepted boolean"
CYCLED = "key string, seq long, accepted boolean, state string"


def _stateful(rows: DataFrame, processor: StatefulProcessor, out: str) -> DataFrame:
    timed = rows.withColumn("ts", F.timestamp_millis(F.col("ms"))).withWatermark("ts", "0 seconds")
    return timed.groupBy("key").transformWithStateInPandas(processor, out, "Append", "EventTime")


def claims(attempts: DataFrame, stale_ms: int = STALE_MS) -> DataFrame:
    """Rows CLAIMED for a stream of attempts (key, seq, time ms, worker, kind claim or complete), and a row of kind 'free', with seq -1, for each claim that freed itself."""
    return _stateful(attempts, Claims(stale_ms), CLAIMED)


def life_cycles(wanted: DataFrame, forget_ms: int = FORGET_MS) -> DataFrame:
    """Rows CYCLED for a stream of wanted states (key, seq, time ms, wanted)."""
    return _stateful(wanted, LifeCycle(forget_ms), CYCLED)


def into_table(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str) -> None:
    """Runs a stateful stream over all that is there into Parquet files under target, then stops; starts where it stopped before."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    query.awaitTermination()
