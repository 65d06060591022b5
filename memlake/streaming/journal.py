"""The change journal as a stream: ordered intake, idempotent batches, state machines, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("added", "modified", "removed", "renamed", "git", "manifest")
# The event life cycle.
TRANSITIONS = {"created": {"in_progress", "completed", "failed", "abandoned"}, "in_progress": {"completed", "failed", "abandoned"}}


def changes(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of valid changes; a bounded number of files a batch."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return valid(raw)


def valid(rows: DataFrame) -> DataFrame:
    """Changes of a known kind; all but git and manifest need a path."""
    return rows.where(F.col("change").isin(*KINDS) & (F.col("path").isNotNull() | F.col("change").isin("git", "manifest")))


def drain(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Runs apply once for each batch that is there, then stops.

    A batch that failed is given again with the same id after a restart, so
    ``apply`` should replace what that id wrote before: at least once plus
    idempotent writes.
    """
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_batch(target: str) -> Callable[[DataFrame, int], None]:
    """apply for drain: a batch's rows replace the folder of its id."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return apply


def unchanged_dropped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Only the first row of each key (path and content hash): what was seen needs no work."""
    return rows.dropDuplicates(keys)


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling (or sliding) windows, with a watermark for late ones."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by user in sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def life_cycle(transitions: DataFrame) -> DataFrame:
    """Applies wanted states (event_id, seq, wanted) in order of seq; ``accepted`` says whether the machine allowed each."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "created"
        rows = pd.concat(list(batches)).sort_values("seq")
        accepted, after = [], []
        for wanted in rows["wanted"]:
            ok = wanted in TRANSITIONS.get(now, set())
            now = wanted if ok else now
            accepted.append(ok)
            after.append(now)
        state.update((now,))
        yield pd.DataFrame({"event_id": key[0], "seq": rows["seq"].to_numpy(), "accepted": accepted, "state": after})

    return transitions.groupBy("event_id").applyInPandasWithState(step, "event_id long, seq long, accepted boolean, state string", "state string", "append", GroupStateTimeout.NoTimeout)
