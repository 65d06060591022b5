"""What runs beside the store: a writer that retries and keeps what it drops, and what is due when."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS, DROPPED_MOST = 2, 100


def retrying(write: Callable[[DataFrame, int], None], dropped: Callable[[DataFrame, int, str], None], attempts: int = ATTEMPTS, most: int = DROPPED_MOST) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch is written, tried again on an error, and at last given to ``dropped`` (its first rows, with the error), so the stream goes on."""

    def run(batch: DataFrame, number: int) -> None:
        error = ""
        for _ in range(attempts):
            try:
                write(batch, number)
                return
            except Exception as e:  # noqa: BLE001  any error of the sink counts
                error = str(e)
        dropped(batch.limit(most).withColumn("error", F.lit(error[:500])), number, error)

    return run


def daily_jobs(last: DataFrame, now) -> DataFrame:
    """``job, due``: decay daily at 02:00, reflection daily at 03:00, pruning on Sundays at 02:30, by the time each ran last (job, ran_at)."""
    day = F.date_trunc("day", now)
    back = F.dayofweek(now) - 1
    latest = (
        F.when(F.col("job") == "decay", day + F.expr("interval 2 hours"))
        .when(F.col("job") == "reflection", day + F.expr("interval 3 hours"))
        .when(F.col("job") == "prune", F.date_sub(day, back).cast("timestamp") + F.expr("interval 150 minutes"))
    )
    step = F.when(F.col("job") == "prune", F.expr("interval 7 days")).otherwise(F.expr("interval 1 day"))
    slot = F.when(latest > now, latest - step).otherwise(latest)
    return last.select("job", (F.col("ran_at").isNull() | (F.col("ran_at") < slot)).alias("due"))
