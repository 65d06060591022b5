"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.sources.scratch import drop, shared_dir

#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most 8-byte ids that are broadcast: 16 MB.
BROADCAST_IDS = 2_000_000


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read from there.

    This cuts the lineage: what an executor lost is read again, not computed
    again. Python workers get at most BATCH_BYTES at a time meanwhile.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memlake/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(BATCH_CONF)
        else:
            spark.conf.set(BATCH_CONF, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._memlake_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote; only for tables that nothing unwritten depends on any more.

    The driver's collector runs as well: Spark's cleaner then deletes the
    shuffle files of plans that are done.
    """
    spark = SparkSession.active()
    drop(*tables)
    for pause in (0.2, 0):  # the first turn lets go of Python's handles, the second of what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all other characters, also other letters, stay."""
    return F.translate(text, UPPER, UPPER.lower())


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", name: str = "side") -> DataFrame:
    """big joined with small, which has one row a key.

    small is written first, and big should be a table: then both sides of the
    join are plain shuffles, and Spark's skew join deals the rows of a hot key
    to several tasks. What stands above mustn't need the rows of a key
    together; write the result before it is grouped. Keys compare null-safe
    only if the caller has replaced nulls.
    """
    return big.join(written(small, name), keys, how)


ROW = "_memlake_row"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs, written, with a number for each row in column ROW: rows that repeat an id, or have none, can be told apart."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows of ``numbered`` whose number isn't among ``gone`` (column ROW), without the numbers."""
    return by_ids(rows, gone, ROW, "left_anti").drop(ROW)


def by_ids(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """rows whose ``column`` is among ids (``left_semi``) or isn't (``left_anti``); ids has one column of that name.

    Up to BROADCAST_IDS ids, counted first, go to all tasks, and the rows stay
    where they are; more are joined by a shuffle.
    """
    ids = written(ids.distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
