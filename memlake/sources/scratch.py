"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session doesn't set it, a temporary folder is made and set, but
    only if driver and executors are one process: on a cluster each executor
    would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="memlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under ``spark.checkpoint.dir`` and read again.

    Iterative operators use it for what each of their levels reads: lineage
    stays short, and a lost executor costs a read.
    """
    path = f"{shared_dir(df.sparkSession)}/memlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._memlake_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote; only for tables that nothing unwritten depends on any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._memlake_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
