"""The change journal drained with effects once: a content-hash gate and what it lets through, published together by batch.

Each batch becomes one version of a folder (``sources.versions``): the effects
of the batch, the new state of the gate, and the batch's number. A batch that
is given again, because the process died before the stream noted its end, finds
its number published and does nothing; one that died before publishing left
only folders that no version names, and is done anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.sources.versions import Versions

#: Folders of the gate's state, by hash of the path; a batch rewrites those that it touches.
BUCKETS = 16
STATE = "path string, hash string, seq long, bucket int"
#: Rows of a file of ``in_pieces``.
FILE_ROWS = 250_000
EFFECT = "seq long, path string, hash string, action string"


class Drain:
    """``apply`` is for foreachBatch, over changes (seq, path, hash; a null hash says that the path is gone)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.files, self.buckets = spark, Versions(spark, path), buckets

    def _rows(self, what: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for p in self.files.manifest()["parts"]:
            if p["what"] == what:
                own = self.files.load(p)
                if what == "state":
                    own = own.where(F.col("bucket").isin(*(set(p["buckets"]) & (buckets if buckets is not None else set(p["buckets"])))))
                out = out.unionByName(own)
        return out

    def state(self) -> DataFrame:
        return self._rows("state", STATE)

    def effects(self) -> DataFrame:
        """``seq, path, hash, action`` of all batches: index, refresh and retire."""
        return self._rows("effects", EFFECT)

    def apply(self, batch: DataFrame, number: int) -> None:
        manifest, base = self.files.manifest(), self.files.newest()
        if manifest["facts"].get("batch", -1) >= number:
            return
        rows = batch.select("seq", "path", "hash").withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))
        touched = {r[0] for r in rows.select("bucket").distinct().collect()}
        known = self._rows("state", STATE, touched)
        # a path's change is held against the one before it, the first against the state
        both = rows.withColumn("kept", F.lit(False)).unionByName(known.withColumn("kept", F.lit(True)))
        before = F.lag("hash").over(Window.partitionBy("path").orderBy(F.desc("kept"), "seq"))
        judged = both.withColumn("before", before).where("not kept and not (hash <=> before)")
        action = F.when(F.col("hash").isNull(), "retire").when(F.col("before").isNull(), "index").otherwise("refresh")
        effects = self.files.stage(judged.select("seq", "path", "hash", action.alias("action")))
        last = self.files.load(effects).groupBy("path").agg(F.max_by(F.struct("hash", "seq"), "seq").alias("l")).select("path", "l.hash", "l.seq").withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))
        state = known.join(last.select("path"), "path", "left_anti").unionByName(last.where("hash is not null"))
        new = self.files.stage(state.repartition("bucket"), "bucket")
        parts = []
        for p in manifest["parts"]:
            left = [b for b in p.get("buckets", []) if b not in touched]
            parts += [p] if p["what"] == "effects" else [p | {"buckets": left}] if left else []
        self.published(number, [*parts, effects | {"what": "effects"}, new | {"what": "state", "buckets": sorted(touched)}], base)

    def published(self, number: int, parts: list[dict], base: int) -> None:
        self.files.publish(parts, base, {"batch": number})


def run(spark: SparkSession, changes: DataFrame, drain: Drain, checkpoint: str) -> None:
    """Drains a stream of changes as far as it goes."""
    changes.writeStream.foreachBatch(drain.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_pieces(rows: DataFrame, order: str, pieces: int, path: str) -> DataFrame:
    """rows as a stream of ``pieces`` batches, in the order of a numeric column: each is written as files of its own, one after the other.

    A batch is a number of files, so each piece has as many: by the rows of
    all, and empty ones where a piece has too few.
    """
    spark = rows.sparkSession
    cuts = rows.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / pieces for k in range(1, pieces)], 0.01)
    edges = [None, *cuts, None]
    files = max(1, -(-rows.count() // (pieces * FILE_ROWS)))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(pieces):
        some = rows
        if edges[k] is not None:
            some = some.where(F.col(order) > edges[k])
        if edges[k + 1] is not None:
            some = some.where(F.col(order) <= edges[k + 1])
        some.repartition(files).write.mode("append").parquet(path)
        there = sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(place))
        for _ in range((k + 1) * files - there):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
