"""A made-up store for measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_store(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n seeded memories: 55 % beliefs, 25 % events, 12 % skills, 8 % world models, up to 730 days old, with up to two tags."""
    r = [F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(10_000)) / 10_000.0 for k in range(4)]
    kind = F.when(r[0] < 0.55, "belief").when(r[0] < 0.80, "event").when(r[0] < 0.92, "skill").otherwise("world_model")
    tags = F.slice(F.array(F.concat(F.lit("t"), (F.col("id") % 7).cast("string")), F.concat(F.lit("u"), (F.col("id") % 5).cast("string"))), 1, F.floor(r[3] * 3).cast("int"))
    return spark.range(n).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("memory_id"), kind.alias("memory_type"), F.round(0.05 + 0.9 * r[1], 2).alias("confidence"), F.floor(r[2] * 731).cast("int").alias("age_days"), tags.alias("tags"))
