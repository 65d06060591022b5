"""JSON-lines export and import of the memories table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = "memlake-memories"
SCHEMA_VERSION = 1


def export_lines(mem: DataFrame, order: str = "created_at") -> DataFrame:
    """One line a record, as JSON, in order; the first line is a header with format, version and counts by type."""
    counts = mem.groupBy("memory_type").count().collect()  # one row a type
    header = F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(*[F.lit(r["count"]).alias(r["memory_type"]) for r in sorted(counts)]).alias("counts"))) if counts else F.lit("{}")
    first = mem.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(None).cast(mem.schema[order].dataType).alias("at"), header.alias("value"))
    lines = mem.select(F.lit(1).alias("kind"), F.col(order).alias("at"), F.to_json(F.struct("*")).alias("value"))
    return first.unionByName(lines).orderBy("kind", "at", "value").select("value")


def import_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of a file of exported lines; the header is neither."""
    text = spark.read.text(path).where(~F.col("value").contains(f'"format":"{FORMAT}"'))
    wide = StructType(list(schema.fields)).add("_corrupt_record", "string")
    parsed = text.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r.memory_id").isNull()
    return parsed.where(~bad).select(*[F.col(f"r.{f.name}") for f in schema.fields]), parsed.where(bad).select("value")
