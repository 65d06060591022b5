"""JSON of any depth as rows, by the variant type: one level of all documents at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.sources.scratch import written

# Endings of script files, and the keys of a manifest that name some at any depth.
SCRIPT_ENDS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
ENTRY_KEYS = ["main", "module", "browser", "bin", "exports", "types"]


def _text(value: Column, kind: Column) -> Column:
    return F.when(kind != "VOID", F.variant_get(value, "$", "string"))


def leaves(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, path, top, value, kind`` of every scalar of each row's JSON, however deep.

    ``path`` has the keys and places on the way, as '$.a.b[0]'; ``top`` is its
    first key, null at the root of an array or scalar; ``value`` is the scalar
    as a string, null for a JSON null. Keys are never values. JSON that can't
    be read, and empty objects and arrays, give no rows. Each turn opens one
    level of all rows that have one, so turns are as many as the deepest level.
    """
    start = rows.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json_col)).alias("v")).where("v is not null")
    level = start.select("id", F.lit("$").alias("path"), F.lit(None).cast("string").alias("top"), "v")
    out = None
    while True:
        level = written(level.withColumn("kind", F.schema_of_variant("v")), "json-level")
        nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        found = level.where(~nested).select("id", "path", "top", _text(F.col("v"), F.col("kind")).alias("value"), F.lower("kind").alias("kind"))
        out = found if out is None else out.unionByName(found)
        level = level.where(nested)
        if level.isEmpty():
            return out
        each = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("inner")))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        level = each.select("id", F.concat("path", step).alias("path"), F.coalesce("top", F.when(F.col("path") == "$", F.col("key"))).alias("top"), F.col("inner").alias("v"))


def is_script(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1).isin(*SCRIPT_ENDS)


def script_entries(manifests: DataFrame) -> DataFrame:
    """``path``: script files that manifests (folder, json) declare.

    Values under main, module, browser, bin, exports and types count at any
    depth, and words of the commands under scripts; keys never do. Paths start
    from the manifest's folder, which may be empty.
    """
    found = leaves(manifests, "folder", "json").where("kind = 'string'")
    named = found.where(F.col("top").isin(*ENTRY_KEYS)).select("id", "value")
    words = found.where("top = 'scripts'").where(F.col("path").rlike(r"^\$\.scripts\..")).select("id", F.explode(F.split("value", r"[\s;&|'\"]+")).alias("value"))
    plain = F.regexp_replace(F.replace("value", F.lit("\\"), F.lit("/")), "^[./]+", "")
    paths = named.unionByName(words).where(is_script(F.col("value"))).select("id", plain.alias("p"))
    return paths.select(F.when(F.col("id") == "", F.col("p")).otherwise(F.concat_ws("/", "id", "p")).alias("path")).distinct()
