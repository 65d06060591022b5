"""Saving memories: validation, guards, first beliefs, merged properties, histories, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.functions import scoring as S
from memlake.functions import text as T

# What each type of memory needs, and the confidence that it begins with.
REQUIRED = {"belief": ["subject", "relation", "object"], "event": ["subject", "event_type"], "skill": ["name"], "world_model": ["entity_type", "name"]}
FIRST_CONFIDENCE = {"event": 1.0, "skill": 0.5, "world_model": 0.9}
TEXTS = ["subject", "relation", "object", "event_type", "name", "entity_type", "description", "domain"]


def first_confidence(source: Column, observed: Column) -> Column:
    """A new belief's confidence: the weight of its source by the strength of the observation, at most 1."""
    return F.least(F.lit(1.0), S.source_weight(source) * observed)


def checked(items: DataFrame) -> DataFrame:
    """items (index, mem_type, TEXTS, confidence, source) with clean and redacted texts, ``error`` and the stored ``confidence``.

    A text of white space is none. Leaked markup and an unknown type or a
    missing field are errors; secrets are redacted, and ``redacted`` names the
    first one found.
    """
    said = F.concat_ws("\x00", *TEXTS)
    out = items.withColumn("redacted", T.secret_name(said)).withColumn("_leaked", R.has_marker(said, R.LEAKED_MARKERS))
    for name in TEXTS:
        out = out.withColumn(name, F.nullif(F.trim(T.redact(F.col(name))), F.lit("")))
    error = F.when(F.col("_leaked"), "markup").when(~F.col("mem_type").isin(*REQUIRED) | F.col("mem_type").isNull(), "unknown type")
    for kind, fields in REQUIRED.items():
        for f in fields:
            error = error.when((F.col("mem_type") == kind) & F.col(f).isNull(), F.lit(f"{kind} needs {f}"))
    begin = first_confidence(F.col("source"), F.lit(1.0))
    for kind, value in FIRST_CONFIDENCE.items():
        begin = F.when(F.col("mem_type") == kind, F.lit(value)).otherwise(begin)
    out = out.withColumn("error", error).drop("_leaked")
    return out.withColumn("confidence", F.when(F.col("confidence").isNotNull(), S.clamp01(F.col("confidence"))).otherwise(begin))


def saved(items: DataFrame) -> DataFrame:
    """One item after another: those without an error (``checked``)."""
    return checked(items).where("error is null")


def saved_batch(items: DataFrame) -> DataFrame:
    """``batch, saved, error, failed_index``: a batch (column batch) is stored whole or not at all; the first error is named."""
    rows = checked(items)
    first = rows.groupBy("batch").agg(F.count("*").alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("index", "error"))).alias("e"))
    return first.select("batch", F.when(F.col("e").isNull(), F.col("n")).otherwise(F.lit(0)).alias("saved"), F.col("e.error").alias("error"), F.col("e.index").alias("failed_index"))


def merged_properties(old: Column, new: Column) -> tuple[Column, Column]:
    """(properties, changes): new values win; a change is (key, old_value, new_value) of what differs, by key."""
    keys = F.array_sort(F.map_keys(new))
    changes = F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), old[k].alias("old_value"), new[k].alias("new_value"))), lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new), changes


def property_history(updates: DataFrame) -> DataFrame:
    """``model_id, n, key, old_value, new_value, at`` of updates (model_id, key, value, at): what changed a property, in order; a repeated value isn't one."""
    before = F.lag("value").over(Window.partitionBy("model_id", "key").orderBy("at"))
    rows = updates.withColumn("old_value", before).where(~F.col("old_value").eqNullSafe(F.col("value")))
    n = F.row_number().over(Window.partitionBy("model_id").orderBy("at", "key"))
    return rows.select("model_id", n.alias("n"), "key", "old_value", F.col("value").alias("new_value"), "at")


def linked(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """``request, belief_id, edge_id, src_id, dst_id``: both ends of a link (request, src, src_type, relation, dst, dst_type, source) found by name and type, the belief and the edge made together; without both ends nothing is."""
    by = nodes.where("status = 'active'").groupBy("canonical", "entity_type").agg(F.min("node_id").alias("id"))

    def end(side: str) -> DataFrame:
        return by.select(F.col("canonical").alias(side), F.col("entity_type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id"))

    found = requests.join(end("src"), ["src", "src_type"]).join(end("dst"), ["dst", "dst_type"])
    relation = T.normal_relation(F.col("relation"))
    belief = R.digest_id(F.lit("belief"), F.col("request").cast("string"))
    return found.select("request", belief.alias("belief_id"), R.digest_id(F.col("src_id"), relation, F.col("dst_id")).alias("edge_id"), "src_id", relation.alias("relation"), "dst_id", first_confidence(F.col("source"), F.lit(1.0)).alias("confidence"))


def cached_hits(cache: DataFrame, active: DataFrame) -> DataFrame:
    """Keys of a cache (key, memory_id) all of whose memories are still active: any miss is a miss of the whole."""
    rows = cache.join(active.select("memory_id", F.lit(1).alias("here")), "memory_id", "left")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count("here").alias("found")).where("n = found").select("key", "n")
