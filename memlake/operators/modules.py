"""The import graph: resolved imports, the index after a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import rules as R

# Endings that a specifier without one is tried with, in order.
TRIED_ENDS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts"]


def resolved_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``path, target, target_path``: each import as absolute names, and the file of that module if there is one.

    ``from a import b`` names the module a.b where that is a file, else a.
    """
    known = files.select(R.module_name(F.col("path")).alias("target"), F.col("path").alias("target_path"))
    package = F.col("path").rlike(r"(^|/)__init__\.py$")
    base = R.imported_name(R.module_name(F.col("path")), package, F.col("level"), F.col("module"))
    rows = imports.where("module is not null").withColumn("base", base)
    wide = rows.select("path", "base", F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("")))).alias("name"))
    wide = wide.withColumn("inner", F.when(F.col("name") != "", F.concat_ws(".", F.nullif("base", F.lit("")), "name")))
    hit = wide.join(known.select(F.col("target").alias("inner"), F.col("target_path").alias("inner_path")), "inner", "left")
    hit = hit.join(known.select(F.col("target").alias("base"), F.col("target_path").alias("base_path")), "base", "left")
    target = F.when(F.col("inner_path").isNotNull(), F.col("inner")).otherwise(F.col("base"))
    return hit.select("path", target.alias("target"), F.coalesce("inner_path", "base_path").alias("target_path")).where("target <> ''").distinct()


def folded_path(path):
    """A path with its '.' and '..' steps taken; steps above the root are dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    steps = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, p)))
    return F.array_join(steps, "/")


def resolved_scripts(specifiers: DataFrame, files: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``path, specifier, target_path``: the file that a specifier means, null for what is outside.

    Relative ones start from the importer's folder, others go through the
    alias patterns in order. A place is tried as it is, then with each ending,
    then as a folder's index; the first file that exists counts.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    tries = F.when(F.col("specifier").startswith("."), F.array(folded_path(F.concat(folder, F.col("specifier"))))).otherwise(F.array().cast("array<string>"))
    for pattern, targets in (aliases or {}).items():
        prefix = pattern.split("*", 1)[0]
        for target in targets:
            if "*" in pattern:
                fits, place = F.col("specifier").startswith(prefix), F.replace(F.lit(target), F.lit("*"), F.substring("specifier", len(prefix) + 1, 10_000))
            else:
                fits, place = F.col("specifier") == pattern, F.lit(target)
            tries = F.when(fits & ~F.col("specifier").startswith("."), F.array_append(tries, place)).otherwise(tries)
    rows = specifiers.select("path", "specifier", F.posexplode_outer(tries).alias("a", "place"))
    ends = ["", *TRIED_ENDS, *(f"/index{e}" for e in TRIED_ENDS)]
    wide = rows.select("path", "specifier", "a", F.posexplode(F.array(*[F.concat(F.coalesce("place", F.lit("")), F.lit(e)) for e in ends])).alias("b", "target_path"))
    hit = wide.join(files.select(F.col("path").alias("target_path")), "target_path", "left_semi")
    best = hit.groupBy("path", "specifier").agg(F.min_by("target_path", F.struct("a", "b")).alias("target_path"))
    return specifiers.select("path", "specifier").distinct().join(best, ["path", "specifier"], "left")


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after an upsert by node_id: new values where there are any, else the old ones; attributes are the new ones."""
    both = old.alias("o").join(new.alias("n"), F.col("o.node_id") == F.col("n.node_id"), "full_outer")
    known = F.col("n.node_id").isNotNull()
    return both.select(
        F.coalesce("n.node_id", "o.node_id").alias("node_id"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("file_path", "lang")],
        F.when(known, F.col("n.attributes")).otherwise(F.col("o.attributes")).alias("attributes"),
    )


def index_pass(state: DataFrame, files: DataFrame) -> DataFrame:
    """``path, action`` of an index pass: skip (same hash), refresh (other hash), index (new), retire (gone)."""
    both = state.withColumnRenamed("hash", "old").join(files.withColumnRenamed("hash", "now"), "path", "full_outer")
    return both.select("path", F.when(F.col("now").isNull(), "retire").when(F.col("old").isNull(), "index").when(F.col("old") == F.col("now"), "skip").otherwise("refresh").alias("action"))


def applied_edges(edges: DataFrame, plan: DataFrame, emitted: DataFrame) -> DataFrame:
    """Edges (src_path, dst, valid) after a pass: those out of refreshed and retired files are closed, what the parsed files emit is open."""
    touched = plan.where("action in ('refresh', 'retire')").select(F.col("path").alias("src_path"), F.lit(1).alias("touched"))
    kept = edges.join(touched, "src_path", "left").withColumn("valid", F.col("valid") & F.col("touched").isNull()).drop("touched")
    fresh = emitted.join(plan.where("action in ('refresh', 'index')").select(F.col("path").alias("src_path")), "src_path", "left_semi").select("src_path", "dst").distinct()
    both = kept.join(fresh.withColumn("fresh", F.lit(True)), ["src_path", "dst"], "full_outer")
    return both.select("src_path", "dst", (F.coalesce("valid", F.lit(False)) | F.coalesce("fresh", F.lit(False))).alias("valid")).groupBy("src_path", "dst").agg(F.bool_or("valid").alias("valid"))
