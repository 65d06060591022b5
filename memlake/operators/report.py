"""The report on a document ledger: what is stale, refers to nothing, repeats others or may be archived; and what looks complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Days after which documents of a type are stale, and tiers that are never archived.
STALE_AFTER = {"plan": 30, "brainstorm": 14, "guide": 90}
PROTECTED = ["T0", "T1"]
COMPLETE = 0.9


def findings(registry: DataFrame, signals: DataFrame, clusters: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """``rel_path, stale, dead, cluster, archive`` of each document with a finding.

    registry: rel_path, doc_type, tier, lifecycle, age_days; signals: rel_path,
    ratio, dead_files, dead_symbols; clusters: rel_path, cluster. ``stale`` is
    its age where an active document or draft is older than its type's window
    allows, ``dead`` how many references lead nowhere, ``cluster`` the least
    path of its near-copies. ``archive`` says why it may be archived: by its
    lifecycle, or as it is older than its window and either of tier T3 or with
    all its boxes ticked; T0 and T1 never.
    """
    table = F.create_map(*[F.lit(x) for kv in (windows or STALE_AFTER).items() for x in kv])
    rows = registry.join(signals, "rel_path", "left").join(clusters, "rel_path", "left").withColumn("window", table[F.col("doc_type")])
    old = F.coalesce(F.col("age_days") > F.col("window"), F.lit(False))
    stale = F.when(old & F.col("lifecycle").isin("active", "draft"), F.col("age_days"))
    dead = F.nullif(F.coalesce("dead_files", F.lit(0)) + F.coalesce("dead_symbols", F.lit(0)), F.lit(0))
    done = F.when(F.col("lifecycle").isin("fulfilled", "superseded"), F.concat(F.lit("lifecycle "), "lifecycle"))
    worn = F.when(old & ((F.col("tier") == "T3") | F.coalesce(F.col("ratio") == 1.0, F.lit(False))), F.concat(F.lit("stale "), "doc_type", F.lit(" ("), "age_days", F.lit("d > "), "window", F.lit("d)")))
    why = F.when(~F.col("tier").isin(*PROTECTED), F.nullif(F.concat_ws("; ", done, worn), F.lit("")))
    out = rows.select("rel_path", stale.cast("long").alias("stale"), dead.cast("long").alias("dead"), "cluster", why.alias("archive"))
    return out.where("coalesce(stale, dead) is not null or cluster is not null or archive is not null")


def totals(registry: DataFrame, found: DataFrame) -> DataFrame:
    """One row: ``total_docs, stale, dead, clusters, archive_candidates``."""
    counts = found.agg(F.count("stale").alias("stale"), F.count("dead").alias("dead"), F.count_distinct("cluster").alias("clusters"), F.count("archive").alias("archive_candidates"))
    return registry.agg(F.count("*").alias("total_docs")).join(counts)  # one row each


def proposals(registry: DataFrame, signals: DataFrame, merged: DataFrame) -> DataFrame:
    """``rel_path`` of active plans that look complete: nearly all boxes ticked, or an issue that they name was merged (merged: rel_path, merged)."""
    rows = registry.where("doc_type = 'plan' and lifecycle = 'active'").join(signals, "rel_path", "left").join(merged, "rel_path", "left")
    return rows.where((F.col("ratio") >= COMPLETE) | (F.col("merged") > 0)).select("rel_path")
