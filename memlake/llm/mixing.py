"""Mixing sources to target weights by hierarchical budgeting.

The leaves are sources within languages within domains. A token budget is
handed down the tree: each node's children get shares by their weights, but
none more than its capacity (its tokens times the number of epochs allowed).
What a child can't take goes to its siblings by weight (water-filling); only
when all siblings are full does the shortage show as the parent's capacity and
so reach the parent's siblings. Each leaf then takes whole epochs and, of one
more epoch in seeded order, the prefix of documents that reaches its budget.

Built of DataFrame functions only. The order within a leaf is needed at one
place alone, the bucket of the seeded hash in which the prefix ends, so no
task sorts a whole leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"


def water_fill(nodes: DataFrame, parent: list[str], order: str, budget: str, weight: str, capacity: str, out: str) -> DataFrame:
    """nodes with column ``out``: the parent's budget dealt to its children by weight, at most capacity each.

    Children are taken by capacity a weight; the level at which the rest is
    dealt is set by the first child that isn't filled. Whole tokens: floor.
    """
    by_parent = Window.partitionBy(*parent)
    run = by_parent.orderBy("_ratio", order)
    full = nodes.withColumn("_ratio", F.col(capacity) / F.col(weight))
    full = full.withColumn("_cap_before", F.coalesce(F.sum(capacity).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    full = full.withColumn("_weight_left", F.sum(weight).over(run.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    full = full.withColumn("_level", (F.col(budget) - F.col("_cap_before")) / F.col("_weight_left"))
    full = full.withColumn("_open_level", F.when(F.col("_level") < F.col("_ratio"), F.col("_level")))
    # levels only rise along the order while children fill up, so the least open one is the first
    full = full.withColumn("_share", F.first("_open_level", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    got = F.when(F.col("_share").isNull(), F.col(capacity)).otherwise(F.least(F.col(capacity), F.floor(F.col("_share") * F.col(weight))))
    return full.withColumn(out, F.greatest(F.lit(0), got).cast("long")).drop("_ratio", "_cap_before", "_weight_left", "_level", "_open_level", "_share")


def mix(
    docs: DataFrame,
    domain: Column,
    domain_weights: dict[str, int],
    lang_weights: dict[str, int],
    source_weights: dict[str, int] | None = None,
    default_weight: int = 1,
    budget_share: float = 0.6,
    max_epochs: int = 1,
    seed: int = 0,
    hash_buckets: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of docs: ``doc_id, domain, lang, source, n_tokens, leaf_budget, copies``.

    The budget is ``budget_share`` of all tokens (words of the text). Weights
    are whole numbers of at least 1; a name that isn't listed has
    ``default_weight``. ``copies`` is the number of epochs that take the
    document: all whole epochs of its leaf, and one more if the document lies
    in the prefix of the last one, that is, if the documents before it in
    seeded order hold fewer tokens than are still due. Ties in the seeded hash
    go by id; rows that repeat an id are counted one by one.

    Null domain, language or source is the leaf ``(none)``; a null or empty
    text has no tokens and is taken with the epoch (prefix) it lies in. An
    empty table gives no rows; extra columns of docs are not looked at, but
    for those ``carried`` into the result.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(domain.cast("string"), F.lit(NONE)).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        key.alias("_key"),
        *carried,
    ).withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") * hash_buckets / 65536).cast("int"))
    rows = written(rows, "mix-rows")
    leaf = ["domain", "lang", "source"]

    def weight(name: str, table: dict[str, int] | None) -> Column:
        out = F.lit(default_weight)
        for k, w in sorted((table or {}).items()):
            out = F.when(F.col(name) == k, F.lit(w)).otherwise(out)
        return out.cast("long")

    buckets = rows.groupBy(*leaf, "_bucket").agg(F.sum("n_tokens").alias("_bucket_tokens"))
    leaves = buckets.groupBy(*leaf).agg(F.sum("_bucket_tokens").alias("leaf_tokens"))
    leaves = leaves.withColumn("leaf_cap", F.col("leaf_tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("leaf_cap").alias("lang_cap"))
    # the number of domains is that of domain_weights and the default, not of rows
    domains = langs.groupBy("domain").agg(F.sum("lang_cap").alias("domain_cap"))
    tokens = (leaves.agg(F.sum("leaf_tokens")).first()[0]) or 0
    domains = domains.withColumn("_root", F.lit(0)).withColumn("_total", F.lit(int(tokens * budget_share)).cast("long")).withColumn("_w", weight("domain", domain_weights))
    domains = water_fill(domains, ["_root"], "domain", "_total", "_w", "domain_cap", "domain_budget").select("domain", "domain_budget")
    langs = langs.join(domains, "domain").withColumn("_w", weight("lang", lang_weights))
    langs = water_fill(langs, ["domain"], "lang", "domain_budget", "_w", "lang_cap", "lang_budget").select("domain", "lang", "lang_budget")
    leaves = leaves.join(langs, ["domain", "lang"]).withColumn("_w", weight("source", source_weights))
    leaves = water_fill(leaves, ["domain", "lang"], "source", "lang_budget", "_w", "leaf_cap", "leaf_budget")
    leaves = leaves.select(
        *leaf,
        "leaf_budget",
        F.when(F.col("leaf_tokens") > 0, F.floor(F.col("leaf_budget") / F.col("leaf_tokens"))).otherwise(F.lit(0)).cast("long").alias("_epochs"),
    )
    run = Window.partitionBy(*leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.partitionBy(*leaf)
    plan = buckets.withColumn("_before", F.coalesce(F.sum("_bucket_tokens").over(run), F.lit(0))).withColumn("_leaf_tokens", F.sum("_bucket_tokens").over(totals))
    plan = plan.join(leaves, leaf).withColumn("_due", F.col("leaf_budget") - F.col("_epochs") * F.col("_leaf_tokens"))
    plan = written(plan.select(*leaf, "_bucket", "leaf_budget", "_epochs", "_before", "_due", "_bucket_tokens"), "mix-plan")

    joined = rows.join(plan, [*leaf, "_bucket"])
    end = F.col("_before") + F.col("_bucket_tokens")
    inside = (F.col("_before") < F.col("_due")) & (end >= F.col("_due"))
    whole = end < F.col("_due")
    plain = joined.where(~inside).withColumn("_more", whole.cast("long"))
    order = Window.partitionBy(*leaf, "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = joined.where(inside).withColumn("_more", (F.col("_before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)) < F.col("_due")).cast("long"))
    columns = ["doc_id", *leaf, "n_tokens", "leaf_budget", "_epochs", "_more", *carried]
    out = plain.select(*columns).unionByName(cut.select(*columns))
    return out.select("doc_id", *leaf, "n_tokens", "leaf_budget", (F.col("_epochs") + F.col("_more")).cast("long").alias("copies"), *carried)
