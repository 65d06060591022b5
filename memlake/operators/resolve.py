"""Names to nodes: alias map, exact names, alias table, then similar names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import unicode as U
from memlake.operators.index import trigrams
from memlake.sources.scratch import written

SIMILAR = 0.90
# Names that are nodes of their own kind.
SINGLETONS = ["user", "skill"]


def redirected(nodes: DataFrame) -> DataFrame:
    """nodes with ``target``: the node that a merged one points at, one step only; any other is its own."""
    into = nodes.select(F.col("node_id").alias("_into"))
    out = nodes.join(into, F.when(F.col("status") == "merged", F.col("merged_into")) == F.col("_into"), "left")
    return out.withColumn("target", F.coalesce("_into", "node_id")).drop("_into")


def new_aliases(known: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (alias, node_id) of found that the table hasn't: the first to name an alias keeps it."""
    keep = found.where("alias <> ''").groupBy("alias").agg(F.min("node_id").alias("node_id"))
    return keep.join(known.select("alias"), "alias", "left_anti")


def names_of(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """``node_id, names``: canonical and display name and all aliases, each once, in order."""
    rows = nodes.select("node_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("canonical").alias("name")), F.struct(F.lit(1).alias("k"), U.canonical_name(F.col("display_name")).alias("name")))).alias("r")).select("node_id", "r.*")
    rows = rows.unionByName(aliases.select("node_id", F.lit(2).alias("k"), F.col("alias").alias("name")))
    first = rows.groupBy("node_id", "name").agg(F.min("k").alias("k"))
    return first.groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), " ").alias("names"))


def similar_nodes(names: DataFrame, nodes: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``canonical, node_id, similarity``: active nodes whose name is alike and shares a trigram.

    Only pairs whose lengths allow the similarity are compared, and each pair
    once however many trigrams it shares.
    """
    # jaro is at most (1 + m/long + 1)/3 with all of the short name met; four equal first letters add 0.4 of the rest
    pool = nodes.where("status = 'active'").select("node_id", F.col("canonical").alias("other"))
    left = names.where(F.length("canonical") >= 3).select("canonical", F.explode(trigrams(F.col("canonical"))).alias("gram"))
    right = pool.select("node_id", "other", F.explode(trigrams(F.col("other"))).alias("gram"))
    short, long = F.least(F.length("canonical"), F.length("other")), F.greatest(F.length("canonical"), F.length("other"))
    jaro_most = (2 + short / long) / 3
    possible = (jaro_most + 0.4 * (1 - jaro_most) >= least) | (short >= 0.6 * long)
    pairs = written(left.join(right, "gram").where(possible).select("canonical", "other", "node_id").distinct(), "resolve-pairs")
    return pairs.withColumn("similarity", U.name_similarity(F.col("canonical"), F.col("other"))).where(F.col("similarity") >= least).select("canonical", "node_id", "similarity")


def resolve(names: DataFrame, nodes: DataFrame, aliases: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``name, canonical, node_id, how, possible``: the node of each row (name, entity_type) of names.

    In order: a singleton's own node; the active node of that canonical name
    (of the same type before any other, the most mentioned first); the alias
    table, through one redirect; the only similar node. ``how`` says which.
    Several similar nodes are ``possible`` duplicates of a new node, without
    any it is new; an empty name is none.
    """
    rows = names.withColumn("norm", U.canonical_name(F.col("name"))).withColumn("canonical", U.seed_alias(F.col("norm"), overrides))
    rows = written(rows.where("norm <> ''"), "resolve-names")
    active = nodes.where("status = 'active'").select("node_id", "canonical", F.col("entity_type").alias("node_type"), "mention_count")
    single = F.col("canonical").isin(*SINGLETONS)
    exact = rows.join(active, "canonical").where(~single | (F.col("node_type") == F.col("canonical")))
    order = Window.partitionBy("name", "entity_type").orderBy(F.desc(F.col("node_type").eqNullSafe(F.col("entity_type"))), F.desc("mention_count"), "node_id")
    exact = exact.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(F.col("name").alias("_name"), F.col("entity_type").alias("_type"), F.col("node_id").alias("exact_id"))
    by_alias = aliases.select("alias", "node_id").join(redirected(nodes).select("node_id", "target"), "node_id").join(active.select(F.col("node_id").alias("target")), "target", "left_semi").groupBy("alias").agg(F.min("target").alias("target"))
    out = rows.join(exact, (F.col("name") == F.col("_name")) & F.col("entity_type").eqNullSafe(F.col("_type")), "left").drop("_name", "_type")
    out = out.join(by_alias.select(F.col("alias").alias("norm"), F.col("target").alias("norm_id")), "norm", "left")
    out = out.join(by_alias.select(F.col("alias").alias("canonical"), F.col("target").alias("alias_id")), "canonical", "left")
    out = written(out.withColumn("known", F.coalesce("exact_id", F.when(~single, F.coalesce("norm_id", "alias_id")))), "resolve-known")
    fuzzy = similar_nodes(out.where(F.col("known").isNull() & ~single).select("canonical").distinct(), nodes)
    fuzzy = fuzzy.groupBy("canonical").agg(F.sort_array(F.collect_set("node_id")).alias("similar"))
    out = out.join(fuzzy, "canonical", "left")
    one = F.size(F.coalesce("similar", F.array().cast("array<string>"))) == 1
    how = F.when(F.col("exact_id").isNotNull(), F.when(single, "singleton").otherwise("exact")).when(F.col("known").isNotNull(), "alias").when(one, "similar").when(F.col("similar").isNotNull(), "possible").otherwise("new")
    return out.select("name", "entity_type", "canonical", F.coalesce("known", F.when(one, F.element_at("similar", 1))).alias("node_id"), how.alias("how"), F.when(~one & F.col("known").isNull(), F.array_join("similar", ",")).alias("possible"))
