"""Temporal knowledge graph and import graph as iterated equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.sources.scratch import written

HUB_DEGREE = 50


def valid_now() -> Column:
    return F.col("invalid_at").isNull()


def valid_at(moment: Column) -> Column:
    """Half-open validity, compared as timestamps."""
    return (F.col("valid_from") <= moment) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > moment))


def _neighbours(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes one edge away from the frontier, in either direction; one equi-join for each."""
    out = frontier.join(edges.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("to")), "node_id")
    back = frontier.join(edges.select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("to")), "node_id")
    return out.unionByName(back).select("seed", F.col("to").alias("node_id"))


def _next(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    out = frontier.join(edges.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("to")), "node_id").select("to")
    back = frontier.join(edges.select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("to")), "node_id").select("to")
    return written(out.unionByName(back).distinct().withColumnRenamed("to", "node_id"), "walk-frontier")


def oriented_steps(edges: DataFrame, candidates: DataFrame, fanout: int) -> DataFrame:
    """The best ``fanout`` edges by weight times confidence leaving and entering each candidate, as steps ``at -> to``.

    Each direction has its own window, so only the first ranks leave the sort.
    """
    near = candidates.select("node_id").distinct()
    columns = ["edge_id", "src_id", "dst_id", "relation", "confidence", "weight"]
    steps = None
    for here, there in (("src_id", "dst_id"), ("dst_id", "src_id")):
        rank = F.row_number().over(Window.partitionBy(here).orderBy(F.desc(F.col("weight") * F.col("confidence")), "edge_id"))
        one = edges.select(*columns).join(near.withColumnRenamed("node_id", here), here, "left_semi").withColumn("rank", rank).where(F.col("rank") <= fanout)
        one = one.select("edge_id", F.col(here).alias("at"), F.col(there).alias("to"), "confidence")
        steps = one if steps is None else steps.unionByName(one)
    return steps.dropDuplicates(["edge_id", "at"])


def walk(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 2, fanout: int = 6, decay: float = 0.6) -> DataFrame:
    """All walks of up to ``depth`` edges from each seed (column ``node_id``), by the fan-out and expansion rules.

    No edge is used twice on a walk; nodes that aren't expandable end it,
    seeds excepted. A walk's score is the decay per hop times the confidence
    of its last edge.
    """
    edges = written(edges.select("edge_id", "src_id", "dst_id", "relation", "confidence", "weight"), "walk-edges")
    seeds = written(seeds.select(F.col("node_id").alias("seed"), "node_id").distinct(), "walk-seeds")
    # the last level is never left, so its nodes need no steps
    reached, frontier = seeds.select("node_id"), seeds.select("node_id")
    for _ in range(depth - 1):
        frontier = _next(frontier, edges)
        reached = reached.unionByName(frontier).distinct()
    steps = written(oriented_steps(edges, reached, fanout), "walk-steps")
    open_nodes = nodes.select("node_id", "expandable")
    level = seeds.select("seed", "node_id", F.array().cast("array<string>").alias("path"))
    out = None
    for d in range(1, depth + 1):
        here = level.join(open_nodes, "node_id")
        if d > 1:
            here = here.where("expandable = 1")
        moved = here.join(steps, F.col("node_id") == F.col("at")).where(~F.array_contains("path", F.col("edge_id")))
        moved = moved.select("seed", F.col("to").alias("node_id"), "edge_id", F.lit(d).alias("depth"), (F.lit(decay**d) * F.col("confidence")).alias("score"), F.array_append("path", F.col("edge_id")).alias("path"))
        moved = written(moved, f"walk-{d}")
        out = moved if out is None else out.unionByName(moved)
        level = moved.select("seed", "node_id", "path")
    return out


def traverse(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 2, fanout: int = 6, decay: float = 0.6, limit: int = 50) -> DataFrame:
    """For each seed the best ``limit`` edges reached, each once by its best walk."""
    walks = walk(edges, nodes, seeds, depth, fanout, decay).withColumn("trail", F.array_join("path", ">"))
    pick = F.row_number().over(Window.partitionBy("seed", "edge_id").orderBy(F.desc("score"), "depth", "trail"))
    best = walks.withColumn("pick", pick).where("pick = 1")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "depth", "edge_id"))
    return best.withColumn("place", rank).where(F.col("place") <= limit).select("seed", "edge_id", F.col("node_id").alias("reached_id"), "depth", "score")


def best_paths(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, targets: Column, hops: int = 4, fanout: int = 6) -> DataFrame:
    """Shortest walk from each seed to each target, of equally short ones the best score; targets: a condition on node_id."""
    arrived = walk(edges, nodes, seeds, hops, fanout).where(targets & (F.col("node_id") != F.col("seed"))).withColumn("trail", F.array_join("path", ">"))
    pick = F.row_number().over(Window.partitionBy("seed", "node_id").orderBy("depth", F.desc("score"), "trail"))
    return arrived.withColumn("pick", pick).where("pick = 1").select("seed", "node_id", "depth", "score", "trail")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src_id").alias("node_id")).unionAll(edges.select(F.col("dst_id").alias("node_id"))).groupBy("node_id").agg(F.count("*").alias("degree"))


def expandable(nodes: DataFrame, edges: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    found = nodes.select("node_id").join(degrees(edges.where(valid_now())), "node_id", "left")
    return found.select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("degree", F.lit(0)) <= hub_degree).cast("int").alias("expandable"))


def refreshed_confidence(edges: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Valid edges whose active belief has another confidence by now."""
    return edges.where(valid_now()).join(beliefs.select(F.col("memory_id").alias("belief_id"), F.col("confidence").alias("belief_confidence")), "belief_id").where("confidence <> belief_confidence").select("edge_id", F.col("belief_confidence").alias("confidence"))


def orphaned(edges: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Valid edges that name a belief which isn't active."""
    return edges.where(valid_now() & F.col("belief_id").isNotNull()).join(beliefs.select(F.col("memory_id").alias("belief_id")), "belief_id", "left_anti").select("edge_id")


def maintained(edges: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Edges with what ``refreshed_confidence`` and ``orphaned`` say of them, by one join: ``confidence`` is fresh, ``orphan`` tells the orphans."""
    held = beliefs.select(F.col("memory_id").alias("belief_id"), F.col("confidence").alias("belief_confidence"), F.lit(True).alias("held"))
    both = edges.join(held, "belief_id", "left")
    orphan = valid_now() & F.col("belief_id").isNotNull() & F.col("held").isNull()
    fresh = F.when(valid_now(), F.coalesce("belief_confidence", "confidence")).otherwise(F.col("confidence"))
    return both.withColumn("orphan", orphan).withColumn("confidence", fresh).select(*edges.columns, "orphan")


def stale_nodes(nodes: DataFrame, edges: DataFrame, cutoff: Column) -> DataFrame:
    """Rarely mentioned old nodes without a valid edge."""
    ends = degrees(edges.where(valid_now())).select("node_id")
    return nodes.where((F.col("status") == "active") & (F.col("mention_count") <= 1) & (F.col("updated_at") < cutoff)).join(ends, "node_id", "left_anti").select("node_id")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, labels: DataFrame | None = None, enough: int | None = None) -> DataFrame:
    """``seed, node_id, depth``: least depth of every node within ``depth`` edges of each seed, seed left out; level at a time, what was seen isn't visited again.

    Seeds are taken in blocks of 64, a bit of a mask each, so a level is a row
    a block and node until the end. ``labels`` (node_id, more columns) is met
    before rows are spread. Seeds that have ``enough`` nodes go no deeper: for
    who takes the nearest ones only.
    """
    a, b = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    links = written(edges.select(F.col(a).alias("node_id"), F.col(b).alias("to")).distinct(), "reach-links")
    numbered = seeds.select(F.col("node_id").alias("seed")).distinct().withColumn("n", F.monotonically_increasing_id())
    numbered = written(numbered.select("seed", F.shiftright("n", 6).alias("block"), F.col("n").bitwiseAND(F.lit(63)).cast("int").alias("place")), "reach-seeds")
    levels = [written(numbered.select("block", F.col("seed").alias("node_id"), F.expr("shiftleft(1L, place)").alias("mask")), "reach-0")]
    frontier = levels[0]

    def places(mask: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.bit_get(mask, p) == 1)

    for d in range(1, depth + 1):
        moved = frontier.join(links, "node_id").groupBy("block", F.col("to").alias("node_id")).agg(F.bit_or("mask").alias("mask"))
        before = levels[0]
        for level in levels[1:]:
            before = before.unionByName(level)
        before = before.groupBy("block", "node_id").agg(F.bit_or("mask").alias("seen"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        frontier = written(moved.join(before, ["block", "node_id"], "left").select("block", "node_id", fresh.alias("mask")).where("mask <> 0"), f"reach-{d}")
        levels.append(frontier)
        if enough is not None and d < depth:
            count = None
            for level in levels[1:]:
                one = level if labels is None else level.join(labels.select("node_id"), "node_id", "left_semi")
                one = one.select("block", F.explode(places(F.col("mask"))).alias("place"))
                count = one if count is None else count.unionByName(one)
            done = count.groupBy("block", "place").agg(F.count("*").alias("n")).where(F.col("n") >= enough).groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("done"))
            open_ = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long"))))
            frontier = written(frontier.join(done, "block", "left").select("block", "node_id", open_.alias("mask")).where("mask <> 0"), f"reach-open-{d}")
    names = numbered.groupBy("block").agg(F.collect_list(F.struct("place", "seed")).alias("names"))
    out = None
    for d, level in enumerate(levels[1:], 1):
        one = level.withColumn("depth", F.lit(d))
        out = one if out is None else out.unionByName(one)
    out = out.join(names, "block") if labels is None else out.join(labels, "node_id").join(names, "block")
    found = F.transform(F.filter("names", lambda x: F.bit_get(F.col("mask"), x["place"]) == 1), lambda x: x["seed"])
    return out.select(F.explode(found).alias("seed"), "node_id", "depth", *[c for c in (labels.columns if labels is not None else []) if c != "node_id"])


def unused(nodes: DataFrame, edges: DataFrame, entry_points: Column) -> DataFrame:
    """Modules of the repository that nothing imports and that are no entry point."""
    imported = edges.select(F.col("dst_id").alias("node_id")).distinct()
    return nodes.where(F.col("file_path").isNotNull() & ~entry_points).join(imported, "node_id", "left_anti")


def import_cycles(edges: DataFrame, longest: int = 6, most: int | None = None) -> DataFrame:
    """Simple cycles of 2 to ``longest`` nodes, one for each set of members, written from its least node.

    Shorter ones come first, then by name; with ``most`` only so many are
    reported, and longer cycles aren't looked for once there are as many. Only
    nodes with both an inbound and an outbound edge take part, and a path only
    grows over nodes larger than its first one. A cycle is a path from its
    least node joined with a path back of as many edges or one less, so only
    paths of half the length are made.
    """
    links = edges.select("src_id", "dst_id").where("src_id <> dst_id").distinct()
    both = links.select(F.col("src_id").alias("n")).intersect(links.select(F.col("dst_id").alias("n")))
    links = written(links.join(both.withColumnRenamed("n", "src_id"), "src_id", "left_semi").join(both.withColumnRenamed("n", "dst_id"), "dst_id", "left_semi"), "cycle-links")
    # path: out from the first node, with both ends; tail: the nodes between the last one and the first on the way back
    ahead = links.where("src_id < dst_id").select(F.col("src_id").alias("first"), F.col("dst_id").alias("last"), F.array("src_id", "dst_id").alias("path"))
    back = links.where("dst_id < src_id").select(F.col("dst_id").alias("first"), F.col("src_id").alias("last"), F.array().cast("array<string>").alias("tail"))
    out = None
    for length in range(2, longest + 1):
        if length > 2 and length % 2:
            step = ahead.join(links.select(F.col("src_id").alias("last"), F.col("dst_id").alias("next")), "last").where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
            ahead = written(step.select("first", F.col("next").alias("last"), F.array_append("path", F.col("next")).alias("path")), f"cycle-ahead-{length}")
        elif length > 2:
            step = back.join(links.select(F.col("dst_id").alias("last"), F.col("src_id").alias("next")), "last").where((F.col("next") > F.col("first")) & (F.col("next") != F.col("last")) & ~F.array_contains("tail", F.col("next")))
            back = written(step.select("first", F.col("next").alias("last"), F.array_prepend("tail", F.col("last")).alias("tail")), f"cycle-back-{length}")
        closed = ahead.join(back, ["first", "last"]).where(~F.arrays_overlap("path", "tail")).select(F.concat("path", "tail").alias("nodes"))
        found = closed.groupBy(F.array_sort("nodes").alias("members")).agg(F.min(F.array_join("nodes", ">")).alias("cycle")).select("cycle", F.lit(length).alias("length"))
        found = written(found, f"cycles-{length}")
        out = found if out is None else out.unionByName(found)
        if most is not None and out.count() >= most:
            break
    return out if most is None else out.orderBy("length", "cycle").limit(most)


def merge_node(edges: DataFrame, loser: str, winner: str) -> DataFrame:
    def swap(c: str) -> Column:
        return F.when(F.col(c) == loser, F.lit(winner)).otherwise(F.col(c)).alias(c)

    return edges.where((F.col("src_id") == loser) | (F.col("dst_id") == loser)).select("edge_id", swap("src_id"), swap("dst_id"))


def project(triples: DataFrame) -> DataFrame:
    """Edges of statements (s, r, o, at, id, is_negation): a negation closes the open edge, a later statement opens another.

    A run of statements of one polarity counts once, from its first.
    """
    w = Window.partitionBy("s", "r", "o").orderBy("at", "id")
    turns = triples.withColumn("before", F.lag("is_negation").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("is_negation")))
    closed = F.lead("at").over(w)
    return turns.withColumn("invalid_at", closed).where("not is_negation").select("s", "r", "o", F.col("at").alias("valid_from"), "invalid_at")
