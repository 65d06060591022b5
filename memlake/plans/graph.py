"""Queries over the knowledge graph and the import graph, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators import graph as G
from memlake.operators import reaching as RE
from memlake.sources import fixtures as X
from memlake.sources.scratch import written

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


KG = f"{X.NODES}, {X.EDGES}"
AS_OF = "1998-06-01 00:00:00"


def _seeds(spark, d, n: int = 3):
    return X.nodes(spark, d).where(F.expr(f"node_id in ({', '.join(repr(f'S{k}') for k in range(1, n + 1))})"))


def _level(d: int, fanout: int, last: int) -> str:
    """One level of the walk: rows of level d from level d-1."""
    source = "SELECT node_id AS seed, node_id, CAST([] AS VARCHAR[]) AS path FROM seeds" if d == 1 else f"SELECT seed, node_id, path FROM w{d - 1}"
    expand = "" if d == 1 else " AND n.expandable = 1"
    return f"""w{d} AS (SELECT w.seed, s.dst AS node_id, s.edge_id, {d} AS depth, CAST({0.6**d!r} AS DOUBLE) * s.confidence AS score, list_append(w.path, s.edge_id) AS path
    FROM ({source}) w JOIN nodes n ON n.node_id = w.node_id{expand} JOIN steps s ON s.here = w.node_id WHERE NOT list_contains(w.path, s.edge_id))"""


def _walk_sql(seeds: str, valid: str, depth: int, fanout: int = 6) -> str:
    levels = ", ".join(_level(d, fanout, depth) for d in range(1, depth + 1))
    union = " UNION ALL ".join(f"SELECT * FROM w{d}" for d in range(1, depth + 1))
    return f"""WITH {KG}, seeds AS (SELECT unnest([{seeds}]) AS node_id), valid AS (SELECT * FROM edges WHERE {valid}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY weight * confidence DESC, edge_id) AS ro, row_number() OVER (PARTITION BY dst_id ORDER BY weight * confidence DESC, edge_id) AS ri FROM valid),
    steps AS (SELECT DISTINCT edge_id, src_id AS here, dst_id AS dst, confidence FROM ranked WHERE ro <= {fanout} UNION SELECT DISTINCT edge_id, dst_id, src_id, confidence FROM ranked WHERE ri <= {fanout}),
    {levels}, walk AS ({union})"""


def _traverse_sql(seeds: str, valid: str, depth: int = 2, limit: int = 50) -> str:
    return _walk_sql(seeds, valid, depth) + f""", b AS (SELECT *, row_number() OVER (PARTITION BY seed, edge_id ORDER BY score DESC, depth, array_to_string(path, '>')) AS pick FROM walk),
    p AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, depth, edge_id) AS place FROM b WHERE pick = 1)
    SELECT seed, edge_id, node_id AS reached_id, depth, round(score, 6) AS score FROM p WHERE place <= {limit}"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


S3 = "'S1', 'S2', 'S3'"
add("q07_traverse_now", lambda s, d: _rounded(G.traverse(X.edges(s, d).where(G.valid_now()), X.nodes(s, d), _seeds(s, d))), _traverse_sql(S3, "invalid_at IS NULL"))
add(
    "q07_traverse_as_of",
    lambda s, d: _rounded(G.traverse(X.edges(s, d).where(G.valid_at(F.lit(AS_OF).cast("timestamp_ntz"))), X.nodes(s, d), _seeds(s, d))),
    _traverse_sql(S3, f"valid_from <= TIMESTAMP '{AS_OF}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AS_OF}')"),
)
add("q07_traverse_relation", lambda s, d: _rounded(G.traverse(X.edges(s, d).where(G.valid_now() & (F.col("relation") == "manages")), X.nodes(s, d), _seeds(s, d))), _traverse_sql(S3, "invalid_at IS NULL AND relation = 'manages'"))
add(
    "q07_traverse_all_suppliers",
    lambda s, d: _rounded(G.traverse(X.edges(s, d).where(G.valid_now()), X.nodes(s, d), X.nodes(s, d).where("entity_type = 'supplier'"), limit=12)),
    _traverse_sql("'S0'", "invalid_at IS NULL", 2, 12).replace("SELECT unnest(['S0']) AS node_id", "SELECT node_id FROM nodes WHERE entity_type = 'supplier'"),
)
add(
    "q08_best_path",
    lambda s, d: G.best_paths(X.edges(s, d).where(G.valid_now()), X.nodes(s, d), _seeds(s, d), F.col("node_id").startswith("S"), 3).withColumn("score", F.round("score", 6)),
    _walk_sql(S3, "invalid_at IS NULL", 3)
    + """ SELECT seed, node_id, depth, round(score, 6) AS score, trail FROM (SELECT *, array_to_string(path, '>') AS trail, row_number() OVER (PARTITION BY seed, node_id ORDER BY depth, score DESC, array_to_string(path, '>')) AS pick FROM walk WHERE node_id LIKE 'S%' AND node_id <> seed) WHERE pick = 1""",
)
add(
    "q09_entity_card",
    lambda s, d: _rounded(G.traverse(X.edges(s, d).where(G.valid_now()), X.nodes(s, d), X.nodes(s, d).where("node_id = 'S1'"), 1, 6, 0.6, 10)).drop("seed").withColumn("part", F.lit("current")).unionByName(
        X.edges(s, d).where("(src_id = 'S1' or dst_id = 'S1') and invalid_at is not null").orderBy(F.desc("invalid_at"), "edge_id").limit(10).select("edge_id", F.col("dst_id").alias("reached_id"), F.lit(1).alias("depth"), F.col("confidence").alias("score"), F.lit("history").alias("part"))
    ),
    f"""SELECT edge_id, reached_id, depth, score, 'current' AS part FROM ({_traverse_sql("'S1'", "invalid_at IS NULL", 1, 10)})
    UNION ALL SELECT * FROM (WITH {KG} SELECT edge_id, dst_id AS reached_id, 1 AS depth, confidence AS score, 'history' AS part FROM edges WHERE (src_id = 'S1' OR dst_id = 'S1') AND invalid_at IS NOT NULL ORDER BY invalid_at DESC, edge_id LIMIT 10)""",
)
add("q10_neighbours", lambda s, d: _rounded(G.traverse(X.edges(s, d).where(G.valid_now()), X.nodes(s, d), _seeds(s, d), 1, 6, 0.6, 12)), _traverse_sql(S3, "invalid_at IS NULL", 1, 12))
add("p10_valid_now", lambda s, d: X.edges(s, d).where(G.valid_now()).groupBy("relation").agg(F.count("*").alias("n")), f"WITH {KG} SELECT relation, count(*) AS n FROM edges WHERE invalid_at IS NULL GROUP BY ALL")
add("p11_valid_as_of", lambda s, d: X.edges(s, d).where(G.valid_at(F.lit(AS_OF).cast("timestamp_ntz"))).groupBy("relation").agg(F.count("*").alias("n")), f"WITH {KG} SELECT relation, count(*) AS n FROM edges WHERE valid_from <= TIMESTAMP '{AS_OF}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AS_OF}') GROUP BY ALL")


def _candidates(s, d):
    edges, seeds = X.edges(s, d).where(G.valid_now()), _seeds(s, d).select(F.col("node_id").alias("seed"), "node_id")
    return G._neighbours(seeds, edges).distinct()


add("j03_candidate_expansion", _candidates, f"WITH {KG} SELECT DISTINCT seed, node_id FROM (SELECT src_id AS seed, dst_id AS node_id FROM edges WHERE invalid_at IS NULL AND src_id IN ({S3}) UNION ALL SELECT dst_id, src_id FROM edges WHERE invalid_at IS NULL AND dst_id IN ({S3}))")
add(
    "w01_w02_fanout_steps",
    lambda s, d: G.oriented_steps(X.edges(s, d).where(G.valid_now()), X.nodes(s, d).where("entity_type = 'supplier'"), 6).select("edge_id", "at", "to"),
    f"""WITH {KG}, r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY weight * confidence DESC, edge_id) AS ro, row_number() OVER (PARTITION BY dst_id ORDER BY weight * confidence DESC, edge_id) AS ri FROM edges WHERE invalid_at IS NULL)
    SELECT edge_id, src_id AS at, dst_id AS "to" FROM r WHERE ro <= 6 AND src_id LIKE 'S%' UNION SELECT edge_id, dst_id, src_id FROM r WHERE ri <= 6 AND dst_id LIKE 'S%'""",
)
add(
    "a04_expandable",
    lambda s, d: G.expandable(X.nodes(s, d), X.edges(s, d)),
    f"""WITH {KG}, g AS (SELECT node_id, count(*) AS c FROM (SELECT src_id AS node_id FROM edges WHERE invalid_at IS NULL UNION ALL SELECT dst_id FROM edges WHERE invalid_at IS NULL) GROUP BY 1)
    SELECT n.node_id, coalesce(c, 0) AS degree, CASE WHEN coalesce(c, 0) <= 50 THEN 1 ELSE 0 END AS expandable FROM nodes n LEFT JOIN g ON n.node_id = g.node_id""",
)
_BELIEFS = "b AS (SELECT * FROM mem WHERE status = 'active' AND memory_type = 'belief')"


def _beliefs(s, d):
    return X.mem(s, d).where("status = 'active' and memory_type = 'belief'")


add("j08_refresh_confidence", lambda s, d: G.refreshed_confidence(X.edges(s, d), _beliefs(s, d)), f"WITH {KG}, {X.MEM}, {_BELIEFS} SELECT edge_id, b.confidence AS confidence FROM edges e JOIN b ON e.belief_id = b.memory_id WHERE e.invalid_at IS NULL AND e.confidence <> b.confidence")
add("j09_orphan_edges", lambda s, d: G.orphaned(X.edges(s, d), _beliefs(s, d)), f"WITH {KG}, {X.MEM}, {_BELIEFS} SELECT edge_id FROM edges e WHERE invalid_at IS NULL AND belief_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.memory_id = e.belief_id)")
add(
    "j10_stale_nodes",
    lambda s, d: G.stale_nodes(X.nodes(s, d), X.edges(s, d), F.lit("2001-10-03 00:00:00").cast("timestamp_ntz")),
    f"WITH {KG} SELECT node_id FROM nodes n WHERE status = 'active' AND mention_count <= 1 AND updated_at < TIMESTAMP '2001-10-03 00:00:00' AND node_id NOT IN (SELECT src_id FROM edges WHERE invalid_at IS NULL UNION SELECT dst_id FROM edges WHERE invalid_at IS NULL)",
)


add("q14_merge_nodes", lambda s, d: G.merge_node(X.edges(s, d), "S2", "S1"), f"WITH {KG} SELECT edge_id, CASE WHEN src_id = 'S2' THEN 'S1' ELSE src_id END AS src_id, CASE WHEN dst_id = 'S2' THEN 'S1' ELSE dst_id END AS dst_id FROM edges WHERE src_id = 'S2' OR dst_id = 'S2'")
QUERIES["j27_merge_remap"], ORACLES["j27_merge_remap"] = QUERIES["q14_merge_nodes"], ORACLES["q14_merge_nodes"]


def _export(s, d):
    best = X.edges(s, d).where(G.valid_now()).orderBy(F.desc(F.col("weight") * F.col("confidence")), "edge_id").limit(500)
    names = X.nodes(s, d).select("node_id", "display_name")
    out = best.join(names.withColumnsRenamed({"node_id": "src_id", "display_name": "src_name"}), "src_id").join(names.withColumnsRenamed({"node_id": "dst_id", "display_name": "dst_name"}), "dst_id")
    return out.select("edge_id", F.concat("src_id", F.lit(' -->|'), "relation", F.lit("| "), "dst_id").alias("line"), "src_name", "dst_name")


add("s21_graph_export", _export, f"""WITH {KG}, b AS (SELECT * FROM edges WHERE invalid_at IS NULL ORDER BY weight * confidence DESC, edge_id LIMIT 500)
    SELECT edge_id, src_id || ' -->|' || relation || '| ' || dst_id AS line, s.display_name AS src_name, t.display_name AS dst_name FROM b JOIN nodes s ON s.node_id = src_id JOIN nodes t ON t.node_id = dst_id""")
# ---- import graph
CODE = f"{X.CODE_NODES}, {X.CODE_EDGES}, imports AS (SELECT src_id, dst_id FROM code_edges WHERE NOT invalid)"


def _imports(s, d):
    return X.code_edges(s, d).where("not invalid")


def _walked(s, d):
    """Imports, written as they are read often, the modules that import, and names."""
    imports = written(_imports(s, d).select("src_id", "dst_id"), "imports")
    return imports, imports.select(F.col("src_id").alias("node_id")).distinct(), X.code_nodes(s, d).select("node_id", F.col("qualified_name").alias("label"))


def _reach_sql(reverse: bool, depth: int = 3) -> str:
    a, b = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    return f"""WITH RECURSIVE {CODE}, seeds AS (SELECT DISTINCT src_id AS node_id FROM imports),
    r(seed, node_id, depth) AS (SELECT node_id, node_id, 0 FROM seeds UNION SELECT r.seed, i.{b}, r.depth + 1 FROM r JOIN imports i ON i.{a} = r.node_id WHERE r.depth < {depth}),
    m AS (SELECT seed, node_id, min(depth) AS depth FROM r GROUP BY ALL)
    SELECT seed, qualified_name, CAST(depth AS INT) AS depth FROM m JOIN code_nodes USING (node_id) WHERE depth > 0"""


def _named(s, d, reverse):
    imports, seeds, names = _walked(s, d)
    return RE.all_reached(imports, seeds, 3, names, reverse).select("seed", F.col("label").alias("qualified_name"), "depth")


add("q16_dependencies", lambda s, d: _named(s, d, False), _reach_sql(False))
add("q17_impact", lambda s, d: _named(s, d, True), _reach_sql(True))
add("j12_both_ways", lambda s, d: _imports(s, d).select(F.col("src_id").alias("node_id")).intersect(_imports(s, d).select(F.col("dst_id").alias("node_id"))), f"WITH {CODE} SELECT src_id AS node_id FROM imports INTERSECT SELECT dst_id FROM imports")
add(
    "q19_import_cycles",
    lambda s, d: G.import_cycles(_imports(s, d).join(X.code_nodes(s, d).where("file_path is not null").select(F.col("node_id").alias("src_id")), "src_id", "left_semi"), 6, 20),
    f"""WITH {CODE}, l AS (SELECT DISTINCT src_id AS a, dst_id AS b FROM imports WHERE src_id IN (SELECT node_id FROM code_nodes WHERE file_path IS NOT NULL) AND dst_id IN (SELECT src_id FROM imports JOIN code_nodes ON node_id = src_id WHERE file_path IS NOT NULL)),
    c AS (SELECT x.a || '>' || x.b AS cycle, 2 AS length FROM l x JOIN l y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b
      UNION ALL SELECT min(x.a || '>' || x.b || '>' || y.b), 3 FROM l x JOIN l y ON x.b = y.a JOIN l z ON y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b GROUP BY list_sort([x.a, x.b, y.b]))
    SELECT cycle, length FROM c ORDER BY length, cycle LIMIT 20""",
)


def _health(s, d):
    """Issues of the graph: valid edges without their belief, with an end that is no node, and nodes of one name."""
    edges, nodes = X.edges(s, d).where("dst_id not like '%7'"), X.nodes(s, d).where("mention_count <> 3")
    orphans = G.orphaned(edges, _beliefs(s, d)).select(F.lit("orphan").alias("issue"), F.col("edge_id").alias("what"))
    ends = edges.where("invalid_at is null").select("edge_id", F.explode(F.array("src_id", "dst_id")).alias("node_id"))
    dangling = ends.join(nodes.select("node_id"), "node_id", "left_anti").select(F.lit("dangling").alias("issue"), F.col("edge_id").alias("what")).distinct()
    same = nodes.groupBy(F.lower("display_name").alias("what")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("same name").alias("issue"), "what")
    return orphans.unionByName(dangling).unionByName(same)


add("q15_graph_doctor", _health, f"""WITH {KG}, {X.MEM}, {_BELIEFS}, e AS (SELECT * FROM edges WHERE dst_id NOT LIKE '%7'), n AS (SELECT * FROM nodes WHERE mention_count <> 3)
    SELECT 'orphan' AS issue, edge_id AS what FROM e WHERE invalid_at IS NULL AND belief_id IS NOT NULL AND belief_id NOT IN (SELECT memory_id FROM b)
    UNION ALL SELECT 'dangling', edge_id FROM e WHERE invalid_at IS NULL AND (src_id NOT IN (SELECT node_id FROM n) OR dst_id NOT IN (SELECT node_id FROM n))
    UNION ALL SELECT 'same name', lower(display_name) FROM n GROUP BY lower(display_name) HAVING count(*) > 1""")


def _ordered(s, d):
    """The first 200 names of each seed's dependencies, nearest first."""
    imports, seeds, names = _walked(s, d)
    first = RE.nearest_reached(imports, seeds, 3, names, 200)
    return first.select("seed", F.size("labels").cast("long").alias("n"), F.array_max("depths").alias("deepest"), F.get("labels", F.size("labels") - 1).alias("last"))


add("k09_dependency_order", _ordered, f"""WITH a AS ({_reach_sql(False)}), k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, qualified_name) AS place FROM a) SELECT seed, count(*) AS n, max(depth) AS deepest, arg_max(qualified_name, place) AS last FROM k WHERE place <= 200 GROUP BY seed""")
add("q30_code_health", lambda s, d: X.code_nodes(s, d).groupBy("status").agg(F.count("*").alias("modules"), F.count_if(F.col("file_path").isNull()).alias("external")), f"WITH {CODE} SELECT status, count(*) AS modules, count(*) FILTER (file_path IS NULL) AS external FROM code_nodes GROUP BY ALL")
ENTRY = "(^|/)(test_|conftest)|/1[0-9]*[.]py$"
add("q18_unused_modules", lambda s, d: G.unused(X.code_nodes(s, d), _imports(s, d), F.col("file_path").rlike(ENTRY)).select("qualified_name"), f"WITH {CODE} SELECT qualified_name FROM code_nodes WHERE file_path IS NOT NULL AND NOT regexp_matches(file_path, '(^|/)(test_|conftest)|/1[0-9]*[.]py$') AND node_id NOT IN (SELECT dst_id FROM imports)")
