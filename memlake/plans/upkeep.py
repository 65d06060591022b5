"""Queries that keep the store in order: exports, vectors, verdicts, status, skills, maintenance; each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.functions import scoring as S
from memlake.functions import unicode as U
from memlake.operators import documents as D
from memlake.operators import graph as G
from memlake.operators import ledger as L
from memlake.operators import phrases as PH
from memlake.operators import vector as V
from memlake.plans import graph as PG
from memlake.plans import search as PS
from memlake.plans import store as PT
from memlake.sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def reg(name: str, transform, sql: str) -> None:
    add(name, lambda s, d: transform(X.doc_registry(s, d)), f"WITH {X.REGISTRY} {sql}" if not sql.startswith(",") else f"WITH {X.REGISTRY}{sql}")


# ---- export and vectors
add("s04_export_lines", lambda s, d: X.mem(s, d).select("memory_id", F.to_json(F.struct("memory_id", "memory_type", "subject", "relation", "object", "status", "access_count")).alias("line")),
    f"WITH {X.MEM} SELECT memory_id, '{{\"memory_id\":\"' || memory_id || '\",\"memory_type\":\"' || memory_type || '\",\"subject\":\"' || subject || '\",\"relation\":\"' || relation || '\",\"object\":\"' || object || '\",\"status\":\"' || status || '\",\"access_count\":' || access_count || '}}' AS line FROM mem")


def _upserted(s, d):
    """Every third vector is written again under a smaller number, every second of them without a vector."""
    v = X.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit("active").alias("status"))
    changes = X.read(s, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("seq"), (F.col("vec_id") % 100).alias("id"), F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("vector"), F.when(F.col("vec_id") % 2 == 0, "active").otherwise("archived").alias("status"))
    out = V.upsert(v.where("id % 5 <> 0"), changes)
    return out.select("id", F.size("vector").cast("long").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "status")


add("s16_vector_upsert", _upserted, """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), c AS (SELECT id % 100 AS id, arg_max(struct_pack(x := CASE WHEN id % 2 = 0 THEN x END, s := CASE WHEN id % 2 = 0 THEN 'active' ELSE 'archived' END), id) AS l FROM v WHERE id % 3 = 0 GROUP BY 1),
    u AS (SELECT coalesce(t.id, c.id) AS id, coalesce(c.l.x, t.x) AS x, coalesce(c.l.s, 'active') AS status FROM (SELECT * FROM v WHERE id % 5 <> 0) t FULL JOIN c ON t.id = c.id)
    SELECT id, CAST(len(x) AS BIGINT) AS width, round(list_sum(x), 4) AS total, status FROM u WHERE x IS NOT NULL""")


def _drawn(s, d):
    """The heaviest valid edges as dot and JSON lines, with names that can be drawn."""
    best = X.edges(s, d).where(G.valid_now()).orderBy(F.desc(F.col("weight") * F.col("confidence")), "edge_id").limit(500)
    names = X.nodes(s, d).select("node_id", R.diagram_label(F.col("display_name")).alias("name"))
    out = best.join(names.withColumnsRenamed({"node_id": "src_id", "name": "src"}), "src_id").join(names.withColumnsRenamed({"node_id": "dst_id", "name": "dst"}), "dst_id")
    dot = F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "relation", F.lit('"];'))
    return out.select("edge_id", dot.alias("dot"), F.to_json(F.struct("src", "relation", "dst")).alias("json"))


add("s21_graph_drawings", _drawn, f"""WITH {X.NODES}, {X.EDGES}, b AS (SELECT * FROM edges WHERE invalid_at IS NULL ORDER BY weight * confidence DESC, edge_id LIMIT 500)
    SELECT edge_id, '  "' || s.display_name || '" -> "' || t.display_name || '" [label="' || relation || '"];' AS dot, '{{"src":"' || s.display_name || '","relation":"' || relation || '","dst":"' || t.display_name || '"}}' AS json FROM b JOIN nodes s ON s.node_id = src_id JOIN nodes t ON t.node_id = dst_id""")

# ---- ledger
# Globs of paths with the type and tier that they imply, in order.
BUILTIN = [
    ("docs/adr/**", "adr", "T1"),
    ("**/adr/**", "adr", "T1"),
    ("docs/plans/**", "plan", None),
    ("**/PLAN*.md", "plan", None),
    ("**/*brainstorm*.md", "brainstorm", "T3"),
    ("**/TODO*.md", "todo", None),
    ("README*", "readme", None),
    ("**/README*.md", "readme", None),
    ("docs/spec/**", "spec", None),
    ("**/*audit*.md", "audit", None),
    ("**/*migration*.md", "migration", None),
    ("CODING_STANDARDS.md", "standard", "T1"),
    ("**/CONTRIBUTING*.md", "guide", None),
    ("docs/**", "guide", None),
]
PLACES = ["docs/adr/", "x/adr/", "docs/plans/", "src/", "docs/spec/", "docs/", "", "a/b/"]
FILES = ["PLAN", "my-brainstorm-", "TODO", "README", "an-audit-", "migration", "CONTRIBUTING", "n"]


def _typed(s, d):
    paths = X.read(s, d, "documents").select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, PLACES)), (F.col("doc_id") % 8 + 1).cast("int")), F.element_at(F.array(*map(F.lit, FILES)), (F.floor(F.col("doc_id") / 8) % 8 + 1).cast("int")), "doc_id", F.lit(".md")).alias("path"))
    kind, tier = D.glob_type(F.col("path"), BUILTIN)
    return paths.select("path", kind.alias("kind"), tier.alias("tier"))


def _like(value) -> str:
    return "CASE " + " ".join(f"WHEN path GLOB '{p.replace('**', '*')}' THEN '{value(n, t)}'" for p, n, t in BUILTIN)


add("p18_path_types", _typed, f"WITH p AS (SELECT {PLACES}[CAST(doc_id % 8 + 1 AS INT)] || {FILES}[CAST((doc_id // 8) % 8 + 1 AS INT)] || doc_id || '.md' AS path FROM documents) SELECT path, {_like(lambda n, t: n)} ELSE 'unknown' END AS kind, {_like(lambda n, t: t or 'T2')} ELSE 'T2' END AS tier FROM p")


reg("j18_supersession_chain", lambda r: D.superseding_chain(r.withColumn("superseded_by", F.when(F.col("num") % 50 < 49, F.concat(F.lit("D"), (F.col("num") + 1).cast("string"))))), """, c AS (SELECT doc_id, num, num - num % 50 + 49 AS target FROM registry WHERE num % 50 < 49), m AS (SELECT max(num) AS most FROM registry)
    SELECT doc_id, 'D' || least(target, most + 1) AS last, CAST(least(target, most + 1) - num AS INT) AS hops FROM c, m""")


def _indexed(s, d):
    """Index state after the journal: the last change of each path counts; removed and renamed-away paths are forgotten."""
    j = X.journal(s, d).where("path is not null")
    events = j.select("repo_id", "path", "seq", F.when(F.col("change") == "removed", "gone").otherwise("there").alias("is"))
    events = events.unionByName(j.where("old_path is not null").select("repo_id", F.col("old_path").alias("path"), "seq", F.lit("gone").alias("is")))
    return events.groupBy("repo_id", "path").agg(F.max_by("is", F.struct("seq", "is")).alias("is"), F.max("seq").alias("seq")).where("is = 'there'").select("repo_id", "path", "seq")


add("l19_index_state", _indexed, f"WITH {X.JOURNAL}, e AS (SELECT repo_id, path, seq, CASE WHEN change = 'removed' THEN 'gone' ELSE 'there' END AS state FROM journal WHERE path IS NOT NULL UNION ALL SELECT repo_id, old_path, seq, 'gone' FROM journal WHERE path IS NOT NULL AND old_path IS NOT NULL) SELECT repo_id, path, max(seq) AS seq FROM e GROUP BY ALL HAVING arg_max(state, (seq, state)) = 'there'")

# ---- words and skills
def _skilled(s, d):
    """Skills whose trigger, the first two words of any document, stands in what a user said."""
    skills = X.read(s, d, "documents").select(F.col("doc_id").alias("skill_id"), F.substring_index("text", " ", 2).alias("trigger")).where("contains(trigger, ' ')")
    said = X.read(s, d, "conversations").where("role = 'user'").selectExpr("conv_id * 1000 + turn as text_id", "text")
    return PH.matched_skills(said, skills).selectExpr("text_id div 1000 as conv_id", "text_id % 1000 as turn", "skill_id as doc_id")


add("j25_q06_trigger_match", _skilled, "WITH k AS (SELECT doc_id, lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS t FROM documents) SELECT conv_id, CAST(turn AS BIGINT) AS turn, doc_id FROM conversations c, k WHERE role = 'user' AND contains(t, ' ') AND contains(lower(c.text), t)")
add("x04_seed_rows", lambda s, d: X.read(s, d, "events").selectExpr("event_id", "concat('[\"a', user_id, '\",\"b', event_id % 7, '\"]') as seeds").select("event_id", F.posexplode(F.from_json("seeds", "array<string>")).alias("place", "seed")), "SELECT event_id, unnest([0, 1]) AS place, unnest(['a' || user_id, 'b' || (event_id % 7)]) AS seed FROM events")


# ---- graph
def _traversed(s, d):
    """Edges that a walk took and how often both their ends are mentioned by it: weights rise by 0.05 a walk, ends by one for each edge."""
    walked = X.edges(s, d).where("src_id like 'S%' and relation = 'manages'").where(G.valid_now())
    ends = walked.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("more"))
    nodes = X.nodes(s, d).join(ends, "node_id").select("node_id", (F.col("mention_count") + F.col("more")).alias("n"), F.lit("node").alias("kind"))
    return nodes.select("kind", F.col("node_id").alias("id"), F.col("n").cast("double").alias("value")).unionByName(walked.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.round(F.col("weight") + 0.05, 2).alias("value")))


add("l13_bump_traversed", _traversed, f"""WITH {X.NODES}, {X.EDGES}, w AS (SELECT * FROM edges WHERE src_id LIKE 'S%' AND relation = 'manages' AND invalid_at IS NULL), e AS (SELECT node_id, count(*) AS more FROM (SELECT src_id AS node_id FROM w UNION ALL SELECT dst_id FROM w) GROUP BY node_id)
    SELECT 'node' AS kind, node_id AS id, CAST(mention_count + more AS DOUBLE) AS value FROM nodes JOIN e USING (node_id) UNION ALL SELECT 'edge', edge_id, round(weight + CAST(0.05 AS DOUBLE), 2) FROM w""")


def _superseded(s, d):
    """A later belief of the same subject and relation with another object takes the place of the one before; the edge of that one is closed."""
    w = Window.partitionBy("user_id", "subject", "relation").orderBy("created_at", "memory_id")
    m = X.mem(s, d).where("status = 'active' and memory_type = 'belief'")
    nxt = m.withColumn("by", F.lead("memory_id").over(w)).withColumn("next_object", F.lead("object").over(w)).withColumn("closed_at", F.lead("created_at").over(w))
    out = nxt.where("by is not null and next_object <> object").select("memory_id", F.col("by").alias("superseded_by"), F.unix_micros(F.col("closed_at").cast("timestamp")).alias("closed_at"))
    edges = X.edges(s, d).where("belief_id is not null and invalid_at is null").select("edge_id", F.col("belief_id").alias("memory_id"))
    return out.join(edges, "memory_id", "left").select("memory_id", "superseded_by", "edge_id", F.when(F.col("edge_id").isNotNull(), F.col("closed_at")).alias("closed_at")).fillna({"edge_id": "-", "closed_at": -1})


add("l03_supersede_edges", _superseded, f"""WITH {X.MEM}, {X.EDGES}, n AS (SELECT memory_id, object, lead(memory_id) OVER w AS next_id, lead(object) OVER w AS next_object, lead(created_at) OVER w AS closed FROM mem WHERE status = 'active' AND memory_type = 'belief' WINDOW w AS (PARTITION BY user_id, subject, relation ORDER BY created_at, memory_id))
    SELECT memory_id, next_id AS superseded_by, coalesce(edge_id, '-') AS edge_id, CASE WHEN edge_id IS NULL THEN -1 ELSE epoch_us(closed) END AS closed_at FROM n LEFT JOIN (SELECT edge_id, belief_id FROM edges WHERE invalid_at IS NULL) e ON e.belief_id = n.memory_id WHERE next_id IS NOT NULL AND next_object <> object""")

# ---- maintenance
STEPS = [("decay", PT, "l10_daily_decay"), ("prune", PT, "l11_prune"), ("orphans", PG, "j09_orphan_edges"), ("stale nodes", PG, "j10_stale_nodes")]


def _maintained(s, d):
    """The daily pass: how many rows each of its steps touches."""
    out = None
    for step, plan, name in STEPS:
        one = plan.QUERIES[name](s, d).agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "n")
        out = one if out is None else out.unionByName(one)
    return out


add("l17_maintenance_pass", _maintained, " UNION ALL ".join(f"SELECT '{step}' AS step, count(*) AS n FROM ({plan.ORACLES[name]})" for step, plan, name in STEPS))


def _health(s, d):
    """State of the store by repository: local and foreign rows, the age of the last write, whether an index is there."""
    m = X.mem(s, d).where("status = 'active'")
    own = m.withColumn("is_local", F.col("repo_id").isNull() | (F.col("repo_id") == "r2"))
    indexed = X.read(s, d, "embeddings").select(F.col("vec_id").alias("event_id"), F.lit(1).alias("indexed"))
    return own.join(indexed, "event_id", "left").groupBy("is_local", "memory_type").agg(F.count("*").alias("n"), F.count("indexed").alias("indexed"), F.round(F.min(S.days_between(F.lit(X.NOW_E).cast("timestamp_ntz"), F.col("updated_at"))), 4).alias("newest_days"))


add("q31_store_health", _health, f"WITH {X.MEM} SELECT repo_id IS NULL OR repo_id = 'r2' AS is_local, memory_type, count(*) AS n, count(vec_id) AS indexed, round(min(epoch_us(TIMESTAMP '{X.NOW_E}') - epoch_us(updated_at)) / CAST(86400000000 AS DOUBLE), 4) AS newest_days FROM mem LEFT JOIN embeddings ON vec_id = event_id WHERE status = 'active' GROUP BY ALL".replace("min(epoch_us(", "min((epoch_us(").replace("epoch_us(updated_at)) /", "epoch_us(updated_at))) /"))


# ---- what is shown within a budget
CONTEXT_TOKENS, MAP_TOKENS = 900, 300


def _context(s, d):
    """The rows of the context block that fit the budget of tokens: the oldest are dropped first."""
    rows = PT.QUERIES["q02_session_context"](s, d).join(X.mem(s, d).select("memory_id", "subject", "relation", "object", "updated_at"), "memory_id")
    line = F.repeat(F.concat(F.lit("- "), F.concat_ws(" ", "subject", "relation", "object")), 30)
    rows = rows.withColumn("tokens", F.ceil(F.length(line) / 4))
    kept = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("updated_at"), "memory_id"))
    return rows.withColumn("running", kept).where(F.col("running") <= CONTEXT_TOKENS).select("memory_id", "running")


add("q02_context_budget", _context, f"""WITH c AS ({PT.ORACLES["q02_session_context"]}), {X.MEM}, r AS (SELECT memory_id, updated_at, (length(repeat('- ' || subject || ' ' || relation || ' ' || object, 30)) + 3) // 4 AS tokens FROM c JOIN mem USING (memory_id)),
    k AS (SELECT memory_id, sum(tokens) OVER (ORDER BY updated_at DESC, memory_id) AS running FROM r) SELECT memory_id, CAST(running AS BIGINT) AS running FROM k WHERE running <= {CONTEXT_TOKENS}""")


def _mapped(r):
    """Lines of the knowledge map, each capped, as many as fit its budget."""
    rank = F.row_number().over(Window.partitionBy("tier", "lifecycle").orderBy("rel_path"))
    groups = r.withColumn("rn", rank).groupBy("tier", "lifecycle").agg(F.count("*").alias("n"), F.concat_ws(", ", F.sort_array(F.collect_list(F.when(F.col("rn") <= 3, F.col("rel_path"))))).alias("paths"))
    line = R.capped(F.concat(F.lit("- "), "tier", F.lit(" "), "lifecycle", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), "paths", F.lit(")")), 60)
    lines = groups.select("tier", "lifecycle", line.alias("line"))
    running = F.sum(F.ceil(F.length("line") / 4)).over(Window.partitionBy(F.lit(0)).orderBy("tier", "lifecycle"))
    return lines.withColumn("running", running).where(F.col("running") <= MAP_TOKENS // 2).select("line", "running")


reg("q23_map_budget", _mapped, f""", k AS (SELECT *, row_number() OVER (PARTITION BY tier, lifecycle ORDER BY rel_path) AS rn FROM registry), g AS (SELECT tier, lifecycle, '- ' || tier || ' ' || lifecycle || ': ' || count(*) || ' (' || string_agg(rel_path, ', ' ORDER BY rel_path) FILTER (rn <= 3) || ')' AS line FROM k GROUP BY tier, lifecycle),
    c AS (SELECT tier, lifecycle, CASE WHEN length(line) > 60 THEN substr(line, 1, 59) || '…' ELSE line END AS line FROM g), s AS (SELECT line, sum((length(line) + 3) // 4) OVER (ORDER BY tier, lifecycle) AS running FROM c)
    SELECT line, CAST(running AS BIGINT) AS running FROM s WHERE running <= {MAP_TOKENS // 2}""")


def _merged(s, d):
    """Suppliers merged into the next one: their edges move, their names become aliases, and each merge is noted."""
    pairs = X.read(s, d, "supplier").where("s_suppkey % 10 = 3").selectExpr("concat('S', s_suppkey) as loser", "concat('S', s_suppkey + 1) as winner", "lower(s_name) as name")
    nodes = X.nodes(s, d).where("entity_type = 'supplier'").select(F.col("node_id").alias("winner"))
    pairs = pairs.join(nodes, "winner", "left_semi")
    edges = X.edges(s, d).select("edge_id", "src_id", "dst_id")
    a = pairs.select(F.col("loser").alias("src_id"), F.col("winner").alias("new_src"))
    b = pairs.select(F.col("loser").alias("dst_id"), F.col("winner").alias("new_dst"))
    moved = edges.join(a, "src_id", "left").join(b, "dst_id", "left").where("new_src is not null or new_dst is not null")
    out = moved.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.concat_ws(">", F.coalesce("new_src", "src_id"), F.coalesce("new_dst", "dst_id")).alias("value"))
    out = out.unionByName(pairs.select(F.lit("alias").alias("kind"), F.col("name").alias("id"), F.col("winner").alias("value")))
    return out.unionByName(pairs.select(F.lit("audit").alias("kind"), F.col("loser").alias("id"), F.concat(F.lit("merged into "), "winner").alias("value")))


add("q14_merge_nodes", _merged, f"""WITH {X.NODES}, {X.EDGES}, p AS (SELECT 'S' || s_suppkey AS loser, 'S' || (s_suppkey + 1) AS winner, lower(s_name) AS name FROM supplier WHERE s_suppkey % 10 = 3 AND 'S' || (s_suppkey + 1) IN (SELECT node_id FROM nodes WHERE entity_type = 'supplier')),
    m AS (SELECT edge_id, coalesce(a.winner, src_id) || '>' || coalesce(b.winner, dst_id) AS value FROM edges LEFT JOIN p a ON a.loser = src_id LEFT JOIN p b ON b.loser = dst_id WHERE a.winner IS NOT NULL OR b.winner IS NOT NULL)
    SELECT 'edge' AS kind, edge_id AS id, value FROM m UNION ALL SELECT 'alias', name, winner FROM p UNION ALL SELECT 'audit', loser, 'merged into ' || winner FROM p""")
