"""Queries of the ledger, commits, imports, saving and journals, each with its oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.functions import text as T
from memlake.operators import graph as G
from memlake.operators import ledger as L
from memlake.operators import modules as M
from memlake.operators import nested as N
from memlake.operators import saving as SV
from memlake.operators import store as O
from memlake.plans.graph import CODE
from memlake.sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def both(name: str, table: str, spark_expr: str, sql_expr: str | None = None, key: str = "") -> None:
    """One expression over a table, in both dialects."""
    add(name, lambda s, d: X.read(s, d, table).selectExpr(key, spark_expr), f"SELECT {key}, {sql_expr or spark_expr} FROM {table}")


def NOW():
    return F.lit("2002-01-01").cast("date")


# ---- Markdown
add("t17_extract_refs", lambda s, d: X.markdown(s, d).select("page_id", F.explode(L.extract_refs(F.col("text"))).alias("r")).select("page_id", "r.kind", "r.value"),
    """WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages),
    l AS (SELECT page_id, CASE WHEN regexp_matches(h, '^https?://') THEN 'url' ELSE 'doc' END AS kind, CASE WHEN regexp_matches(h, '^https?://') THEN h || '.md' ELSE regexp_replace(h || '.md', '#.*$', '') END AS value FROM h WHERE NOT regexp_matches(h, '[)\\s]'))
    SELECT DISTINCT page_id, CASE WHEN kind = 'doc' AND NOT ends_with(value, '.md') THEN 'file' ELSE kind END AS kind, value FROM l WHERE kind = 'url' OR (regexp_matches(value, '^[A-Za-z0-9_.@/\\\\-]+$') AND (contains(value, '/') OR ends_with(value, '.md')))
    UNION SELECT page_id, 'file', 'src/p' || (page_id % 7) || '.py' FROM pages UNION SELECT page_id, 'file', 'src/p' || (page_id % 5) || '.py' FROM pages
    UNION SELECT page_id, 'symbol', 'src/p' || (page_id % 5) || '.py::run' FROM pages UNION SELECT page_id, 'issue', CAST(page_id % 50 AS VARCHAR) FROM pages""")


def _front(s, d):
    m = X.markdown(s, d).select("page_id", L.frontmatter(F.col("text")).alias("f")).where("f is not null")
    return m.select("page_id", *[F.col("f")[k].alias(f"its_{k}") for k in ("status", "type", "tier")])


add("t18_frontmatter", _front, "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Archived' ELSE 'fulfilled' END AS its_status, 'Plan' AS its_type, 't' || (page_id % 5) AS its_tier FROM pages WHERE page_id % 3 = 0")
add("a09_checkbox_state", lambda s, d: X.markdown(s, d).select("page_id", L.checkboxes(F.col("text")).alias("b")).where("b is not null").select("page_id", "b.checked", "b.total", "b.ratio"),
    "WITH b AS (SELECT page_id, page_id % 4 + CAST(page_id % 5 = 0 AS INT) AS x, page_id % 3 AS o FROM pages) SELECT page_id, CAST(x AS INT) AS checked, CAST(x + o AS INT) AS total, round(x / CAST(x + o AS DOUBLE), 3) AS ratio FROM b WHERE x + o > 0")


def _overridden(s, d):
    m = X.markdown(s, d).select(F.col("page_id").cast("string").alias("doc_id"), "rel_path", L.frontmatter(F.col("text")).alias("front"), F.lit("guide").alias("doc_type"), F.lit("T2").alias("tier"), F.lit("active").alias("lifecycle"), F.lit(None).cast("string").alias("superseded_by"))
    m = m.withColumn("front", F.when(F.col("doc_id").cast("int") % 8 == 1, F.create_map(F.lit("supersedes"), F.concat(F.lit("docs/p"), (F.col("doc_id").cast("int") + 1).cast("string"), F.lit(".md")))).otherwise(F.col("front")))
    return L.with_frontmatter(m, F.col("front")).select("doc_id", "doc_type", "tier", "lifecycle", "type_source", "superseded_by")


add("l22_frontmatter_overrides", _overridden, """WITH p AS (SELECT page_id AS k, page_id % 3 = 0 AND page_id % 8 <> 1 AS f FROM pages),
    b AS (SELECT *, CASE WHEN f THEN CASE WHEN k % 2 = 0 THEN 'archived' ELSE 'fulfilled' END ELSE 'active' END AS own, k > 0 AND (k - 1) % 8 = 1 AS hit FROM p)
    SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN f THEN 'plan' ELSE 'guide' END AS doc_type, CASE WHEN f AND k % 5 <= 3 THEN 'T' || (k % 5) ELSE 'T2' END AS tier, CASE WHEN hit THEN 'superseded' ELSE own END AS lifecycle,
      CASE WHEN f THEN 'frontmatter' ELSE 'heuristic' END AS type_source, CASE WHEN hit THEN CAST(k - 1 AS VARCHAR) END AS superseded_by FROM b""")
_REG = lambda s, d: X.read(s, d, "documents").where("doc_id % 7 <> 0").select(F.concat("source", F.lit("/"), "doc_id").alias("rel_path"), F.md5("text").alias("hash"))
_FILES = lambda s, d: X.read(s, d, "documents").where("doc_id % 5 <> 0").select(F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("new"), "doc_id")).otherwise(F.col("doc_id").cast("string"))).alias("rel_path"), F.md5(F.when(F.col("doc_id") % 13 == 0, F.lit("x")).otherwise(F.col("text"))).alias("hash"))
_SCAN = """r AS (SELECT source || '/' || doc_id AS rel_path, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0),
    f AS (SELECT source || '/' || CASE WHEN doc_id % 11 = 0 THEN 'new' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS rel_path, md5(CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0),
    g AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY rel_path) AS rn FROM r WHERE rel_path NOT IN (SELECT rel_path FROM f)), n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY rel_path) AS rn FROM f WHERE rel_path NOT IN (SELECT rel_path FROM r)),
    m AS (SELECT g.rel_path, n.rel_path AS new_path FROM g JOIN n USING (h, rn)),
    sc AS (SELECT coalesce(r.rel_path, f.rel_path) AS rel_path, CASE WHEN m.new_path IS NOT NULL THEN 'moved' WHEN f.h IS NULL THEN 'missing' WHEN r.h IS NULL THEN 'new' WHEN r.h <> f.h THEN 'changed' ELSE 'unchanged' END AS action, m.new_path
      FROM r FULL JOIN f ON r.rel_path = f.rel_path LEFT JOIN m ON m.rel_path = r.rel_path WHERE NOT (r.h IS NULL AND f.rel_path IN (SELECT new_path FROM m)))"""
add("q20_ledger_scan", lambda s, d: L.scan_ledger(_REG(s, d), _FILES(s, d)), f"WITH {_SCAN} SELECT rel_path, action, new_path FROM sc")
add("a17_scan_summary", lambda s, d: L.summary(L.scan_ledger(_REG(s, d), _FILES(s, d))), f"WITH {_SCAN} SELECT count(*) AS seen, " + ", ".join(f"count(*) FILTER (action = '{a}') AS \"{a}\"" for a in ("new", "changed", "moved", "missing", "unchanged")) + " FROM sc")


def _restored(s, d):
    r = X.doc_registry(s, d)
    moved = r.select("doc_id", "lifecycle", F.when(F.col("num") % 3 == 0, F.concat(F.lit("archive/"), "rel_path")).otherwise(F.col("rel_path")).alias("rel_path"))
    said = r.where("num % 4 <> 0").selectExpr("doc_id", "'archived' as verdict", "explode(array(struct(1 as at, 'active' as prior), struct(2 as at, 'fulfilled' as prior))) as x").select("doc_id", "verdict", "x.*")
    return L.unarchived(moved, said, "archive/")


add("l24_unarchived", _restored, f"WITH {X.REGISTRY} SELECT doc_id, CASE WHEN lifecycle = 'archived' AND num % 3 <> 0 THEN CASE WHEN num % 4 <> 0 THEN 'fulfilled' ELSE 'active' END ELSE lifecycle END AS lifecycle FROM registry")


def _note_lines(s, d):
    rows = X.markdown(s, d).select(F.col("page_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return L.importable_lines(rows)


add("s13_importable_lines", _note_lines, """WITH p AS (SELECT page_id AS doc, page_id % 3 = 0 AS f, array_to_string(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: '[x](' || h || '.md)'), ' ') AS links FROM pages),
    l AS (SELECT doc, CASE WHEN f THEN 5 ELSE 0 END AS n, links AS line FROM p UNION ALL SELECT doc, CASE WHEN f THEN 9 ELSE 4 END, '`src/p' || (doc % 7) || '.py` and src/p' || (doc % 5) || '.py::run (#' || (doc % 50) || ')' FROM p
      UNION ALL SELECT doc, 1, 'status: ' || CASE WHEN doc % 2 = 0 THEN 'Archived' ELSE '"fulfilled"' END FROM p WHERE f UNION ALL SELECT doc, 2, 'type: Plan' FROM p WHERE f UNION ALL SELECT doc, 3, 'tier: t' || (doc % 5) FROM p WHERE f
      UNION ALL SELECT doc, CASE WHEN f THEN 10 ELSE 5 END + doc % 4 + doc % 3, '-[X] tight' FROM p WHERE doc % 5 = 0 UNION ALL SELECT doc, CASE WHEN f THEN 11 ELSE 6 END + doc % 4 + doc % 3, '[x] plus' FROM p WHERE doc % 5 = 0
      UNION ALL SELECT doc, CASE WHEN f THEN 10 ELSE 5 END + unnest(range(0, doc % 4)), '[x] done' FROM p UNION ALL SELECT doc, CASE WHEN f THEN 10 ELSE 5 END + doc % 4 + unnest(range(0, doc % 3)), '[ ] open' FROM p)
    SELECT doc, CAST(n AS INT) AS n, trim(line) AS line FROM l WHERE length(trim(line)) >= 8""")

# ---- commits
_AGE = "(DATE '2002-01-01' - CAST(ts AS DATE))"
add("j19_last_touch", lambda s, d: L.last_touch(X.commits(s, d), NOW()).select("path", "author", F.col("age_days").cast("long").alias("age_days")),
    f"WITH {X.COMMITS}, l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha DESC) AS rn FROM touches) SELECT path, author, CAST(greatest(0, {_AGE}) AS BIGINT) AS age_days FROM l WHERE rn = 1")


def _churned(s, d):
    docs = X.read(s, d, "part").where("p_partkey % 10 = 0")
    targets = docs.selectExpr("concat('docs/p', p_partkey, '.md') as doc", "explode(array(concat('src/p', p_partkey + 1, '.py'), concat('src/p', p_partkey + 2, '.py'))) as path")
    return L.churn(X.commits(s, d), targets, NOW())


add("a10_commit_churn", _churned, f"""WITH {X.COMMITS}, l AS (SELECT path, max(ts) AS since FROM touches GROUP BY path),
    t AS (SELECT 'docs/p' || p_partkey || '.md' AS doc, 'src/p' || unnest([p_partkey + 1, p_partkey + 2]) || '.py' AS path FROM part WHERE p_partkey % 10 = 0),
    h AS (SELECT t.doc, count(DISTINCT sha) AS n FROM t LEFT JOIN l ON l.path = t.doc JOIN touches c ON c.path = t.path AND (l.since IS NULL OR c.ts > l.since) GROUP BY t.doc)
    SELECT DISTINCT t.doc, coalesce(n, 0) || ':0' AS churn FROM t LEFT JOIN h USING (doc)""")
add("q25_merge_evidence", lambda s, d: L.merge_evidence(X.read(s, d, "part").selectExpr("p_partkey as doc", "posexplode(transform(sequence(0, p_partkey % 12), i -> cast(i * 37 + p_partkey as string))) as (place, issue)"), X.commits(s, d)),
    f"""WITH {X.COMMITS}, b AS (SELECT DISTINCT subject FROM touches), i AS (SELECT p_partkey AS doc, k AS place, CAST(k * 37 + p_partkey AS VARCHAR) AS issue FROM (SELECT p_partkey, unnest(range(0, least(10, p_partkey % 12 + 1))) AS k FROM part)),
    u AS (SELECT DISTINCT issue FROM i), m AS (SELECT issue FROM u WHERE EXISTS (SELECT 1 FROM b WHERE contains(subject, '#' || issue))) SELECT doc, count(*) AS ids, count(m.issue) AS merged FROM i LEFT JOIN m USING (issue) GROUP BY doc""")

# ---- imports
PATHS = "concat(case when p_partkey % 3 = 0 then concat(p_brand, '/') else '' end, 'pkg', p_partkey % 5, '/', case when p_partkey % 11 = 0 then '__init__' else concat('m', p_partkey) end, '.py')"
_PATHS_SQL = "CASE WHEN p_partkey % 3 = 0 THEN p_brand || '/' ELSE '' END || 'pkg' || (p_partkey % 5) || '/' || CASE WHEN p_partkey % 11 = 0 THEN '__init__' ELSE 'm' || p_partkey END || '.py'"
_MODULE_SQL = f"replace(regexp_replace(regexp_replace({_PATHS_SQL}, '\\.py$', ''), '/__init__$', ''), '/', '.')"


def _imported(s, d):
    p = X.read(s, d, "part").select("p_partkey", F.expr(PATHS).alias("path"))
    level, module = (F.col("p_partkey") % 4).cast("int"), F.when(F.col("p_partkey") % 2 == 0, "x.y").otherwise("")
    return p.select("p_partkey", R.module_name(F.col("path")).alias("name"), R.imported_name(R.module_name(F.col("path")), F.col("path").rlike(r"__init__\.py$"), level, module).alias("imported"))


add("t26_import_names", _imported, f"""WITH m AS (SELECT p_partkey, p_partkey % 4 AS level, CASE WHEN p_partkey % 2 = 0 THEN 'x.y' ELSE '' END AS module, {_MODULE_SQL} AS name, p_partkey % 11 = 0 AS pkg FROM part),
    b AS (SELECT *, string_split(name, '.') AS parts, CASE WHEN pkg THEN level - 1 ELSE level END AS cut FROM m)
    SELECT p_partkey, name, CASE WHEN level = 0 THEN module ELSE array_to_string(list_filter(list_concat(parts[1:greatest(0, len(parts) - cut)], CASE WHEN module = '' THEN [] ELSE [module] END), lambda x: x <> ''), '.') END AS imported FROM b""")
add("t25_node_ids", lambda s, d: X.code_nodes(s, d).select("qualified_name", R.digest_id(F.lit("r1"), F.col("kind"), F.col("qualified_name")).alias("id")), f"WITH {X.CODE_NODES} SELECT qualified_name, substr(sha256('r1' || chr(0) || kind || chr(0) || qualified_name), 1, 32) AS id FROM code_nodes")
ENTRIES = "concat(case p_partkey % 6 when 0 then 'app/' when 1 then 'src/e2e/' when 2 then 'lib/' when 3 then 'pages/' else '' end, case p_size % 7 when 0 then 'page' when 1 then concat('m', p_partkey, '.test') when 2 then '.rc' when 3 then 'vite.config' else concat('m', p_partkey) end, '.ts')"
_ENTRIES_SQL = "CASE p_partkey % 6 WHEN 0 THEN 'app/' WHEN 1 THEN 'src/e2e/' WHEN 2 THEN 'lib/' WHEN 3 THEN 'pages/' ELSE '' END || CASE p_size % 7 WHEN 0 THEN 'page' WHEN 1 THEN 'm' || p_partkey || '.test' WHEN 2 THEN '.rc' WHEN 3 THEN 'vite.config' ELSE 'm' || p_partkey END || '.ts'"
add("t37_entry_files", lambda s, d: X.read(s, d, "part").select("p_partkey", R.is_entry_file(F.expr(ENTRIES)).alias("entry")), "SELECT p_partkey, p_size % 7 IN (1, 2, 3) OR p_partkey % 6 IN (1, 3) OR (p_size % 7 = 0 AND p_partkey % 6 = 0) AS entry FROM part")


_MANIFEST = """concat('{"name": "p', p_partkey, '.js", "main": "./lib/', p_partkey, '.mjs", "exports": {"./key', p_partkey, '.js": {"import": "./dist/', p_partkey, '.js", "require": [null, {"deep": ', repeat('[', cast(p_size % 5 as int)), '"./c/', p_partkey, '.cjs"', repeat(']', cast(p_size % 5 as int)), '}]}},
    "scripts": {"go": "tsx ./run/', p_partkey, '.ts && echo x.md", "n": 1}, "n": ', p_size, ', "t": true, "e": {}', case when p_partkey % 10 = 0 then '' else '}' end)"""


def _manifests(s, d):
    """A manifest for each part, nested to a depth that its size sets; every tenth can't be read."""
    return X.read(s, d, "part").selectExpr("p_partkey", "p_brand as folder", f"{_MANIFEST} as json")


_MANIFEST_SQL = "manifests AS (SELECT p_partkey, p_brand AS folder, " + _MANIFEST.replace("cast(p_size % 5 as int)", "p_size % 5").replace("concat(", "concat(") + " AS json FROM part)"
add("t38_declared_entries", lambda s, d: N.script_entries(_manifests(s, d)), "SELECT p_brand || '/' || unnest(['lib/' || p_partkey || '.mjs', 'dist/' || p_partkey || '.js', 'c/' || p_partkey || '.cjs', 'run/' || p_partkey || '.ts']) AS path FROM part WHERE p_partkey % 10 <> 0")
add("x08_json_leaves", lambda s, d: N.leaves(_manifests(s, d), "p_partkey", "json").select(F.col("id").alias("p_partkey"), "path", "value"),
    f"""WITH {_MANIFEST_SQL}, t AS (SELECT p_partkey, unnest(j) AS l FROM (SELECT p_partkey, list((fullkey, atom, type)) AS j FROM manifests, json_tree(json) WHERE p_partkey % 10 <> 0 GROUP BY p_partkey))
    SELECT p_partkey, replace(l[1], '"', '') AS path, CASE WHEN l[3] = 'NULL' THEN NULL ELSE json_extract_string(l[2], '$') END AS value FROM t WHERE l[3] NOT IN ('OBJECT', 'ARRAY')""")


def _specifiers(s, d):
    p = X.read(s, d, "part")
    files = p.selectExpr("concat('src/d', p_partkey % 5, '/', case when p_partkey % 4 = 0 then concat('m', p_partkey, '/index.tsx') when p_partkey % 4 = 1 then concat('m', p_partkey, '.js') else concat('m', p_partkey, '.ts') end) as path").distinct()
    spec = p.selectExpr("concat('src/d', p_partkey % 5, '/m', p_partkey, '.ts') as path", "case p_partkey % 3 when 0 then concat('../d', (p_partkey + 1) % 5, '/m', p_partkey + 1) when 1 then concat('@/d', (p_partkey + 1) % 5, '/./m', p_partkey + 1) else concat('react', p_partkey) end as specifier")
    spec = spec.withColumn("specifier", F.replace("specifier", F.lit("/./"), F.lit("/")))
    return M.resolved_scripts(spec, files, {"@/*": ["lib/*", "src/*"]})


add("t27_specifiers", _specifiers, """WITH f AS (SELECT p_partkey AS k, 'src/d' || (p_partkey % 5) || '/' || CASE p_partkey % 4 WHEN 0 THEN 'm' || p_partkey || '/index.tsx' WHEN 1 THEN 'm' || p_partkey || '.js' ELSE 'm' || p_partkey || '.ts' END AS path FROM part)
    SELECT 'src/d' || (p_partkey % 5) || '/m' || p_partkey || '.ts' AS path, CASE p_partkey % 3 WHEN 0 THEN '../d' || ((p_partkey + 1) % 5) || '/m' || (p_partkey + 1) WHEN 1 THEN '@/d' || ((p_partkey + 1) % 5) || '/m' || (p_partkey + 1) ELSE 'react' || p_partkey END AS specifier,
      CASE WHEN p_partkey % 3 < 2 THEN f.path END AS target_path FROM part LEFT JOIN f ON f.k = p_partkey + 1""")
_STATE = lambda s, d: X.read(s, d, "part").where("p_partkey % 6 <> 0").selectExpr("p_partkey", "concat('p', p_partkey) as path", "md5(p_name) as hash")
_NEW = lambda s, d: X.read(s, d, "part").where("p_partkey % 5 <> 0").selectExpr("p_partkey", "concat('p', p_partkey) as path", "md5(case when p_partkey % 4 = 0 then 'x' else p_name end) as hash")
_PLAN = "CASE WHEN p_partkey % 5 = 0 THEN 'retire' WHEN p_partkey % 6 = 0 THEN 'index' WHEN p_partkey % 4 = 0 THEN 'refresh' ELSE 'skip' END"


def _applied(s, d):
    plan = M.index_pass(_STATE(s, d).select("path", "hash"), _NEW(s, d).select("path", "hash"))
    line = X.read(s, d, "lineitem")
    old = line.selectExpr("concat('p', l_partkey) as src_path", "concat('s', l_suppkey % 40) as dst").distinct().withColumn("valid", F.lit(True))
    new = line.where("l_suppkey % 3 <> 0").selectExpr("concat('p', l_partkey) as src_path", "concat('s', l_suppkey % 40) as dst")
    return M.applied_edges(old, plan, new)


add("l15_index_pass", lambda s, d: M.index_pass(_STATE(s, d).select("path", "hash"), _NEW(s, d).select("path", "hash")), f"SELECT 'p' || p_partkey AS path, {_PLAN} AS action FROM part WHERE p_partkey % 6 <> 0 OR p_partkey % 5 <> 0")
add("l15_applied_edges", _applied, f"""WITH e AS (SELECT 'p' || l_partkey AS src_path, 's' || (l_suppkey % 40) AS dst, bool_or(l_suppkey % 3 <> 0) AS again, any_value(l_partkey) AS p_partkey FROM lineitem GROUP BY ALL),
    a AS (SELECT *, CASE WHEN p_partkey % 30 = 0 THEN 'none' ELSE {_PLAN} END AS action FROM e) SELECT src_path, dst, CASE WHEN action = 'refresh' THEN again WHEN action = 'retire' THEN false ELSE true END AS valid FROM a""")


def _upserted(s, d):
    old = X.read(s, d, "part").where("p_partkey % 2 = 0").selectExpr("concat('P', p_partkey) as node_id", "concat('f', p_partkey) as file_path", "'py' as lang", "'{}' as attributes")
    new = X.read(s, d, "part").where("p_partkey % 3 = 0").selectExpr("concat('P', p_partkey) as node_id", "case when p_partkey % 4 = 0 then concat('g', p_partkey) end as file_path", "cast(null as string) as lang", "p_brand as attributes")
    return M.merged_nodes(old, new)


add("l20_node_upsert", _upserted, "SELECT 'P' || p_partkey AS node_id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 = 0 THEN 'g' || p_partkey WHEN p_partkey % 2 = 0 THEN 'f' || p_partkey END AS file_path, CASE WHEN p_partkey % 2 = 0 THEN 'py' END AS lang, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '{}' END AS attributes FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
add("j11_never_imported", lambda s, d: G.unused(X.code_nodes(s, d), X.code_edges(s, d).where("not invalid"), F.lit(False)).select("qualified_name"), f"WITH {CODE} SELECT qualified_name FROM code_nodes WHERE file_path IS NOT NULL AND node_id NOT IN (SELECT dst_id FROM imports)")

# ---- lines
_MEM = X.mem


def _lines(s, d):
    m = _MEM(s, d)
    core = R.triple_core(F.col("subject"), F.col("relation"), F.col("object"), F.col("is_negation"))
    why = R.rationale(core, F.when(F.col("event_id") % 3 == 0, F.col("object")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("because "), F.repeat("subject", 60))))
    line = F.when(F.col("memory_type") == "belief", R.belief_line(core, F.col("confidence"), F.col("domain"), why)).when(F.col("memory_type") == "event", R.event_line(F.col("created_at"), F.col("subject"), F.col("relation"), F.col("object"))).otherwise(R.skill_line(F.nullif("object", F.lit("o1")), F.col("confidence")))
    return m.select("memory_id", line.alias("line"))


add("t31_rendered_lines", _lines, f"""WITH {X.MEM}, c AS (SELECT *, CASE WHEN is_negation THEN 'not (' || subject || ' ' || relation || ' ' || object || ')' ELSE subject || ' ' || relation || ' ' || object END AS core,
    CASE event_id % 3 WHEN 1 THEN substr('because ' || repeat(subject, 60), 1, 120) END AS why FROM mem)
    SELECT memory_id, CASE memory_type WHEN 'belief' THEN '- ' || core || ' (confidence: ' || printf('%.2f', confidence) || CASE WHEN domain IS NULL THEN '' ELSE ', domain: ' || domain END || ')' || CASE WHEN why IS NULL THEN '' ELSE ' — ' || trim(why) END
      WHEN 'event' THEN '- ' || strftime(created_at, '%Y-%m-%d') || ': ' || subject || ' ' || relation || ' ' || object ELSE '- ' || CASE WHEN object = 'o1' THEN 'unnamed skill' ELSE object END || ' (confidence: ' || printf('%.2f', confidence) || ')' END AS line FROM c""")
add("t31_edge_lines", lambda s, d: X.edges(s, d).select("edge_id", R.edge_line(F.col("src_id"), F.col("relation"), F.col("dst_id"), F.col("confidence"), F.col("valid_from"), F.col("invalid_at"), F.col("belief_id").isNull()).alias("line")),
    f"WITH {X.EDGES} SELECT edge_id, CASE WHEN invalid_at IS NOT NULL THEN '- ✗ ' || src_id || ' ' || relation || ' ' || dst_id || ' (' || CASE WHEN belief_id IS NULL THEN '~' ELSE '' END || strftime(valid_from, '%Y-%m-%d') || ' → ' || strftime(invalid_at, '%Y-%m-%d') || ')' ELSE '- ' || src_id || ' ' || relation || ' ' || dst_id || ' (' || printf('%.2f', confidence) || CASE WHEN belief_id IS NULL THEN ', since ~' || strftime(valid_from, '%Y-%m-%d') ELSE '' END || ')' END AS line FROM edges")


def _reflected(s, d):
    m = _MEM(s, d).groupBy("subject", "relation").agg(F.count("*").alias("n"), F.min("object").alias("o"))
    kind = F.when(F.col("n") % 4 == 0, "recurring_entity").when(F.col("n") % 4 == 1, "repeated_event_type").when(F.col("n") % 4 == 2, "skill_generalization").otherwise("other")
    return m.select("subject", "relation", R.reflection_text(kind, F.col("subject"), F.concat(F.lit("repeatedly_"), "relation"), F.col("o"), F.col("n")).alias("text"))


add("t39_reflections", _reflected, f"""WITH {X.MEM}, g AS (SELECT subject, relation, count(*) AS n, min(object) AS o FROM mem GROUP BY ALL)
    SELECT subject, relation, 'Reflection: ' || CASE n % 4 WHEN 0 THEN subject || ' appears repeatedly in recent memory activity (' || n || ' occurrences).' WHEN 1 THEN subject || ' repeatedly ' || relation || ' ' || o || ' (' || n || ' occurrences).' WHEN 2 THEN subject || ' consistently demonstrates ' || o || ' (' || n || ' observations).'
      ELSE subject || ' repeatedly_' || relation || ' ' || o || ' (' || n || ' supporting memories).' END AS text FROM g""")

# ---- short strings
add("t16_one_line", lambda s, d: X.read(s, d, "conversations").select("conv_id", "turn", F.md5(R.one_line(F.col("text"))).alias("digest")), "SELECT conv_id, turn, md5(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) AS digest FROM conversations")
add("t24_compact_ids", lambda s, d: X.read(s, d, "events").selectExpr("event_id", "concat('a-', event_id, '-b-', user_id) as raw").select("event_id", R.compact_id(F.col("raw")).alias("id")), "SELECT event_id, 'a' || event_id || 'b' || user_id AS id FROM events")
add("t29_doc_types", lambda s, d: X.read(s, d, "documents").select("doc_id", F.expr("substring(text, 1 + doc_id % 7, doc_id % 50)").alias("t")).select("doc_id", R.is_doc_type(F.col("t")).alias("valid")), "SELECT doc_id, coalesce(regexp_full_match(substr(text, CAST(1 + doc_id % 7 AS INT), CAST(doc_id % 50 AS INT)), '[A-Za-z0-9][A-Za-z0-9 ._-]{0,39}'), false) AS valid FROM documents")
add("t30_requirement_names", lambda s, d: X.read(s, d, "part").select("p_partkey", R.requirement_name(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("[x]>="), F.col("p_size").cast("string"))).alias("name")), "SELECT p_partkey, replace(replace(lower(p_name), ' ', '-'), '_', '-') AS name FROM part")
add("t33_diagram_labels", lambda s, d: X.read(s, d, "pages").select("page_id", F.md5(R.diagram_label(F.col("html"))).alias("digest")), "SELECT page_id, md5(translate(html, chr(10) || chr(13) || '\"[]', '  ''()')) AS digest FROM pages")
add("t34_without_sections", lambda s, d: X.read(s, d, "pages").select("page_id", F.md5(R.without_section(F.col("html"), "<script>", "</script>")).alias("digest")), "SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>\\n?', '', 'g'), '<script>\\n?|</script>\\n?', '', 'g')) AS digest FROM pages")
add("t35_project_folders", lambda s, d: X.read(s, d, "pages").select("page_id", R.project_folder(F.col("url")).alias("folder")), "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9-]', '-', 'g') AS folder FROM pages")
add("t36_safe_display", lambda s, d: X.read(s, d, "pages").select("page_id", R.shown(F.substring("html", 1, 300)).alias("kind"), R.capped(R.quoted_path(F.col("url")), 30).alias("path")),
    "WITH c AS (SELECT page_id, url, trim(regexp_replace(translate(regexp_replace(substr(html, 1, 300), '[\\x00-\\x1f\\x7f]', '', 'g'), '`()', '''[]'), '\\s+', ' ', 'g')) AS x FROM pages) SELECT page_id, CASE WHEN x = '' THEN 'unknown' ELSE substr(x, 1, 40) END AS kind, CASE WHEN length(url) + 2 > 30 THEN substr('\"' || url || '\"', 1, 29) || '…' ELSE '\"' || url || '\"' END AS path FROM c")
_RELATIONS = "MAP {" + ", ".join(f"'{v}': '{k}'" for k, vs in T.RELATIONS.items() for v in vs) + "}"


def _words(s, d):
    listed = s.createDataFrame([(v.replace("_", " "),) for vs in T.RELATIONS.values() for v in vs] + [(w,) for w in sorted(T.EVENT_RELATIONS | T.SKILL_RELATIONS | T.WORLD_RELATIONS)], "raw string")
    return X.read(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("raw")).union(listed).distinct()


def _listed_sql() -> str:
    words = [v.replace("_", " ") for vs in T.RELATIONS.values() for v in vs] + sorted(T.EVENT_RELATIONS | T.SKILL_RELATIONS | T.WORLD_RELATIONS)
    return "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS raw FROM documents UNION SELECT unnest([" + ", ".join(f"'{w}'" for w in words) + "])"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


add("t09_normal_relation", lambda s, d: _words(s, d).select("raw", T.normal_relation(F.col("raw")).alias("relation")), f"WITH w AS ({_listed_sql()}) SELECT raw, coalesce({_RELATIONS}[replace(lower(raw), ' ', '_')], replace(lower(raw), ' ', '_')) AS relation FROM w")
add("t11_classify", lambda s, d: _words(s, d).select("raw", O.classify(F.col("raw"), T.EVENT_RELATIONS, T.SKILL_RELATIONS, T.WORLD_RELATIONS).alias("memory_type")),
    f"WITH w AS ({_listed_sql()}), n AS (SELECT raw, replace(lower(trim(raw)), ' ', '_') AS r FROM w) SELECT raw, CASE WHEN r IN ({_in(T.EVENT_RELATIONS)}) THEN 'event' WHEN r IN ({_in(T.SKILL_RELATIONS)}) THEN 'skill' WHEN r IN ({_in(T.WORLD_RELATIONS)}) THEN 'world_model' ELSE 'belief' END AS memory_type FROM n")
COMMANDS = [("npm install p", "manifest"), ("git commit -m p", "git"), ("git status p", "none"), ("uv add p", "manifest"), ("go get p", "manifest"), ("ls -la p", "none"), ("pip3 uninstall p; git pull", "manifest"), ("cargo build p", "none"), ("cd p && git -C q stash", "git"), ("npm run p | poetry lock", "manifest")]
add("t28_r07_shell_changes", lambda s, d: X.read(s, d, "events").select("event_id", F.element_at(F.array(*[F.lit(c) for c, _ in COMMANDS]), (F.col("event_id") % len(COMMANDS) + 1).cast("int")).alias("c")).select("event_id", F.coalesce(T.shell_change(F.concat("c", F.lit(" x"), "event_id")), F.lit("none")).alias("change")),
    f"SELECT event_id, [{', '.join(repr(k) for _, k in COMMANDS)}][CAST(event_id % {len(COMMANDS)} AS INT) + 1] AS change FROM events")


# ---- saving
def _items(s, d):
    """Events as things to save: some without a field, with markup, with a secret, of no known type."""
    return X.read(s, d, "events").selectExpr(
        "event_id div 8 as batch", "event_id as index", "element_at(array('belief', 'event', 'skill', 'world_model', 'note'), cast(case when event_id % 97 = 0 then 4 else event_id % 4 end as int) + 1) as mem_type",
        "case when event_id % 31 = 0 then '  ' else concat(' s', user_id) end as subject", "event_type as relation", "case when event_id % 29 = 0 then concat('password=', repeat('x', 9), event_id) else concat('o', user_id) end as object",
        "event_type as event_type", "case when event_id % 23 = 0 then null else concat('n', user_id) end as name", "'thing' as entity_type", "case when event_id % 41 = 0 then 'a </PARAMETER> b' end as description", "cast(null as string) as domain",
        "case when event_id % 5 = 0 then event_id % 3 - 0.5D end as confidence", "case when event_id % 2 = 0 then 'user_direct' else 'tool_api' end as source")


_ITEMS = """i AS (SELECT event_id // 8 AS batch, event_id AS k, CASE WHEN event_id % 97 = 0 THEN 'note' ELSE ['belief', 'event', 'skill', 'world_model'][CAST(event_id % 4 AS INT) + 1] END AS t, event_id % 31 = 0 AS s, event_id % 23 = 0 AS n, event_id % 41 = 0 AS m FROM events),
    e AS (SELECT *, CASE WHEN m THEN 'markup' WHEN t = 'note' THEN 'unknown type' WHEN t = 'belief' AND s THEN 'belief needs subject' WHEN t = 'event' AND s THEN 'event needs subject' WHEN t = 'skill' AND n THEN 'skill needs name' WHEN t = 'world_model' AND n THEN 'world_model needs name' END AS error FROM i)"""
add("l08_save_checks", lambda s, d: SV.checked(_items(s, d)).select("index", "error", "redacted", "subject", F.col("object").alias("its_object"), "confidence"), f"""WITH {_ITEMS} SELECT k AS "index", error, CASE WHEN k % 29 = 0 THEN 'credential-assignment' END AS redacted, CASE WHEN s THEN NULL ELSE 's' || user_id END AS subject, CASE WHEN k % 29 = 0 THEN '[REDACTED:credential-assignment]' ELSE 'o' || user_id END AS its_object,
    CAST(CASE WHEN k % 5 = 0 THEN greatest(0, least(1, k % 3 - 0.5)) ELSE CASE t WHEN 'event' THEN 1.0 WHEN 'skill' THEN 0.5 WHEN 'world_model' THEN 0.9 ELSE CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.85 END END END AS DOUBLE) AS confidence FROM e JOIN events ON event_id = k""")
add("l08_save_batches", lambda s, d: SV.saved_batch(_items(s, d)).fillna(-1, ["failed_index"]), f"WITH {_ITEMS}, f AS (SELECT batch, count(*) AS size, min(k) FILTER (error IS NOT NULL) AS first FROM e GROUP BY batch) SELECT f.batch, CASE WHEN first IS NULL THEN size ELSE 0 END AS saved, e.error, coalesce(first, -1) AS failed_index FROM f LEFT JOIN e ON e.k = f.first")


def _beliefs(s, d):
    m = _items(s, d).where("mem_type = 'belief'")
    return m.select("index", SV.first_confidence(F.col("source"), F.lit(0.5) + F.col("index") % 4 / 2).alias("confidence"), F.lit(1.0).alias("prior_weight"))


add("l01_store_belief", _beliefs, f"WITH {_ITEMS} SELECT k AS \"index\", CAST(least(1, CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.85 END * (0.5 + (k % 4) / 2.0)) AS DOUBLE) AS confidence, CAST(1 AS DOUBLE) AS prior_weight FROM i WHERE t = 'belief'")


def _merged(s, d):
    e = X.read(s, d, "events")
    old = F.create_map(F.lit("a"), F.concat(F.lit("x"), "event_type"), F.lit("b"), (F.col("user_id") % 3).cast("string"))
    new = F.create_map(F.lit("b"), (F.col("event_id") % 3).cast("string"), F.lit("c"), F.lit("new"))
    props, changes = SV.merged_properties(old, new)
    return e.select("event_id", F.map_values(props).alias("p"), props["a"].alias("a"), props["b"].alias("b"), props["c"].alias("c"), F.transform(changes, lambda x: F.concat_ws(">", x["key"], F.coalesce(x["old_value"], F.lit("-")), x["new_value"])).alias("ch")).select("event_id", "a", "b", "c", F.array_join("ch", ",").alias("changes"))


add("x06_merged_properties", _merged, "SELECT event_id, 'x' || event_type AS a, CAST(event_id % 3 AS VARCHAR) AS b, 'new' AS c, CASE WHEN user_id % 3 <> event_id % 3 THEN 'b>' || (user_id % 3) || '>' || (event_id % 3) || ',' ELSE '' END || 'c>->new' AS changes FROM events")
add("p07_mutation_history", lambda s, d: SV.property_history(X.read(s, d, "events").selectExpr("user_id as model_id", "event_type as key", "cast(event_id % 3 as string) as value", "struct(ts, event_id) as at")).select("model_id", "n", "key", "old_value", "new_value"),
    "WITH b AS (SELECT user_id, event_type, CAST(event_id % 3 AS VARCHAR) AS v, ts, event_id, lag(CAST(event_id % 3 AS VARCHAR)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM events) SELECT user_id AS model_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type) AS INT) AS n, event_type AS key, old AS old_value, v AS new_value FROM b WHERE old IS DISTINCT FROM v")
add("x05_history_append", lambda s, d: _MEM(s, d).select("memory_id", F.array_join(F.array_append(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("access_count"))), lambda i: i.cast("string")), F.col("status")), ">").alias("history")), f"WITH {X.MEM} SELECT memory_id, array_to_string(range(1, greatest(1, access_count) + 1), '>') || '>' || status AS history FROM mem")
add("x03_json_remove", lambda s, d: X.read(s, d, "events").select("event_id", F.to_json(F.from_json("props", "map<string,string>")).alias("j"), F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k != "k").alias("m")).select("event_id", F.size("m").cast("long").alias("left"), F.get_json_object("j", "$.k").alias("was")), 'SELECT event_id, CAST(len(json_keys(props)) - 1 AS BIGINT) AS "left", json_extract_string(props, \'$.k\') AS was FROM events')
add("x07_first_evidence", lambda s, d: X.read(s, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first")).select("conv_id", F.md5(F.substring("first", 1, 120)).alias("rationale")), "SELECT conv_id, md5(substr(arg_min(text, turn), 1, 120)) AS rationale FROM conversations GROUP BY conv_id")


def _links(s, d):
    line = X.read(s, d, "lineitem")
    asked = line.selectExpr("concat(l_orderkey, '-', l_linenumber) as request", "concat('s', l_suppkey) as src", "'supplier' as src_type", "case when l_linenumber % 2 = 0 then 'Depends On' else 'using' end as relation", "concat('p', l_partkey) as dst", "case when l_linenumber = 3 then 'tool' else 'part' end as dst_type", "'tool_api' as source")
    nodes = X.read(s, d, "supplier").selectExpr("concat('S', s_suppkey) as node_id", "concat('s', s_suppkey) as canonical", "'supplier' as entity_type", "'active' as status")
    nodes = nodes.unionByName(X.read(s, d, "part").selectExpr("concat('P', p_partkey) as node_id", "concat('p', p_partkey) as canonical", "'part' as entity_type", "case when p_partkey % 9 = 0 then 'merged' else 'active' end as status"))
    return SV.linked(asked, nodes).select("request", "src_id", "relation", "dst_id", "confidence", "edge_id")


add("l16_memory_link", _links, "SELECT l_orderkey || '-' || l_linenumber AS request, 'S' || l_suppkey AS src_id, CASE WHEN l_linenumber % 2 = 0 THEN 'depends_on' ELSE 'uses' END AS relation, 'P' || l_partkey AS dst_id, CAST(0.85 AS DOUBLE) AS confidence, substr(sha256('S' || l_suppkey || chr(0) || CASE WHEN l_linenumber % 2 = 0 THEN 'depends_on' ELSE 'uses' END || chr(0) || 'P' || l_partkey), 1, 32) AS edge_id FROM lineitem WHERE l_linenumber <> 3 AND l_partkey % 9 <> 0")
add("j02_cached_hits", lambda s, d: SV.cached_hits(_MEM(s, d).select(F.concat(F.lit("q"), F.col("event_id") % 700).alias("key"), "memory_id").where("length(memory_id) > 0 and cast(substr(memory_id, 2) as long) % 3 = 0"), _MEM(s, d).where("status = 'active'")),
    f"WITH {X.MEM}, c AS (SELECT 'q' || (event_id % 700) AS key, status FROM mem WHERE event_id % 3 = 0) SELECT key, count(*) AS n FROM c GROUP BY key HAVING count(*) FILTER (status <> 'active') = 0")
add("j22_index_backfill", lambda s, d: _MEM(s, d).where("status = 'active'").select("event_id").join(_MEM(s, d).where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").withColumn("todo", F.lit("add")).unionByName(_MEM(s, d).where("event_id % 3 = 0").select("event_id").join(_MEM(s, d).where("status = 'active'").select("event_id"), "event_id", "left_anti").withColumn("todo", F.lit("delete"))),
    f"WITH {X.MEM} SELECT event_id, CASE WHEN status = 'active' THEN 'add' ELSE 'delete' END AS todo FROM mem WHERE (status = 'active') <> (event_id % 3 = 0)")
add("w07_keep_newest", lambda s, d: X.read(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("rn")).where("rn > 7").select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 7")
add("k10_token_budget", lambda s, d: X.notes(s, d).withColumn("running", F.sum(F.ceil(F.length("text") / 4)).over(Window.partitionBy("repo_id").orderBy(F.desc("updated_at"), "memory_id"))).where("running <= 900").select("repo_id", "memory_id"), f"WITH {X.NOTES} SELECT repo_id, memory_id FROM (SELECT *, sum((length(text) + 3) // 4) OVER (PARTITION BY repo_id ORDER BY updated_at DESC, memory_id) AS running FROM notes) WHERE running <= 900")


# ---- projects
def _facts(s, d):
    """Facts of parts by brand in order of detection: the first of each value counts."""
    p = X.read(s, d, "part").selectExpr("p_brand as project", "p_type as category", "p_name as value", "p_partkey as pos")
    first = p.groupBy("project", "category", "value").agg(F.min("pos").alias("pos"))
    return first.groupBy("project", "category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), ",").alias("facts"))


add("a14_q28_project_profile", _facts, "WITH f AS (SELECT p_brand AS project, p_type AS category, p_name AS value, min(p_partkey) AS pos FROM part GROUP BY ALL) SELECT project, category, string_agg(value, ',' ORDER BY pos) AS facts FROM f GROUP BY ALL")

# ---- journal
J = X.journal
add("r03_stale_claims", lambda s, d: J(s, d).withColumn("claimed_at", F.expr("case when seq % 3 = 0 then detected_at + make_dt_interval(0, 0, cast(seq % 40 as int)) end")).where("claimed_at < timestamp_ntz'2024-01-20 00:00:00' - interval 15 minutes").groupBy("repo_id").agg(F.count("*").alias("freed")),
    f"WITH {X.JOURNAL}, c AS (SELECT *, CASE WHEN seq % 3 = 0 THEN detected_at + to_minutes(CAST(seq % 40 AS INT)) END AS claimed_at FROM journal) SELECT repo_id, count(*) AS freed FROM c WHERE claimed_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 15 MINUTE GROUP BY repo_id")
add("r06_flush_batches", lambda s, d: J(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("repo_id").orderBy("seq"))).groupBy("repo_id", F.floor((F.col("rn") - 1) / 25).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.max("seq").alias("cursor")), f"WITH {X.JOURNAL}, k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seq) AS rn FROM journal) SELECT repo_id, CAST((rn - 1) // 25 AS BIGINT) AS batch, count(*) AS n, max(seq) AS cursor FROM k GROUP BY ALL")
add("r08_shown_once", lambda s, d: X.read(s, d, "events").selectExpr("user_id as session", "event_type as memory", "ts", "event_id").groupBy("session", "memory").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("session", "memory", "f.event_id"), "SELECT user_id AS session, event_type AS memory, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
add("r10_pending_last", lambda s, d: J(s, d).where("path is not null").groupBy("path").agg(F.max_by(F.struct("seq", "change"), "seq").alias("l"), F.count_if(F.col("seq") % 11 == 0).alias("failures")).select("path", "l.seq", "l.change", F.when(F.col("failures") >= 3, "parked").otherwise("pending").alias("state")), f"WITH {X.JOURNAL} SELECT path, max(seq) AS seq, arg_max(change, seq) AS change, CASE WHEN count(*) FILTER (seq % 11 = 0) >= 3 THEN 'parked' ELSE 'pending' END AS state FROM journal WHERE path IS NOT NULL GROUP BY path")
add("r14_stop_nudge", lambda s, d: X.doc_registry(s, d).where("doc_type = 'plan' and lifecycle = 'active'").select("rel_path", F.concat(F.lit("s"), F.col("num") % 30).alias("session")).join(X.doc_registry(s, d).where("num % 4 = 0").select(F.concat(F.lit("s"), F.col("num") % 30).alias("session")).distinct(), "session", "left_anti").groupBy("session").agg(F.min("rel_path").alias("rel_path")),
    f"WITH {X.REGISTRY} SELECT 's' || (num % 30) AS session, min(rel_path) AS rel_path FROM registry WHERE doc_type = 'plan' AND lifecycle = 'active' AND 's' || (num % 30) NOT IN (SELECT 's' || (num % 30) FROM registry WHERE num % 4 = 0) GROUP BY 1")
add("q29_reads_annotation", lambda s, d: X.journal(s, d).select("seq", F.concat(F.lit("src"), F.col("seq") % 20, F.lit("/doc"), F.col("seq") % 1000, F.lit(".md")).alias("rel_path"), F.concat(F.lit("s"), F.col("seq") % 9).alias("session")).join(X.doc_registry(s, d).where("lifecycle in ('superseded', 'archived') or tier = 'TX'").select("rel_path", "lifecycle"), "rel_path").groupBy("session", "rel_path", "lifecycle").agg(F.min("seq").alias("seq")),
    f"WITH {X.JOURNAL}, {X.REGISTRY}, r AS (SELECT seq, 'src' || (seq % 20) || '/doc' || (seq % 1000) || '.md' AS rel_path, 's' || (seq % 9) AS session FROM journal) SELECT session, rel_path, lifecycle, min(seq) AS seq FROM r JOIN registry USING (rel_path) WHERE lifecycle IN ('superseded', 'archived') OR tier = 'TX' GROUP BY ALL")
