"""Queries of addresses, texts, status and access, as the rules word them; each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.functions import scoring as S
from memlake.operators import docledger as DL
from memlake.operators import documents as D
from memlake.operators import graph as G
from memlake.operators import nested as N
from memlake.operators import phrases as PH
from memlake.operators import store as O
from memlake.plans.graph import CODE
from memlake.plans.ledger import _ENTRIES_SQL, ENTRIES
from memlake.plans.search import TIER
from memlake.sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# ---- repositories
_REMOTE = "case page_id % 7 when 0 then concat('https://User@Host', page_id % 9, '.org:8443/Org/r', page_id, '.git/') when 1 then concat('git@host', page_id % 9, '.org:Org/R', page_id, '.git') when 2 then concat(' ssh://git@HOST', page_id % 9, '.org/Org/r', page_id, ' ') when 3 then concat('C:/work/R', page_id) when 4 then concat('/srv/git/r', page_id, '.git') when 5 then concat('http://host', page_id % 9, '.org/a/r', page_id, '?x=1#y') else concat('host', page_id % 9, '.org:r', page_id) end"
_PLACE = "CASE page_id % 7 WHEN 0 THEN 'host' || (page_id % 9) || '.org/org/r' || page_id WHEN 1 THEN 'host' || (page_id % 9) || '.org/org/r' || page_id WHEN 2 THEN 'host' || (page_id % 9) || '.org/org/r' || page_id WHEN 3 THEN 'c:/work/r' || page_id WHEN 4 THEN 'srv/git/r' || page_id WHEN 5 THEN 'host' || (page_id % 9) || '.org/a/r' || page_id ELSE 'host' || (page_id % 9) || '.org/r' || page_id END"
add("t21_git_place", lambda s, d: X.read(s, d, "pages").select("page_id", R.git_place(F.expr(_REMOTE)).alias("place")), f"SELECT page_id, {_PLACE} AS place FROM pages")
add("t22_repo_digest", lambda s, d: X.read(s, d, "pages").select("page_id", R.repo_id(F.expr("case when page_id % 3 = 0 then md5(url) end"), F.when(F.col("page_id") % 3 == 1, F.expr(_REMOTE)), F.col("url")).alias("repo_id")),
    f"SELECT page_id, substr(sha256(CASE page_id % 3 WHEN 0 THEN md5(url) WHEN 1 THEN {_PLACE} ELSE url END), 1, 16) AS repo_id FROM pages")


# ---- texts of memories
def _whole(s, d):
    """Memories with all that their text is made of: names, lists, properties and tags."""
    m = X.mem(s, d)
    return m.select(
        "memory_id", "subject", "relation", "object", F.lit(None).cast("string").alias("name"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Note "), "event_id")).alias("description"), F.when(F.col("event_id") % 5 == 0, "").otherwise("Tool").alias("entity_type"), "domain",
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("When A"), F.concat(F.lit("b"), F.col("event_id").cast("string")))).alias("trigger_conditions"), F.when(F.col("event_id") % 4 == 0, F.array(F.lit("Step"))).alias("steps"),
        F.when(F.col("event_id") % 6 == 0, F.create_map(F.lit("Size"), F.col("access_count").cast("string"), F.lit("kind"), F.lit("X"))).alias("properties"), F.when(F.col("event_id") % 7 == 0, F.array(F.lit("T1"), F.lit("t2"))).alias("tags"),
    )


add("p20_flattened_text", lambda s, d: _whole(s, d).select("memory_id", O.flattened_text().alias("text")),
    f"""WITH {X.MEM} SELECT memory_id, lower(concat_ws(' ', nullif(subject, ''), nullif(relation, ''), nullif(object, ''), CASE WHEN event_id % 2 = 0 THEN 'Note ' || event_id END, CASE WHEN event_id % 5 <> 0 THEN 'Tool' END, nullif(domain, ''),
      CASE WHEN event_id % 3 = 0 THEN 'When A b' || event_id END, CASE WHEN event_id % 4 = 0 THEN 'Step' END, CASE WHEN event_id % 6 = 0 THEN 'Size ' || access_count || ' kind X' END, CASE WHEN event_id % 7 = 0 THEN 'T1 t2' END)) AS text FROM mem""")


# ---- access
def _accessed(s, d):
    """Every event also reads the memory whose number is a third of its own: the log is added up when it is read."""
    m, log = X.mem(s, d), X.read(s, d, "events").selectExpr("concat('m', lpad(cast(event_id div 3 as string), 10, '0')) as memory_id", "ts as at")
    rows = O.with_access(m, log)
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(-1)).alias(c)
    return rows.select("memory_id", F.col("access_count").cast("long").alias("access_count"), micros("last_used"), micros("updated_at"))


add("l12_access_log", _accessed, f"""WITH {X.MEM}, g AS (SELECT 'm' || lpad(CAST(event_id // 3 AS VARCHAR), 10, '0') AS memory_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1)
    SELECT memory_id, access_count + coalesce(n, 0) AS access_count, coalesce(epoch_us(greatest(coalesce(last_used, last), coalesce(last, last_used))), -1) AS last_used, epoch_us(updated_at) AS updated_at FROM mem LEFT JOIN g USING (memory_id)""")

# ---- feeds
def _capped(s, d):
    """Of each tenant's feed three rows of other repositories at most, and twelve in all."""
    rows = O.active(X.mem(s, d)).where("user_id is not null").withColumn("is_foreign", F.when(O.is_local("r2"), 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("user_id", "is_foreign").orderBy(F.desc("confidence"), "memory_id"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("is_foreign", F.desc("confidence"), "memory_id"))
    kept = rows.withColumn("place", place).where("is_foreign = 0 or place <= 3").withColumn("rank", rank)
    return kept.where("rank <= 12").select("user_id", "memory_id", "is_foreign", "rank")


add("w04_foreign_cap", _capped,
    f"""WITH {X.MEM}, l AS (SELECT *, CASE WHEN repo_id IS NULL OR repo_id = 'r2' OR lower(trim(subject)) = 'user' THEN 0 ELSE 1 END AS is_foreign FROM mem WHERE status = 'active' AND user_id IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, is_foreign ORDER BY confidence DESC, memory_id) AS place FROM l), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY is_foreign, confidence DESC, memory_id) AS INT) AS rank FROM p WHERE is_foreign = 0 OR place <= 3)
    SELECT user_id, memory_id, is_foreign, rank FROM r WHERE rank <= 12""")


def _served(s, d):
    """The eight best of each tenant as they are given out."""
    m = O.active(X.mem(s, d)).where("user_id is not null and not (doc_tier <=> 'TX')")
    now = F.lit(X.NOW_E).cast("timestamp_ntz")
    score = S.composite(F.lit(0.5), F.col("confidence"), S.recency(now, F.col("updated_at")), S.usage(F.col("access_count"), F.max("access_count").over(Window.partitionBy("user_id")))) * S.tier_factor(F.col("doc_tier"))
    best = m.withColumn("score", score).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "memory_id"))).where("rn <= 8")
    return best.select("user_id", "memory_id", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"))


add("p22_serialise", _served, f"""WITH {X.MEM}, a AS (SELECT *, max(access_count) OVER (PARTITION BY user_id) AS most FROM mem WHERE status = 'active' AND user_id IS NOT NULL AND doc_tier IS DISTINCT FROM 'TX'),
    c AS (SELECT *, (0.65 * 0.5 + 0.20 * confidence + 0.10 * exp(-0.01 * greatest(0, epoch(TIMESTAMP '{X.NOW_E}' - updated_at) / 86400)) + 0.05 * CASE WHEN most <= 0 THEN 0 ELSE ln(1 + access_count) / ln(1 + most) END) * {TIER} AS score FROM a)
    SELECT user_id, memory_id, round(score, 4) AS score, round(confidence, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, memory_id) AS rn FROM c) WHERE rn <= 8""")

# ---- interactions
add("l25_interaction_sources", lambda s, d: X.read(s, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "user_direct").otherwise("agent_inference").alias("source_type")).select("conv_id", "turn", "source_type", S.source_weight(F.col("source_type")).alias("weight")),
    "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user_direct' ELSE 'agent_inference' END AS source_type, CAST(CASE WHEN role = 'user' THEN {} ELSE {} END AS DOUBLE) AS weight FROM conversations".format(S.SOURCE_WEIGHTS.get("user_direct", 0.5), S.SOURCE_WEIGHTS.get("agent_inference", 0.5)))


# ---- status of documents
def _asked_status(s, d):
    """Paths that are there, parts of paths, and ones that are nowhere."""
    return X.doc_registry(s, d).where("num % 5 < 3").selectExpr("case num % 5 when 0 then rel_path when 1 then concat('doc', num % 40) else concat('old/', num) end as asked").distinct()


def _status(s, d):
    """The document of that path, else of the paths that hold it the shortest, then the first."""
    r, asked = X.doc_registry(s, d), _asked_status(s, d)
    exact = asked.join(r.select(F.col("rel_path").alias("asked"), F.col("rel_path").alias("exact")), "asked", "left")
    rest = exact.where("exact is null").select(F.col("asked").alias("phrase"))
    hits = PH.phrase_hits(r.select(F.col("num").alias("text_id"), F.col("rel_path").alias("text")), rest).join(r.select(F.col("num").alias("text_id"), "rel_path"), "text_id")
    near = hits.groupBy(F.col("phrase").alias("asked")).agg(F.min_by("rel_path", F.struct(F.length("rel_path"), "rel_path")).alias("near"))
    found = exact.join(near, "asked", "left").select("asked", F.coalesce("exact", "near").alias("rel_path"))
    after = r.alias("n").select(F.col("doc_id").alias("superseded_by"), F.col("rel_path").alias("successor"))
    named = r.select("rel_path", "tier", "lifecycle", "doc_type", "superseded_by", "age_days").join(after, "superseded_by", "left")
    standing = F.concat(F.col("rel_path"), F.lit(" is "), "tier", F.lit("/"), "lifecycle", F.lit(" ("), "doc_type", F.lit("): age "), "age_days", F.lit("d"), F.coalesce(F.concat(F.lit("; superseded by "), "successor"), F.lit("")))
    return found.join(named, "rel_path", "left").select("asked", F.coalesce(standing, F.lit("unknown")).alias("standing"))


add("q22_doc_status", _status, f"""WITH {X.REGISTRY}, a AS (SELECT DISTINCT CASE num % 5 WHEN 0 THEN rel_path WHEN 1 THEN 'doc' || (num % 40) ELSE 'old/' || num END AS asked FROM registry WHERE num % 5 < 3),
    f AS (SELECT asked, coalesce(max(CASE WHEN r.rel_path = asked THEN r.rel_path END), arg_min(r.rel_path, (length(r.rel_path), r.rel_path))) AS rel_path FROM a LEFT JOIN registry r ON contains(r.rel_path, asked) GROUP BY asked)
    SELECT asked, coalesce(r.rel_path || ' is ' || r.tier || '/' || r.lifecycle || ' (' || r.doc_type || '): age ' || r.age_days || 'd' || coalesce('; superseded by ' || n.rel_path, ''), 'unknown') AS standing FROM f LEFT JOIN registry r USING (rel_path) LEFT JOIN registry n ON n.doc_id = r.superseded_by""")


# ---- modules without a use
def _placed(s, d):
    """Modules at paths of all conventions; every ninth size has a main guard, and manifests declare every fourth."""
    p = X.read(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node_id"), F.concat(F.lit("mod."), "p_partkey").alias("qualified_name"), F.expr(f"case when p_size = 1 then null else {ENTRIES} end").alias("file_path"), (F.col("p_size") % 9 == 0).alias("guarded"))
    manifests = X.read(s, d, "part").where("p_partkey % 4 = 0").selectExpr("'' as folder", f"concat('{{\"main\": \"./', {ENTRIES}, '\", \"name\": \"', p_partkey, '.ts\"}}') as json")
    return p, N.script_entries(manifests).select(F.col("path").alias("file_path"))


def _few_imports(s, d):
    """A thirteenth of the links, so that some modules are left over."""
    return X.code_edges(s, d).where("invalid")


def _unused(s, d):
    nodes, declared = _placed(s, d)
    return G.unused(nodes.join(declared, "file_path", "left_anti"), _few_imports(s, d), R.is_entry_file(F.col("file_path")) | F.col("guarded")).select("qualified_name", "file_path")


add("q18_modules_without_use", _unused, f"""WITH {CODE}, m AS (SELECT p_partkey, 'P' || p_partkey AS node_id, CASE WHEN p_size = 1 THEN NULL ELSE {_ENTRIES_SQL} END AS file_path, p_size % 9 = 0 AS guarded, p_size % 7 IN (1, 2, 3) OR p_partkey % 6 IN (1, 3) OR (p_size % 7 = 0 AND p_partkey % 6 = 0) AS known FROM part),
    dc AS (SELECT regexp_replace({_ENTRIES_SQL}, '^[./]+', '') AS file_path FROM part WHERE p_partkey % 4 = 0)
    SELECT 'mod.' || p_partkey AS qualified_name, file_path FROM m WHERE file_path IS NOT NULL AND NOT known AND NOT guarded AND file_path NOT IN (SELECT file_path FROM dc) AND node_id NOT IN (SELECT dst_id FROM code_edges WHERE invalid)""")


# ---- documents in the graph
def _described(s, d):
    """The 'describes' edges of documents after their references changed: some were known, some are there now."""
    refs = DL.references(X.markdown(s, d).select(F.col("rel_path").alias("path"), "text")).where("kind in ('file', 'doc')").select(F.col("path").alias("doc_id"), F.col("value").alias("ref_value")).distinct()
    known, current = refs.where("length(ref_value) % 2 = 0"), refs.where("length(ref_value) % 3 <> 0")
    return D.reference_changes(known, current).select(F.col("doc_id").alias("document"), F.col("ref_value").alias("file"), F.lit("describes").alias("relation"), "change")


add("l27_described_edges", _described, """WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) || '.md' AS h FROM pages),
    v AS (SELECT DISTINCT page_id, regexp_replace(h, '#.*$', '') AS value FROM h WHERE NOT regexp_matches(h, '^https?://') AND NOT regexp_matches(h, '[)\\s]')),
    r AS (SELECT 'docs/p' || page_id || '.md' AS document, value AS file FROM v WHERE regexp_matches(value, '^[A-Za-z0-9_.@/\\\\-]+$') AND (contains(value, '/') OR ends_with(value, '.md')) UNION SELECT 'docs/p' || page_id || '.md', 'src/p' || (page_id % 7) || '.py' FROM pages UNION SELECT 'docs/p' || page_id || '.md', 'src/p' || (page_id % 5) || '.py' FROM pages),
    k AS (SELECT * FROM r WHERE length(file) % 2 = 0), c AS (SELECT * FROM r WHERE length(file) % 3 <> 0)
    SELECT document, file, 'describes' AS relation, 'invalidate' AS change FROM (SELECT * FROM k EXCEPT SELECT * FROM c) UNION ALL
    SELECT document, file, 'describes', 'add' FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY file) AS rn FROM (SELECT * FROM c EXCEPT SELECT * FROM k)) WHERE rn <= 50""")


# ---- scan by words
def _holding(s, d):
    """Active notes that hold any word of a first turn, as they are written, case aside."""
    words = X.read(s, d, "conversations").where("role = 'user' and turn = 0 and conv_id % 20 = 0").select(F.col("conv_id").alias("owner"), F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 3))).alias("phrase"))
    notes = X.notes(s, d).where("status = 'active'").select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text"))
    return PH.owners_in(notes, words).select(F.col("owner").alias("query_id"), F.col("text_id").alias("doc_id"))


add("p09_scan_words", _holding, f"""WITH {X.NOTES}, w AS (SELECT DISTINCT conv_id AS query_id, unnest(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 3)) AS w FROM conversations WHERE role = 'user' AND turn = 0 AND conv_id % 20 = 0)
    SELECT DISTINCT query_id, doc_id FROM w JOIN notes ON status = 'active' AND contains(lower(text), w)""")


# ---- export
_STAMP, _STAMP_SQL = "date_format({}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _export(s, d):
    """A store as lines: memories with content and metadata, the graph's edges and the documents, after a header with their numbers; ``place`` and ``made`` are the order."""
    m = X.mem(s, d)
    content, meta = F.struct("subject", "relation", "object", "domain", "is_negation"), F.struct("access_count", "doc_tier", "repo_id")
    memories = m.select(F.lit("memory").alias("section"), F.lit(1).alias("place"), F.expr(_STAMP.format("created_at")).alias("made"), "memory_id", F.struct("memory_id", "memory_type", "user_id", "status", content.alias("content"), meta.alias("metadata")).alias("row"))
    lines = memories.select("section", "place", "made", F.col("memory_id").alias("id"), F.to_json("row", {"ignoreNullFields": "false"}).alias("line"))
    e = X.edges(s, d)
    edges = e.select(F.lit("edge").alias("section"), F.lit(2).alias("place"), F.expr(_STAMP.format("valid_from")).alias("made"), F.col("edge_id").alias("id"), F.to_json(F.struct("edge_id", "src_id", "dst_id", "relation", "belief_id"), {"ignoreNullFields": "false"}).alias("line"))
    r = X.doc_registry(s, d)
    docs = r.select(F.lit("document").alias("section"), F.lit(3).alias("place"), F.lit("").alias("made"), F.col("doc_id").alias("id"), F.to_json(F.struct("doc_id", "rel_path", "doc_type", "tier", "lifecycle", "superseded_by"), {"ignoreNullFields": "false"}).alias("line"))
    body = lines.unionByName(edges).unionByName(docs)
    counts = body.agg(F.count_if(F.col("section") == "memory").alias("memories"), F.count_if(F.col("section") == "edge").alias("edges"), F.count_if(F.col("section") == "document").alias("documents"))
    header = counts.select(F.lit("header").alias("section"), F.lit(0).alias("place"), F.lit("").alias("made"), F.lit("").alias("id"), F.to_json(F.struct("memories", "edges", "documents")).alias("line"))
    return header.unionByName(body).orderBy("place", "made", "id")


add("s04_export_store", _export, f"""WITH {X.MEM}, {X.EDGES}, {X.REGISTRY}, b AS (
    SELECT 'memory' AS section, 1 AS place, {_STAMP_SQL.format('created_at')} AS made, memory_id AS id, CAST(json_object('memory_id', memory_id, 'memory_type', memory_type, 'user_id', user_id, 'status', status, 'content', json_object('subject', subject, 'relation', relation, 'object', object, 'domain', domain, 'is_negation', is_negation), 'metadata', json_object('access_count', access_count, 'doc_tier', doc_tier, 'repo_id', repo_id)) AS VARCHAR) AS line FROM mem
    UNION ALL SELECT 'edge', 2, {_STAMP_SQL.format('valid_from')}, edge_id, CAST(json_object('edge_id', edge_id, 'src_id', src_id, 'dst_id', dst_id, 'relation', relation, 'belief_id', belief_id) AS VARCHAR) FROM edges
    UNION ALL SELECT 'document', 3, '', doc_id, CAST(json_object('doc_id', doc_id, 'rel_path', rel_path, 'doc_type', doc_type, 'tier', tier, 'lifecycle', lifecycle, 'superseded_by', superseded_by) AS VARCHAR) FROM registry)
    SELECT * FROM b UNION ALL SELECT 'header', 0, '', '', '{{"memories":' || count(*) FILTER (section = 'memory') || ',"edges":' || count(*) FILTER (section = 'edge') || ',"documents":' || count(*) FILTER (section = 'document') || '}}' FROM b""")
