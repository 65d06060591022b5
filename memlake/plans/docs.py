"""Queries over documents, texts, vectors and the change journal, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions.scoring import approx_tokens
from memlake.operators import documents as D
from memlake.operators import lexical as L
from memlake.operators import vector as V
from memlake.sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def reg(name: str, transform, sql: str) -> None:
    add(name, lambda s, d: transform(X.doc_registry(s, d)), f"WITH {X.REGISTRY} {sql}" if not sql.startswith(",") else f"WITH {X.REGISTRY}{sql}")


def doc(name: str, transform, sql: str) -> None:
    add(name, lambda s, d: transform(X.read(s, d, "documents")), sql)


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


STOP = _quoted(T.STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND NOT list_contains([{STOP}], w))"

# ---- ledger
reg("s19_quarantine", lambda r: r.where("lifecycle in ('superseded', 'archived') or tier = 'TX'").alias("a").join(r.alias("b"), F.expr("a.superseded_by = b.doc_id"), "left").selectExpr("a.rel_path as rel_path", "a.lifecycle as lifecycle", "a.tier as tier", "coalesce(b.rel_path, '') as superseded_by"),
    "SELECT a.rel_path, a.lifecycle, a.tier, coalesce(b.rel_path, '') AS superseded_by FROM registry a LEFT JOIN registry b ON a.superseded_by = b.doc_id WHERE a.lifecycle IN ('superseded', 'archived') OR a.tier = 'TX'")
reg("q23_knowledge_map", lambda r: r.withColumn("rn", F.row_number().over(Window.partitionBy("tier", "lifecycle").orderBy("rel_path"))).groupBy("tier", "lifecycle").agg(F.count("*").alias("n"), F.concat_ws(", ", F.sort_array(F.collect_list(F.when(F.col("rn") <= 3, F.col("rel_path"))))).alias("first_paths")),
    ", k AS (SELECT *, row_number() OVER (PARTITION BY tier, lifecycle ORDER BY rel_path) AS rn FROM registry) SELECT tier, lifecycle, count(*) AS n, string_agg(rel_path, ', ' ORDER BY rel_path) FILTER (rn <= 3) AS first_paths FROM k GROUP BY ALL")
add("a06_link_indegree", lambda s, d: X.doc_refs(s, d).groupBy("ref_value").agg(F.count("*").alias("n")), f"WITH {X.REFS} SELECT ref_value, count(*) AS n FROM refs GROUP BY ALL")
add("u05_reference_changes", lambda s, d: D.reference_changes(X.doc_refs(s, d).withColumnRenamed("page_id", "doc_id").where("doc_id % 3 <> 0 or length(ref_value) % 2 = 0"), X.doc_refs(s, d).withColumnRenamed("page_id", "doc_id").where("length(ref_value) % 3 <> 0"), 50),
    f"""WITH {X.REFS}, k AS (SELECT page_id AS doc_id, ref_value FROM refs WHERE page_id % 3 <> 0 OR length(ref_value) % 2 = 0), c AS (SELECT page_id AS doc_id, ref_value FROM refs WHERE length(ref_value) % 3 <> 0)
    SELECT doc_id, ref_value, 'invalidate' AS change FROM (SELECT * FROM k EXCEPT SELECT * FROM c) UNION ALL
    SELECT doc_id, ref_value, 'add' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ref_value) AS rn FROM (SELECT * FROM c EXCEPT SELECT * FROM k)) WHERE rn <= 50""")
QUERIES["l27_document_edges"], ORACLES["l27_document_edges"] = QUERIES["u05_reference_changes"], ORACLES["u05_reference_changes"]
doc("j16_renames", lambda t: D.renames(t.where("doc_id % 2 = 0").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.md5("text").alias("hash")), t.where("doc_id % 2 = 1").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.md5("text").alias("hash"))),
    """WITH v AS (SELECT source || '/' || doc_id AS path, md5(text) AS h, doc_id % 2 AS side FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY side, h ORDER BY path) AS rn FROM v)
    SELECT a.path AS old_path, b.path AS new_path FROM n a JOIN n b ON a.h = b.h AND a.rn = b.rn AND a.side = 0 AND b.side = 1""")
doc("u06_path_sets", lambda t: t.where("doc_id % 3 <> 0").select("doc_id", F.lit(1).alias("old")).join(t.where("doc_id % 4 <> 0").select("doc_id", F.lit(1).alias("new")), "doc_id", "full_outer").select("doc_id", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "vanished").otherwise("present").alias("state")),
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 4 = 0 THEN 'vanished' ELSE 'present' END AS state FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 <> 0")
doc("u10_partial_scan", lambda t: t.where("doc_id % 7 = 0").select("doc_id").join(t.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi"), "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND lang = 'en'")

# ---- near-copies by simhash
GRAMS = "w AS (SELECT doc_id, list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents), g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS gram FROM w)"
PRINTS = GRAMS + ", h AS (SELECT doc_id, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(md5(gram), 9, 8) AS BIGINT) AS lo FROM g), p AS (SELECT doc_id, " + " || ".join(
    f"CASE WHEN sum((({'hi' if b >= 32 else 'lo'} >> {b % 32}) & 1) * 2 - 1) > 0 THEN '1' ELSE '0' END" for b in range(63, -1, -1)
) + " AS bits FROM h GROUP BY doc_id)"


def _prints(t):
    return D.simhash(t, "doc_id", F.col("text"))


doc("a11_simhash", lambda t: _prints(t).select("id", F.lpad(F.conv(F.hex("fingerprint"), 16, 2), 64, "0").alias("bits")), f"WITH {PRINTS} SELECT doc_id AS id, bits FROM p")
_PAIRS = f"WITH RECURSIVE {PRINTS}, pr AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.doc_id <> b.doc_id AND hamming(a.bits, b.bits) <= 6)"
doc("j17_a12_simhash_clusters", lambda t: D.clusters(D.near_pairs(_prints(t))), _PAIRS + ", r(a, c) AS (SELECT DISTINCT a, a FROM pr UNION SELECT pr.b, r.c FROM r JOIN pr ON r.a = pr.a WHERE r.c < pr.b) SELECT a AS id, min(c) AS cluster FROM r GROUP BY a")

# ---- text functions
doc("a07_document_frequency", lambda t: t.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
_T13 = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in T.SECRETS) + " END"
doc("t13_secrets", lambda t: t.select("doc_id", T.secret_name(F.col("text")).alias("secret")).where("secret is not null"), f"SELECT * FROM (SELECT doc_id, {_T13} AS secret FROM documents) WHERE secret IS NOT NULL")
doc("t13_redact", lambda t: t.where(T.secret_name(F.col("text")).isNotNull()).select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest")), f"SELECT doc_id, md5(regexp_replace(text, '{T.SECRETS[-1][1]}', '[REDACTED:credential-assignment]', 'g')) AS digest FROM documents WHERE {_T13} = 'credential-assignment'")
doc("t12_sanitize", lambda t: t.select("doc_id", F.md5(T.sanitize(F.col("text"))).alias("digest")), """WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '={2,}', '=', 'g'), '\\[([A-Z_]+)\\]', '(\\1)', 'g'), '\\s+', ' ', 'g')) AS x FROM documents)
    SELECT doc_id, md5(CASE WHEN length(x) > 500 THEN substr(x, 1, 500) || '…' ELSE x END) AS digest FROM c""")
doc("t19_shingles", lambda t: t.select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n")), f"WITH {GRAMS} SELECT w.doc_id, count(g.gram) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id")
doc("t23_origin_hash", lambda t: t.select("doc_id", F.substring(F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256), 1, 12).alias("origin")), "SELECT doc_id, substr(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 12) AS origin FROM documents")
doc("t15_clean_text", lambda t: t.select("doc_id", F.length(F.nullif(F.trim("text"), F.lit(""))).cast("long").alias("n")), "SELECT doc_id, length(nullif(trim(text), '')) AS n FROM documents")
doc("f15_tokens_budget", lambda t: t.select("doc_id", approx_tokens(F.col("text")).cast("long").alias("tokens")), "SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
add("t21_url_normalise", lambda s, d: X.read(s, d, "pages").select("page_id", F.lower(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "([.]html|/)?([?#].*)?$", "")).alias("place")), "SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '([.]html|/)?([?#].*)?$', '')) AS place FROM pages")

# ---- keyword search
TERMS = ["then", "intion", "heiter"]


def _index(t):
    return L.postings(t, "doc_id", T.tokens(F.col("text")))


def _bm25(t, prefix):
    index = _index(t)
    n, mean = t.agg(F.count("*"), F.avg(F.size(T.tokens(F.col("text"))))).first()
    hits = L.bm25(index, n, mean, TERMS, prefix)
    return hits.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(32)


def _bm25_sql(match: str) -> str:
    return f"""WITH t AS (SELECT doc_id, {TOKENS} AS terms FROM documents), n AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM t),
    x AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM t), q AS (SELECT unnest([{_quoted(TERMS)}]) AS query),
    r AS (SELECT query, doc_id, dl, count(*) AS tf FROM x JOIN q ON {match} GROUP BY ALL), f AS (SELECT query, count(*) AS df FROM r GROUP BY ALL)
    SELECT doc_id AS id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM r JOIN f USING (query), n GROUP BY doc_id ORDER BY score DESC, id LIMIT 32"""


doc("q03_bm25_search", lambda t: _bm25(t, False), _bm25_sql("term = query"))
doc("q03_bm25_prefix", lambda t: _bm25(t, True), _bm25_sql("starts_with(term, query)"))
GROUPS = [["then", "than"], ["intion"], ["heiter", "heit"]]
doc("q04_overlap_search", lambda t: L.overlap(t, "doc_id", T.tokens(F.col("text")), GROUPS).select("id", F.round("similarity", 6).alias("similarity")), f"WITH t AS (SELECT doc_id, {TOKENS} AS terms FROM documents) SELECT * FROM (SELECT doc_id AS id, round(({' + '.join(f'CAST(list_has_any(terms, [{_quoted(g)}]) AS INT)' for g in GROUPS)}) / 3.0, 6) AS similarity FROM t) WHERE similarity > 0")
QUERIES["f08_overlap"], ORACLES["f08_overlap"] = QUERIES["q04_overlap_search"], ORACLES["q04_overlap_search"]
# ---- vectors
COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


def _vectors(s, d):
    return X.read(s, d, "embeddings")


add("q05_vector_search", lambda s, d: V.nearest(_vectors(s, d), _vectors(s, d).where("vec_id = 0"), 32, F.expr("vec_id % 11 > 2")).select("vec_id", F.round("similarity", 6).alias("similarity")), f"SELECT b.vec_id, round({COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id % 11 > 2 ORDER BY round({COS}, 9) DESC, b.vec_id LIMIT 32")
add("k02_oversampled", lambda s, d: V.nearest_blocks(_vectors(s, d), _vectors(s, d).where("vec_id % 20 = 0"), 8).select("query_id", "vec_id", F.col("place").cast("long").alias("place")), f"SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 9) DESC, b.vec_id) AS place FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE place <= 8")


add("j23_reconcile_vectors", lambda s, d: X.mem(s, d).where("status = 'active'").select("event_id").join(_vectors(s, d).select(F.col("vec_id").alias("event_id")), "event_id", "left_anti"), f"WITH {X.MEM} SELECT event_id FROM mem WHERE status = 'active' AND event_id NOT IN (SELECT vec_id FROM embeddings)")

# ---- change journal
add("a15_journal_depth", lambda s, d: X.journal(s, d).groupBy("repo_id", "change").agg(F.count("*").alias("n")), f"WITH {X.JOURNAL} SELECT repo_id, change, count(*) AS n FROM journal GROUP BY ALL")
add("r01_enqueue_valid", lambda s, d: X.journal(s, d).where("change in ('added', 'modified', 'removed', 'renamed', 'git', 'manifest') and (path is not null or change in ('git', 'manifest'))").groupBy("repo_id").agg(F.count("*").alias("n"), F.max("seq").alias("last")), f"WITH {X.JOURNAL} SELECT repo_id, count(*) AS n, max(seq) AS last FROM journal WHERE path IS NOT NULL OR change = 'git' GROUP BY ALL")
add("r02_claim_batch", lambda s, d: X.journal(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("repo_id").orderBy("seq"))).where("rn <= 200").select("repo_id", "seq"), f"WITH {X.JOURNAL} SELECT repo_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seq) AS rn FROM journal) WHERE rn <= 200")
add("r05_latest_state", lambda s, d: X.journal(s, d).where("path is not null").groupBy("repo_id", "path").agg(F.max_by("change", "seq").alias("change"), F.max("seq").alias("seq")), f"WITH {X.JOURNAL} SELECT repo_id, path, arg_max(change, seq) AS change, max(seq) AS seq FROM journal WHERE path IS NOT NULL GROUP BY ALL")
add("a19_generation", lambda s, d: X.journal(s, d).groupBy("repo_id").agg(F.max("seq").alias("generation")), f"WITH {X.JOURNAL} SELECT repo_id, max(seq) AS generation FROM journal GROUP BY ALL")
add("u09_dirty_paths", lambda s, d: X.journal(s, d).where("seq % 2 = 0").select("path").union(X.journal(s, d).where("seq % 3 = 0").select("old_path")).where("path is not null").distinct(), f"WITH {X.JOURNAL} SELECT path FROM journal WHERE seq % 2 = 0 AND path IS NOT NULL UNION SELECT old_path FROM journal WHERE seq % 3 = 0 AND old_path IS NOT NULL")
def _windows(s, d, width, slide=None):
    from memlake.streaming.journal import window_counts

    events = X.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return window_counts(events, width, slide).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


add("ext_tumbling_windows", lambda s, d: _windows(s, d, "1 hour"), "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
add("ext_sliding_windows", lambda s, d: _windows(s, d, "1 hour", "30 minutes").select("start", "event_type", "n"), "SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 - k * 1800 AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS t(k) GROUP BY ALL")


def _sessions(s, d):
    from memlake.streaming.journal import session_counts

    return session_counts(X.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


add("ext_session_windows", _sessions, """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id""")
