"""Queries of the kept document ledger, the report on it, proposals and verdicts, each with its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from memlake.operators import docledger as DL
from memlake.operators import documents as D
from memlake.operators import ledger as L
from memlake.operators import report as RP
from memlake.operators import verdicts as VD
from memlake.plans import docs as PD
from memlake.sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# ---- the ledger over three rounds of changes
def _rounds(s, d):
    """Documents of pages and files of parts: most at first; then others come and a third of the files lose a word; then some files and documents go; at last some documents change, and many come that are as they were."""
    docs = X.markdown(s, d).select("page_id", F.col("rel_path").alias("path"), F.concat("text", F.expr("concat('src/p', page_id, '.py::run src/p', page_id + 1, '.py::walk (src/p', page_id + 2, '.py::run)\\n')")).alias("text"))
    code = X.read(s, d, "part").selectExpr("p_partkey", "concat('src/p', p_partkey, '.py') as path", "concat(case when p_partkey % 3 = 0 then 'def run(): pass ' else 'running ' end, case when p_partkey % 2 = 0 then 'def walk(): pass' else 'sidewalk' end) as text")
    less = code.withColumn("text", F.replace("text", F.lit("run()"), F.lit("ran()")))
    gone = F.lit(None).cast("string").alias("text")
    yield docs.where("page_id % 4 <> 0").select("path", "text").unionByName(code.where("p_partkey % 5 <> 0").select("path", "text"))
    yield docs.where("page_id % 4 = 0").select("path", "text").unionByName(less.where("p_partkey % 6 = 0").select("path", "text"))
    yield docs.where("page_id % 9 = 0").select("path", gone).unionByName(code.where("p_partkey % 7 = 0").select("path", gone))
    more = F.when(F.col("page_id") % 10 == 1, F.concat(F.replace("text", F.lit("(src/p"), F.lit("(lib/p")), F.lit("- [ ] more\n"))).otherwise(F.col("text"))
    yield docs.where("page_id % 5 = 1 and page_id % 9 <> 0").select("path", more.alias("text"))


def _scanned(s, d):
    ledger = DL.DocLedger(s)
    for files in _rounds(s, d):
        ledger.scan(files)
    return ledger


_TREE = r"""pg AS (SELECT page_id AS k, page_id % 10 = 1 AND page_id % 9 <> 0 AS late FROM pages WHERE page_id % 9 <> 0),
    files AS (SELECT 'docs/p' || k || '.md' AS path FROM pg UNION ALL SELECT 'src/p' || p_partkey || '.py' FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 5 <> 0 OR p_partkey % 6 = 0)),
    has AS (SELECT 'src/p' || p_partkey || '.py' AS path, unnest(list_concat(CASE WHEN p_partkey % 3 = 0 AND p_partkey % 6 <> 0 THEN ['run'] ELSE [] END, CASE WHEN p_partkey % 2 = 0 THEN ['walk'] ELSE [] END)) AS word FROM part),
    h AS (SELECT DISTINCT page_id AS k, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) || '.md' AS h FROM pages),
    lk AS (SELECT k, regexp_replace(h, '#.*$', '') AS value FROM h WHERE NOT regexp_matches(h, '^https?://') AND NOT regexp_matches(h, '[)\s]')),
    sy AS (SELECT k, 'src/p' || (k % 5) || '.py' AS value, 'run' AS word, 1 AS nth FROM pg UNION ALL SELECT k, 'src/p' || k || '.py', 'run', 2 FROM pg UNION ALL SELECT k, 'src/p' || (k + 1) || '.py', 'walk', 3 FROM pg UNION ALL SELECT k, CASE WHEN late THEN 'lib/p' ELSE 'src/p' END || (k + 2) || '.py', 'run', 4 FROM pg),
    fr AS (SELECT pg.k, value FROM pg JOIN lk USING (k) WHERE regexp_matches(value, '^[A-Za-z0-9_.@/\\-]+$') AND (contains(value, '/') OR ends_with(value, '.md')) UNION SELECT k, 'src/p' || (k % 7) || '.py' FROM pg UNION SELECT k, value FROM sy),
    df AS (SELECT k, count(*) AS n FROM fr WHERE value NOT IN (SELECT path FROM files) GROUP BY k),
    ds AS (SELECT DISTINCT k, value, word FROM sy), dy AS (SELECT k, count(*) AS n FROM ds LEFT JOIN has ON has.path = ds.value AND has.word = ds.word WHERE ds.value NOT IN (SELECT path FROM files) OR has.word IS NULL GROUP BY k),
    bx AS (SELECT k, k % 4 + CAST(k % 5 = 0 AS INT) AS checked, k % 4 + CAST(k % 5 = 0 AS INT) + k % 3 + CAST(late AS INT) AS total FROM pg),
    sg AS (SELECT pg.k, 'docs/p' || pg.k || '.md' AS path, CASE WHEN total > 0 THEN CAST(checked AS INT) END AS checked, CASE WHEN total > 0 THEN CAST(total AS INT) END AS total, CASE WHEN total > 0 THEN round(checked / CAST(total AS DOUBLE), 3) END AS ratio, CAST(coalesce(df.n, 0) AS BIGINT) AS dead_files, CAST(coalesce(dy.n, 0) AS BIGINT) AS dead_symbols FROM pg JOIN bx USING (k) LEFT JOIN df USING (k) LEFT JOIN dy USING (k))"""
_SIGNALS = "path, coalesce(checked, 0) AS checked, coalesce(total, 0) AS total, coalesce(ratio, -1) AS ratio, dead_files, dead_symbols"
_plain = lambda t: t.selectExpr("path", "coalesce(checked, 0) as checked", "coalesce(total, 0) as total", "coalesce(ratio, -1.0D) as ratio", "dead_files", "dead_symbols")
add("q20_incremental_ledger", lambda s, d: _plain(_scanned(s, d).signals()), f"WITH {_TREE} SELECT {_SIGNALS} FROM sg")


def _in_one(s, d):
    """The same files in one scan."""
    last = {}
    for turn, files in enumerate(_rounds(s, d)):
        last[turn] = files.withColumn("turn", F.lit(turn))
    rows = reduce(lambda a, b: a.unionByName(b), last.values())
    ledger = DL.DocLedger(s)
    ledger.scan(rows.groupBy("path").agg(F.max_by(F.struct("text"), "turn").alias("l")).select("path", "l.text").where("text is not null"))
    return ledger


add("q20_full_ledger", lambda s, d: _plain(_in_one(s, d).signals()), f"WITH {_TREE} SELECT {_SIGNALS} FROM sg")
add("j15_refs_by_value", lambda s, d: _in_one(s, d).references_by_value().where("value like 'src/%' or value like 'lib/%'"),
    f"WITH {_TREE} SELECT value, count(DISTINCT k) AS docs FROM (SELECT k, value FROM fr WHERE value LIKE 'src/%' OR value LIKE 'lib/%' UNION ALL SELECT k, value || '::' || word FROM sy) GROUP BY value")


# ---- the report
def _signals_of(s, d):
    """Signals of the pages' documents against the files at the end, as registry paths by number."""
    docs = X.markdown(s, d).where("page_id % 9 <> 0").select("page_id", F.concat(F.lit("docs/p"), "page_id", F.lit(".md")).alias("path"), F.concat("text", F.expr("concat('src/p', page_id, '.py::run\\n')")).alias("text"))
    code = X.read(s, d, "part").where("p_partkey % 7 <> 0").selectExpr("concat('src/p', p_partkey, '.py') as path", "case when p_partkey % 3 = 0 then 'def run()' else 'pass' end as text")
    refs = DL.references(docs)
    dead = DL.dead_references(refs, docs.select("path").unionByName(code.select("path")), code.select("path", F.explode(DL.words(F.col("text"))).alias("word")))
    issues = refs.where("kind = 'issue'").select(F.col("path").alias("doc"), "place", F.col("value").alias("issue"))
    merged = L.merge_evidence(issues, X.commits(s, d)).select(F.col("doc").alias("path"), "merged")
    return docs.select("page_id", "path", L.checkboxes(F.col("text"))["ratio"].alias("ratio")).join(dead, "path", "left").join(merged, "path", "left")


_AT = r"""pg AS (SELECT page_id AS k FROM pages WHERE page_id % 9 <> 0), fl AS (SELECT 'docs/p' || k || '.md' AS path FROM pg UNION ALL SELECT 'src/p' || p_partkey || '.py' FROM part WHERE p_partkey % 7 <> 0),
    lk AS (SELECT DISTINCT k, regexp_replace(h, '#.*$', '') AS value FROM (SELECT page_id AS k, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) || '.md' AS h FROM pages WHERE page_id % 9 <> 0) WHERE NOT regexp_matches(h, '^https?://') AND NOT regexp_matches(h, '[)\s]')),
    sy AS (SELECT k, k % 5 AS n FROM pg UNION SELECT k, k FROM pg), fr AS (SELECT k, value FROM lk WHERE regexp_matches(value, '^[A-Za-z0-9_.@/\\-]+$') AND (contains(value, '/') OR ends_with(value, '.md')) UNION SELECT k, 'src/p' || (k % 7) || '.py' FROM pg UNION SELECT k, 'src/p' || n || '.py' FROM sy),
    dd AS (SELECT k, sum(n) AS dead FROM (SELECT k, count(*) AS n FROM fr WHERE value NOT IN (SELECT path FROM fl) GROUP BY k UNION ALL SELECT k, count(*) FROM sy WHERE 'src/p' || n || '.py' NOT IN (SELECT path FROM fl) OR n % 3 <> 0 GROUP BY k) GROUP BY k),
    sj AS (SELECT DISTINCT 'fix #' || o_custkey AS subject FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    sg AS (SELECT k, CASE WHEN k % 4 + CAST(k % 5 = 0 AS INT) + k % 3 > 0 THEN round((k % 4 + CAST(k % 5 = 0 AS INT)) / CAST(k % 4 + CAST(k % 5 = 0 AS INT) + k % 3 AS DOUBLE), 3) END AS ratio, dead, EXISTS (SELECT 1 FROM sj WHERE contains(subject, '#' || (k % 50))) AS merged FROM pg LEFT JOIN dd USING (k))"""


def _report_input(s, d):
    r = X.doc_registry(s, d).withColumn("lifecycle", F.expr("case when num % 10 = 3 then 'draft' else lifecycle end"))
    signals = r.select("rel_path", F.col("num").alias("page_id")).join(_signals_of(s, d), "page_id").select("rel_path", "ratio", "dead_files", "dead_symbols", "merged")
    return r, signals


def _found(s, d):
    r, signals = _report_input(s, d)
    near = D.clusters(D.near_pairs(D.simhash(X.read(s, d, "documents"), "doc_id", F.col("text")))).join(r.select(F.col("num").alias("id"), "rel_path"), "id")
    least = near.groupBy("cluster").agg(F.min("rel_path").alias("name"))
    return r, RP.findings(r, signals.drop("merged"), near.join(least, "cluster").select("rel_path", F.col("name").alias("cluster")))


_WINDOW = "CASE doc_type WHEN 'plan' THEN 30 WHEN 'brainstorm' THEN 14 WHEN 'guide' THEN 90 END"
_REPORT = f"""WITH RECURSIVE {PD.PRINTS}, pr AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.doc_id <> b.doc_id AND hamming(a.bits, b.bits) <= 6), rc(a, c) AS (SELECT DISTINCT a, a FROM pr UNION SELECT pr.b, rc.c FROM rc JOIN pr ON rc.a = pr.a WHERE rc.c < pr.b),
    {X.REGISTRY}, {_AT}, cl AS (SELECT a AS num, min(c) AS c FROM rc GROUP BY a), cn AS (SELECT num, min(rel_path) OVER (PARTITION BY c) AS cluster FROM cl JOIN registry USING (num)),
    rg AS (SELECT r.rel_path, r.num, r.doc_type, r.tier, r.age_days, CASE WHEN r.num % 10 = 3 THEN 'draft' ELSE r.lifecycle END AS life, {_WINDOW} AS win, sg.ratio, sg.dead, cn.cluster FROM registry r LEFT JOIN sg ON sg.k = r.num LEFT JOIN cn ON cn.num = r.num),
    fd AS (SELECT rel_path, CAST(CASE WHEN age_days > win AND life IN ('active', 'draft') THEN age_days END AS BIGINT) AS stale, CAST(nullif(dead, 0) AS BIGINT) AS dead, cluster,
      CASE WHEN tier NOT IN ('T0', 'T1') THEN nullif(concat_ws('; ', CASE WHEN life IN ('fulfilled', 'superseded') THEN 'lifecycle ' || life END, CASE WHEN age_days > win AND (tier = 'T3' OR ratio = 1) THEN 'stale ' || doc_type || ' (' || age_days || 'd > ' || win || 'd)' END), '') END AS archive FROM rg)"""
_BLANK = "coalesce(stale, -1) AS stale, coalesce(dead, 0) AS dead, coalesce(cluster, '') AS cluster, coalesce(archive, '') AS archive"
add("q21_rot_report", lambda s, d: _found(s, d)[1].selectExpr("rel_path", "coalesce(stale, -1) as stale", "coalesce(dead, 0) as dead", "coalesce(cluster, '') as cluster", "coalesce(archive, '') as archive"),
    f"{_REPORT} SELECT rel_path, {_BLANK} FROM fd WHERE stale IS NOT NULL OR dead IS NOT NULL OR cluster IS NOT NULL OR archive IS NOT NULL")
add("a16_rot_rollup", lambda s, d: RP.totals(*_found(s, d)), f"{_REPORT} SELECT count(*) AS total_docs, count(stale) AS stale, count(dead) AS dead, count(DISTINCT cluster) AS clusters, count(archive) AS archive_candidates FROM fd")


def _proposed(s, d):
    r, signals = _report_input(s, d)
    return RP.proposals(r, signals.select("rel_path", "ratio"), signals.select("rel_path", "merged"))


add("s20_proposals", _proposed, f"WITH {X.REGISTRY}, {_AT} SELECT rel_path FROM registry JOIN sg ON k = num WHERE doc_type = 'plan' AND lifecycle = 'active' AND num % 10 <> 3 AND (ratio >= 0.9 OR merged)")


# ---- verdicts
def _registry_rows(s, d):
    return X.doc_registry(s, d).selectExpr("doc_id", "rel_path", "md5(text) as hash", "doc_type", "tier", "lifecycle", "'heuristic' as type_source", "superseded_by", "cast(null as string) as fulfilled_by")


_KINDS = "case num % 6 when 0 then 'classify' when 1 then 'supersede' when 2 then 'fulfill' when 3 then 'archive' when 4 then 'restore' else 'classify' end"


def _requests(s, d, shift: int):
    """A verdict on every document but each seventh, and some twice or on paths that aren't there."""
    r = X.doc_registry(s, d).where("num % 7 <> 0").withColumn("num", F.col("num") + shift)
    return r.selectExpr(
        "explode(case when num % 20 = 0 then array(num, num + 1000000) else array(num) end) as seq", f"{_KINDS} as verdict", "case when num % 25 = 3 then 'no/where.md' else rel_path end as path",
        "case when num % 35 = 5 then '```' else 'runbook' end as doc_type", "case when num % 4 = 0 then 'T2' end as tier", "case when num % 15 = 1 then 'no.md' else rel_path end as successor",
        "case when num % 9 = 2 then array() else array('a', 'b') end as facts", "'#1' as evidence",
    )


def _judged(s, d):
    """Three commits: the verdicts, the same again, and others; a backup is pinned after the first."""
    store = VD.Registry(s)
    store.start(_registry_rows(s, d))
    said = [store.commit(_requests(s, d, 0)).withColumn("turn", F.lit(1))]
    store.tables.pin("backup")
    said += [store.commit(_requests(s, d, shift)).withColumn("turn", F.lit(turn)) for turn, shift in ((2, 0), (3, 1))]
    return store, reduce(lambda a, b: a.unionByName(b), said)


def _turn(n: int, shift: int, old: str) -> str:
    """The actions j{n} on registry {old} and the registry r{n} after them."""
    return f"""q{n} AS (SELECT unnest(CASE WHEN m % 20 = 0 THEN [m, m + 1000000] ELSE [m] END) AS seq, CASE m % 6 WHEN 0 THEN 'classify' WHEN 1 THEN 'supersede' WHEN 2 THEN 'fulfill' WHEN 3 THEN 'archive' WHEN 4 THEN 'restore' ELSE 'classify' END AS verdict, CASE WHEN m % 25 = 3 THEN 'no/where.md' ELSE rel_path END AS path,
      CASE WHEN m % 35 = 5 THEN '```' ELSE 'runbook' END AS t, CASE WHEN m % 4 = 0 THEN 'T2' END AS to_tier, CASE WHEN m % 15 = 1 THEN 'no.md' ELSE rel_path END AS successor, m % 9 <> 2 AS facts FROM (SELECT num + {shift} AS m, rel_path FROM registry WHERE num % 7 <> 0)),
    a{n} AS (SELECT q.*, r.doc_id, r.tier AS old_tier, r.lifecycle, b.doc_id AS by_id, row_number() OVER (PARTITION BY coalesce(r.doc_id, path) ORDER BY seq) = 1 AS lead, EXISTS (SELECT 1 FROM s{n - 1} s WHERE s.doc_id = r.doc_id AND q.verdict = 'classify' AND s.said = concat_ws(':', 'classify', t, to_tier)) AS again FROM q{n} q LEFT JOIN {old} r ON r.rel_path = q.path LEFT JOIN {old} b ON b.rel_path = q.successor),
    j{n} AS (SELECT *, CASE WHEN verdict = 'classify' AND t = '```' THEN 'invalid' WHEN verdict = 'fulfill' AND NOT facts THEN 'invalid' WHEN doc_id IS NULL OR (verdict = 'supersede' AND by_id IS NULL) OR (verdict = 'restore' AND lifecycle <> 'archived') THEN 'missing' WHEN NOT lead THEN 'later' WHEN again THEN 'unchanged' WHEN verdict = 'archive' AND old_tier IN ('T0', 'T1') THEN 'refused'
      ELSE MAP {{'classify': 'classified', 'supersede': 'superseded', 'fulfill': 'fulfilled', 'archive': 'archived', 'restore': 'restored'}}[verdict] END AS action FROM a{n}),
    k{n} AS (SELECT * FROM j{n} WHERE action IN ('classified', 'superseded', 'fulfilled', 'archived', 'restored')),
    s{n} AS (SELECT * FROM s{n - 1} UNION ALL SELECT doc_id, concat_ws(':', 'classify', t, to_tier), NULL, NULL, NULL FROM k{n} WHERE action = 'classified' UNION ALL SELECT doc_id, 'archived', lifecycle, path, {n} FROM k{n} WHERE action = 'archived'),
    r{n} AS (SELECT r.doc_id, CASE action WHEN 'archived' THEN 'docs/archive/' || r.rel_path WHEN 'restored' THEN coalesce(z.origin, r.rel_path) ELSE r.rel_path END AS rel_path, CASE WHEN action = 'classified' THEN t ELSE r.doc_type END AS doc_type, CASE WHEN action = 'classified' THEN coalesce(to_tier, r.tier) ELSE r.tier END AS tier,
      CASE WHEN action IN ('superseded', 'fulfilled', 'archived') THEN action WHEN action = 'restored' THEN coalesce(z.prior, 'active') ELSE r.lifecycle END AS lifecycle, CASE WHEN action = 'superseded' THEN by_id ELSE r.superseded_by END AS superseded_by
      FROM {old} r LEFT JOIN k{n} k USING (doc_id) LEFT JOIN (SELECT doc_id, arg_max(prior, turn) AS prior, arg_max(origin, turn) AS origin FROM s{n - 1} WHERE said = 'archived' GROUP BY doc_id) z USING (doc_id))"""


_VERDICTS = f"WITH {X.REGISTRY}, s0 AS (SELECT CAST(NULL AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS said, CAST(NULL AS VARCHAR) AS prior, CAST(NULL AS VARCHAR) AS origin, CAST(NULL AS INT) AS turn WHERE false), {_turn(1, 0, 'registry')}, {_turn(2, 0, 'r1')}, {_turn(3, 1, 'r2')}"
_STANDING = ["doc_id", "rel_path", "doc_type", "tier", "lifecycle", "coalesce(superseded_by, '') as superseded_by"]
add("l14_verdicts", lambda s, d: _judged(s, d)[0].registry().selectExpr(*_STANDING), f"{_VERDICTS} SELECT {', '.join(_STANDING)} FROM r3")
add("l14_actions", lambda s, d: _judged(s, d)[1], f"{_VERDICTS} SELECT seq, path, action, 1 AS turn FROM j1 UNION ALL SELECT seq, path, action, 2 FROM j2 UNION ALL SELECT seq, path, action, 3 FROM j3")
add("s18_pinned_backup", lambda s, d: _judged(s, d)[0].registry(pin="backup").selectExpr(*_STANDING), f"{_VERDICTS} SELECT {', '.join(_STANDING)} FROM r1")


def _kept_judgement(s, d):
    store = VD.Registry(s)
    store.start(_registry_rows(s, d))
    store.commit(_requests(s, d, 0).where("verdict = 'classify'"))
    found = X.doc_registry(s, d).where("num % 3 <> 1").selectExpr("rel_path", "md5(concat(text, 'x')) as hash", "'spec' as doc_type", "'T3' as tier", "'heuristic' as type_source")
    return VD.rescanned(store.registry(), found).select("doc_id", "doc_type", "tier", "type_source")


add("l23_judgement_kept", _kept_judgement, f"""{_VERDICTS}, c AS (SELECT doc_id, to_tier FROM k1 WHERE action = 'classified')
    SELECT r.doc_id, CASE WHEN c.doc_id IS NOT NULL THEN 'runbook' WHEN num % 3 <> 1 THEN 'spec' ELSE doc_type END AS doc_type, CASE WHEN c.doc_id IS NOT NULL THEN coalesce(to_tier, tier) WHEN num % 3 <> 1 THEN 'T3' ELSE tier END AS tier, CASE WHEN c.doc_id IS NOT NULL THEN 'agent' ELSE 'heuristic' END AS type_source FROM registry r LEFT JOIN c USING (doc_id)""")


# ---- dead references
add("q24_dead_refs", lambda s, d: _signals_of(s, d).where("dead_files + dead_symbols > 0").select("path", "dead_files", "dead_symbols"), f"""WITH {_AT},
    df AS (SELECT k, count(*) AS n FROM fr WHERE value NOT IN (SELECT path FROM fl) GROUP BY k), dy AS (SELECT k, count(*) AS n FROM sy WHERE 'src/p' || n || '.py' NOT IN (SELECT path FROM fl) OR n % 3 <> 0 GROUP BY k)
    SELECT 'docs/p' || k || '.md' AS path, CAST(coalesce(df.n, 0) AS BIGINT) AS dead_files, CAST(coalesce(dy.n, 0) AS BIGINT) AS dead_symbols FROM pg LEFT JOIN df USING (k) LEFT JOIN dy USING (k) WHERE coalesce(df.n, 0) + coalesce(dy.n, 0) > 0""")
