"""Store-shaped views over the driver's tables, as DataFrames and as SQL.

Each view is given twice with the same formula: a function for Spark and a
common table expression for the oracle. Clocks are fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_E = "2024-02-01 00:00:00"
NOW_O = "2002-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories table, one row an event."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.selectExpr(
        "concat('m', lpad(cast(event_id as string), 10, '0')) as memory_id",
        "event_id",
        "case when user_id % 10 = 0 then null else concat('u', user_id) end as user_id",
        "case event_type when 'click' then 'belief' when 'view' then 'belief' when 'purchase' then 'event' when 'error' then 'skill' else 'world_model' end as memory_type",
        "case when user_id % 7 = 0 then 'user' else concat('s', user_id % 20) end as subject",
        "event_type as relation",
        "concat('o', k) as object",
        "case when k % 3 = 0 then null else concat('d', k % 3) end as domain",
        "event_id % 17 = 0 as is_negation",
        "round(0.05D + (event_id % 96) / 100.0D, 2) as confidence",
        "case event_id % 11 when 0 then 'superseded' when 1 then 'deprecated' when 2 then 'archived' else 'active' end as status",
        "case event_type when 'purchase' then 0.0D when 'signup' then 0.005D else 0.02D end as decay_rate",
        "ts as created_at",
        "ts + make_dt_interval(0, cast(event_id % 48 as int)) as updated_at",
        "cast(event_id % 13 as int) as access_count",
        "case when event_id % 4 = 0 then null else ts end as last_used",
        "case event_id % 9 when 0 then 'T0' when 1 then 'T1' when 2 then 'T2' when 3 then 'T3' when 4 then 'TX' end as doc_tier",
        "case when user_id % 4 = 0 then null else concat('r', user_id % 4) end as repo_id",
        "case when event_id % 3 = 0 then array() when event_id % 3 = 1 then null else array(concat('m', lpad(cast(event_id as string), 10, '0'))) end as related_beliefs",
    )


MEM = """mem AS (
  SELECT 'm' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS memory_id, event_id,
    CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'u' || user_id END AS user_id,
    CASE event_type WHEN 'click' THEN 'belief' WHEN 'view' THEN 'belief' WHEN 'purchase' THEN 'event' WHEN 'error' THEN 'skill' ELSE 'world_model' END AS memory_type,
    CASE WHEN user_id % 7 = 0 THEN 'user' ELSE 's' || (user_id % 20) END AS subject,
    event_type AS relation, 'o' || k AS object,
    CASE WHEN k % 3 = 0 THEN NULL ELSE 'd' || (k % 3) END AS domain,
    event_id % 17 = 0 AS is_negation,
    round(CAST(0.05 AS DOUBLE) + CAST(event_id % 96 AS DOUBLE) / CAST(100 AS DOUBLE), 2) AS confidence,
    CASE event_id % 11 WHEN 0 THEN 'superseded' WHEN 1 THEN 'deprecated' WHEN 2 THEN 'archived' ELSE 'active' END AS status,
    CAST(CASE event_type WHEN 'purchase' THEN 0.0 WHEN 'signup' THEN 0.005 ELSE 0.02 END AS DOUBLE) AS decay_rate,
    ts AS created_at, ts + to_hours(CAST(event_id % 48 AS INT)) AS updated_at,
    CAST(event_id % 13 AS INT) AS access_count,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS last_used,
    CASE event_id % 9 WHEN 0 THEN 'T0' WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' WHEN 3 THEN 'T3' WHEN 4 THEN 'TX' END AS doc_tier,
    CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'r' || (user_id % 4) END AS repo_id,
    event_id % 3 = 0 OR event_id % 3 = 1 AS unlinked
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge-graph nodes: regions, nations, suppliers, customers and parts."""
    kinds = [("region", "R", "r_regionkey", "r_name"), ("nation", "N", "n_nationkey", "n_name"), ("supplier", "S", "s_suppkey", "s_name"), ("customer", "C", "c_custkey", "c_name"), ("part", "P", "p_partkey", "p_name")]
    out = None
    for table, mark, key, name in kinds:
        one = read(spark, sf_dir, table).selectExpr(
            f"concat('{mark}', {key}) as node_id",
            f"{name} as display_name",
            f"'{table}' as entity_type",
            f"cast({'0' if table in ('region', 'nation') else '1'} as int) as expandable",
            f"cast({key} % 4 as int) as mention_count",
            "'active' as status",
            f"cast('{NOW_O}' as timestamp_ntz) - make_dt_interval(cast({key} % 200 as int)) as updated_at",
        )
        out = one if out is None else out.unionByName(one)
    return out


def _node_sql(table: str, mark: str, key: str, name: str) -> str:
    return f"""SELECT '{mark}' || {key} AS node_id, {name} AS display_name, '{table}' AS entity_type, {0 if table in ("region", "nation") else 1} AS expandable,
    CAST({key} % 4 AS INT) AS mention_count, 'active' AS status, TIMESTAMP '{NOW_O}' - to_days(CAST({key} % 200 AS INT)) AS updated_at FROM {table}"""


NODES = "nodes AS (" + " UNION ALL ".join(_node_sql(*x) for x in (("region", "R", "r_regionkey", "r_name"), ("nation", "N", "n_nationkey", "n_name"), ("supplier", "S", "s_suppkey", "s_name"), ("customer", "C", "c_custkey", "c_name"), ("part", "P", "p_partkey", "p_name"))) + ")"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal edges: part_of, belongs_to and manages."""
    long_ago = "cast('1990-01-01 00:00:00' as timestamp_ntz)"
    none = "cast(null as timestamp_ntz) as invalid_at"

    def plain(table: str, src: str, dst: str, relation: str) -> DataFrame:
        return read(spark, sf_dir, table).selectExpr(
            f"concat('{relation}:', {src}, ':', {dst}) as edge_id", f"{src} as src_id", f"{dst} as dst_id", f"'{relation}' as relation", "0.8D as confidence", "1.0D as weight", f"{long_ago} as valid_from", none, "cast(null as string) as belief_id"
        )

    manages = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    manages = manages.selectExpr(
        "concat('manages:S', l_suppkey, ':P', l_partkey) as edge_id",
        "concat('S', l_suppkey) as src_id",
        "concat('P', l_partkey) as dst_id",
        "'manages' as relation",
        "round(0.3D + (l_partkey % 70) / 100.0D, 2) as confidence",
        "round(1 + 0.05D * (n - 1), 2) as weight",
        "a as valid_from",
        "case when l_partkey % 5 = 0 and b > a then b end as invalid_at",
        "concat('m', lpad(cast(l_partkey as string), 10, '0')) as belief_id",
    )
    return (
        plain("nation", "concat('N', n_nationkey)", "concat('R', n_regionkey)", "part_of")
        .unionByName(plain("customer", "concat('C', c_custkey)", "concat('N', c_nationkey)", "belongs_to"))
        .unionByName(plain("supplier", "concat('S', s_suppkey)", "concat('N', s_nationkey)", "belongs_to"))
        .unionByName(manages)
    )


def _edge_sql(table: str, src: str, dst: str, relation: str) -> str:
    return f"""SELECT '{relation}:' || {src} || ':' || {dst} AS edge_id, {src} AS src_id, {dst} AS dst_id, '{relation}' AS relation, CAST(0.8 AS DOUBLE) AS confidence,
    CAST(1 AS DOUBLE) AS weight, TIMESTAMP '1990-01-01 00:00:00' AS valid_from, CAST(NULL AS TIMESTAMP) AS invalid_at, CAST(NULL AS VARCHAR) AS belief_id FROM {table}"""


EDGES = (
    "edges AS ("
    + " UNION ALL ".join(_edge_sql(*x) for x in (("nation", "('N' || n_nationkey)", "('R' || n_regionkey)", "part_of"), ("customer", "('C' || c_custkey)", "('N' || c_nationkey)", "belongs_to"), ("supplier", "('S' || s_suppkey)", "('N' || s_nationkey)", "belongs_to")))
    + """ UNION ALL SELECT 'manages:S' || l_suppkey || ':P' || l_partkey, 'S' || l_suppkey, 'P' || l_partkey, 'manages',
    round(CAST(0.3 AS DOUBLE) + CAST(l_partkey % 70 AS DOUBLE) / CAST(100 AS DOUBLE), 2), round(1 + CAST(0.05 AS DOUBLE) * (n - 1), 2), a,
    CASE WHEN l_partkey % 5 = 0 AND b > a THEN b END, 'm' || lpad(CAST(l_partkey AS VARCHAR), 10, '0')
  FROM (SELECT l_suppkey, l_partkey, count(*) AS n, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY ALL))"""
)


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("concat('P', p_partkey) as node_id", "'module' as kind", "concat('mod.', p_partkey) as qualified_name", "case when p_size = 1 then null else concat('src/', p_brand, '/', p_partkey, '.py') end as file_path", "'active' as status")


CODE_NODES = "code_nodes AS (SELECT 'P' || p_partkey AS node_id, 'module' AS kind, 'mod.' || p_partkey AS qualified_name, CASE WHEN p_size = 1 THEN NULL ELSE 'src/' || p_brand || '/' || p_partkey || '.py' END AS file_path, 'active' AS status FROM part)"


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    line = read(spark, sf_dir, "lineitem")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return (
        line.select("l_partkey", nxt.alias("next"))
        .where("next is not null and next <> l_partkey")
        .distinct()
        .selectExpr("concat('P', l_partkey) as src_id", "concat('P', next) as dst_id", "'imports' as relation", "(l_partkey + next) % 13 = 0 as invalid")
    )


CODE_EDGES = """code_edges AS (SELECT DISTINCT 'P' || l_partkey AS src_id, 'P' || nxt AS dst_id, 'imports' AS relation, (l_partkey + nxt) % 13 = 0 AS invalid FROM (
  SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL AND nxt <> l_partkey)"""


def doc_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").selectExpr(
        "concat('D', doc_id) as doc_id",
        "doc_id as num",
        "concat(source, '/doc', doc_id, '.md') as rel_path",
        "case when toxic = 1 then 'TX' when quality = 1 then 'T1' when quality = 0 then 'T3' else 'T2' end as tier",
        "case doc_id % 5 when 0 then 'plan' when 1 then 'brainstorm' else 'guide' end as doc_type",
        "case doc_id % 10 when 0 then 'superseded' when 1 then 'archived' when 2 then 'fulfilled' else 'active' end as lifecycle",
        "case when doc_id % 10 = 0 then concat('D', doc_id + 1) end as superseded_by",
        "cast(doc_id % 120 as int) as age_days",
        "text",
        "n_chars",
    )


REGISTRY = """registry AS (SELECT 'D' || d.doc_id AS doc_id, d.doc_id AS num, source || '/doc' || d.doc_id || '.md' AS rel_path,
  CASE WHEN toxic = 1 THEN 'TX' WHEN quality = 1 THEN 'T1' WHEN quality = 0 THEN 'T3' ELSE 'T2' END AS tier,
  CASE d.doc_id % 5 WHEN 0 THEN 'plan' WHEN 1 THEN 'brainstorm' ELSE 'guide' END AS doc_type,
  CASE d.doc_id % 10 WHEN 0 THEN 'superseded' WHEN 1 THEN 'archived' WHEN 2 THEN 'fulfilled' ELSE 'active' END AS lifecycle,
  CASE WHEN d.doc_id % 10 = 0 THEN 'D' || (d.doc_id + 1) END AS superseded_by, CAST(d.doc_id % 120 AS INT) AS age_days, text, n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def doc_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.array_distinct(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"))).alias("ref_value"))


REFS = """refs AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref_value FROM pages)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.selectExpr(
        "event_id as seq",
        "concat('r', user_id % 3) as repo_id",
        "case when event_type = 'purchase' then null else concat('f', k) end as path",
        "case event_type when 'click' then 'modified' when 'view' then 'added' when 'signup' then 'renamed' when 'purchase' then 'git' else 'removed' end as change",
        "case when event_type = 'signup' then concat('f', k + 1) end as old_path",
        "ts as detected_at",
    )


JOURNAL = """journal AS (SELECT event_id AS seq, 'r' || (user_id % 3) AS repo_id, CASE WHEN event_type = 'purchase' THEN NULL ELSE 'f' || k END AS path,
  CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'added' WHEN 'signup' THEN 'renamed' WHEN 'purchase' THEN 'git' ELSE 'removed' END AS change,
  CASE WHEN event_type = 'signup' THEN 'f' || (k + 1) END AS old_path, ts AS detected_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories with texts."""
    return read(spark, sf_dir, "documents").selectExpr(
        "concat('D', doc_id) as memory_id",
        "doc_id",
        "text",
        "concat(source, '-', lang) as subject",
        "substring_index(text, ' ', 3) as naming",
        "case doc_id % 4 when 0 then 'belief' when 1 then 'event' when 2 then 'skill' else 'world_model' end as memory_type",
        "case when doc_id % 11 = 0 then 'archived' else 'active' end as status",
        "round(0.05D + (doc_id % 96) / 100.0D, 2) as confidence",
        f"cast('{NOW_E}' as timestamp_ntz) - make_dt_interval(cast(doc_id % 400 as int)) as updated_at",
        "cast(doc_id % 13 as int) as access_count",
        "case doc_id % 9 when 0 then 'T0' when 1 then 'T1' when 2 then 'T2' when 3 then 'T3' when 4 then 'TX' end as doc_tier",
        "source as repo_id",
    )


NOTES = f"""notes AS (SELECT 'D' || doc_id AS memory_id, doc_id, text, source || '-' || lang AS subject, array_to_string(string_split(text, ' ')[1:3], ' ') AS naming,
  CASE doc_id % 4 WHEN 0 THEN 'belief' WHEN 1 THEN 'event' WHEN 2 THEN 'skill' ELSE 'world_model' END AS memory_type,
  CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status, round(CAST(0.05 AS DOUBLE) + CAST(doc_id % 96 AS DOUBLE) / CAST(100 AS DOUBLE), 2) AS confidence,
  TIMESTAMP '{NOW_E}' - to_days(CAST(doc_id % 400 AS INT)) AS updated_at, CAST(doc_id % 13 AS INT) AS access_count,
  CASE doc_id % 9 WHEN 0 THEN 'T0' WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' WHEN 3 THEN 'T3' WHEN 4 THEN 'TX' END AS doc_tier, source AS repo_id FROM documents)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: a block of the author's keys, links, a code span, a symbol, an issue, a code block and task boxes."""
    p = read(spark, sf_dir, "pages")
    head = "case when page_id % 3 = 0 then concat('---\\nstatus: ', case when page_id % 2 = 0 then 'Archived' else '\"fulfilled\"' end, '\\ntype: Plan\\ntier: t', page_id % 5, '\\n---\\n') else '' end"
    links = "array_join(transform(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), h -> concat('[x](', h, '.md)')), ' ')"
    tail = "concat('\\n```\\n[no](hidden.md)\\n```\\n`src/p', page_id % 7, '.py` and src/p', page_id % 5, '.py::run (#', page_id % 50, ')\\n', repeat('- [x] done\\n', cast(page_id % 4 as int)), repeat('* [ ] open\\n', cast(page_id % 3 as int)), case when page_id % 5 = 0 then '-[X] tight\\n+ [x] plus\\n' else '' end)"
    return p.selectExpr("page_id", "concat('docs/p', page_id, '.md') as rel_path", f"concat({head}, {links}, {tail}) as text")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: the parts of their lines are the files, every tenth part is a document."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    files = line.selectExpr("l_orderkey", "case when l_partkey % 10 = 0 then concat('docs/p', l_partkey, '.md') else concat('src/p', l_partkey, '.py') end as path")
    files = files.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return o.join(files, o["o_orderkey"] == files["l_orderkey"]).selectExpr("cast(o_orderkey as string) as sha", "o_orderdate as ts", "concat('a', o_custkey % 9) as author", "concat('fix #', o_custkey) as subject", "files")


COMMITS = """touches AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS sha, o_orderdate AS ts, 'a' || (o_custkey % 9) AS author, 'fix #' || o_custkey AS subject,
  CASE WHEN l_partkey % 10 = 0 THEN 'docs/p' || l_partkey || '.md' ELSE 'src/p' || l_partkey || '.py' END AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
