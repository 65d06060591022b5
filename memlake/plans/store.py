"""Queries over the memories table, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import scoring as S
from memlake.operators import store as O
from memlake.sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}



def NOW():  # noqa: N802  a constant that needs a session
    return F.lit(X.NOW_E).cast("timestamp_ntz")


SQL_NOW = f"TIMESTAMP '{X.NOW_E}'"
# formulas of the oracle
DAYS = f"(epoch_us({SQL_NOW}) - epoch_us({{}})) / 86400000000.0"
RECENCY = f"exp(-0.01 * greatest(0.0, (epoch_us({SQL_NOW}) - epoch_us(updated_at)) / 86400000000.0))"
TIER = "CASE doc_tier WHEN 'T0' THEN 1.2 WHEN 'T1' THEN 1.1 WHEN 'T3' THEN 0.8 ELSE 1.0 END"
NEWEST = "newest AS (SELECT * FROM mem WHERE status = 'active' ORDER BY updated_at DESC, memory_id LIMIT 1000)"
SCORED = f"""scored AS (SELECT *, (0.65 * sim + 0.20 * confidence + 0.10 * {RECENCY} + 0.05 * CASE WHEN most <= 0 THEN 0 ELSE ln(1 + access_count) / ln(1 + most) END) * {TIER} AS score
  FROM (SELECT *, max(access_count) OVER () AS most, 0.0 AS sim FROM newest) WHERE doc_tier IS DISTINCT FROM 'TX')"""


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def simple(name: str, transform, sql: str) -> None:
    """A query over mem alone; sql is what follows the view."""
    add(name, lambda spark, d: transform(X.mem(spark, d)), f"WITH {X.MEM} {sql}" if not sql.startswith(",") else f"WITH {X.MEM}{sql}")


def seconds(c: str):
    return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1000000).cast("long").alias(c)


def sec(c: str) -> str:
    return f"CAST(floor(epoch({c})) AS BIGINT) AS {c}"


simple("s01_active_scan", lambda m: O.newest(m).select("memory_id", "memory_type", "subject", "confidence", seconds("updated_at")), f", {NEWEST} SELECT memory_id, memory_type, subject, confidence, {sec('updated_at')} FROM newest")
simple("s02_point_lookup", lambda m: m.where("memory_id = 'm0000000042' and memory_type is not null").select("memory_id", "memory_type", "status", "confidence"), "SELECT memory_id, memory_type, status, confidence FROM mem WHERE memory_id = 'm0000000042'")
simple("s03_typed_scan", lambda m: O.active(m, "skill").select("memory_id", "subject", "object", "confidence"), "SELECT memory_id, subject, object, confidence FROM mem WHERE status = 'active' AND memory_type = 'skill'")
simple(
    "s04_export_header",
    lambda m: m.groupBy("memory_type").agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"), F.max("memory_id").alias("last_id")),
    "SELECT memory_type, count(*) AS n, min(memory_id) AS first_id, max(memory_id) AS last_id FROM mem GROUP BY memory_type",
)


def _import(policy: str):
    def run(spark, d):
        m = X.mem(spark, d).select("memory_id", "event_id", "confidence", "updated_at")
        old = m.where("event_id % 2 = 0")
        new = m.where("event_id % 3 = 0").withColumn("confidence", F.lit(0.99)).withColumn("updated_at", F.expr("updated_at + make_dt_interval(cast(event_id % 5 as int) - 2)"))
        return O.merge_records(old, new, policy).select("memory_id", "confidence", seconds("updated_at"), "action")

    return run


for _policy, _take in (("skip", "FALSE"), ("force", "TRUE"), ("newest", "i.updated_at > e.updated_at")):
    add(
        f"s05_import_{_policy}",
        _import(_policy),
        f"""WITH {X.MEM}, e AS (SELECT memory_id, confidence, updated_at FROM mem WHERE event_id % 2 = 0),
        i AS (SELECT memory_id, CAST(0.99 AS DOUBLE) AS confidence, updated_at + to_days(CAST(event_id % 5 AS INT) - 2) AS updated_at FROM mem WHERE event_id % 3 = 0)
        SELECT coalesce(e.memory_id, i.memory_id) AS memory_id,
          CASE WHEN e.memory_id IS NULL OR (i.memory_id IS NOT NULL AND {_take}) THEN i.confidence ELSE e.confidence END AS confidence,
          CAST(floor(epoch(CASE WHEN e.memory_id IS NULL OR (i.memory_id IS NOT NULL AND {_take}) THEN i.updated_at ELSE e.updated_at END)) AS BIGINT) AS updated_at,
          CASE WHEN e.memory_id IS NULL THEN 'inserted' WHEN i.memory_id IS NULL THEN 'untouched' WHEN {_take} THEN 'updated' ELSE 'skipped' END AS action
        FROM e FULL JOIN i ON e.memory_id = i.memory_id""",
    )


def _timestamps(m):
    text = F.when(F.col("event_id") % 4 == 0, F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 2, F.lit("soon"))
    return m.select("memory_id", F.coalesce(F.unix_timestamp(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))), F.lit(-1)).cast("long").alias("at"))


simple("s06_timestamp_coercion", _timestamps, "SELECT memory_id, CASE WHEN event_id % 4 < 2 THEN CAST(floor(epoch(date_trunc('second', created_at))) AS BIGINT) ELSE -1 END AS at FROM mem")
simple(
    "s15_budgeted_section",
    lambda m: O.within_budget(O.newest(m, 200).withColumn("line", F.concat_ws(" ", "subject", "relation", "object")), [F.desc("updated_at"), F.asc("memory_id")], F.octet_length("line") + 1, 1024).select("memory_id", "line", F.col("running").cast("long").alias("running")),
    """, n AS (SELECT * FROM mem WHERE status = 'active' ORDER BY updated_at DESC, memory_id LIMIT 200),
    b AS (SELECT memory_id, subject || ' ' || relation || ' ' || object AS line, sum(strlen(subject || ' ' || relation || ' ' || object) + 1) OVER (ORDER BY updated_at DESC, memory_id ROWS UNBOUNDED PRECEDING) AS running FROM n)
    SELECT memory_id, line, CAST(running AS BIGINT) AS running FROM b WHERE running <= 1024""",
)
simple(
    "s17_index_backfill",
    lambda m: O.active(m).select("memory_id").join(m.where("event_id % 5 <> 0").select("memory_id"), "memory_id", "left_anti"),
    "SELECT memory_id FROM mem WHERE status = 'active' AND memory_id NOT IN (SELECT memory_id FROM mem WHERE event_id % 5 <> 0)",
)


def _retention(m):
    from pyspark.sql import Window

    days = m.select(F.to_date("created_at").alias("day")).distinct()
    return days.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("day")))).select(F.col("day").cast("string").alias("day"), (F.col("rn") <= 7).alias("kept"))


simple("s18_backup_retention", _retention, "SELECT CAST(day AS VARCHAR) AS day, row_number() OVER (ORDER BY day DESC) <= 7 AS kept FROM (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM mem)")
simple("s22_active_count", lambda m: O.active(m).agg(F.count("*").alias("active")), "SELECT count(*) AS active FROM mem WHERE status = 'active'")

simple("p01_beliefs", lambda m: O.by_subject(m, relation="click", domain="d1").select("memory_id", "subject", "confidence"), "SELECT memory_id, subject, confidence FROM mem WHERE status = 'active' AND memory_type = 'belief' AND relation = 'click' AND domain = 'd1' ORDER BY confidence DESC, memory_id LIMIT 50")
simple("p02_timeline", lambda m: O.active(m, "event").orderBy(F.desc("created_at"), "memory_id").limit(50).select("memory_id", "subject", seconds("created_at")), f"SELECT memory_id, subject, {sec('created_at')} FROM mem WHERE status = 'active' AND memory_type = 'event' ORDER BY mem.created_at DESC, memory_id LIMIT 50")
simple("p03_events_by_entity", lambda m: O.active(m, "event").where("subject = 's3'").select("memory_id", "object"), "SELECT memory_id, object FROM mem WHERE status = 'active' AND memory_type = 'event' AND subject = 's3'")
simple("p04_skills", lambda m: O.active(m, "skill").where("domain = 'd2'").orderBy(F.desc("confidence"), "memory_id").limit(50).select("memory_id", "confidence"), "SELECT memory_id, confidence FROM mem WHERE status = 'active' AND memory_type = 'skill' AND domain = 'd2' ORDER BY confidence DESC, memory_id LIMIT 50")
simple("p05_world_state", lambda m: O.active(m, "world_model").where("subject = 's5'").orderBy(F.desc("updated_at"), "memory_id").limit(100).select("memory_id", seconds("updated_at")), f"SELECT memory_id, {sec('updated_at')} FROM mem WHERE status = 'active' AND memory_type = 'world_model' AND subject = 's5' ORDER BY mem.updated_at DESC, memory_id LIMIT 100")
simple(
    "p06_world_identity",
    lambda m: O.active(m, "world_model").groupBy(F.coalesce("user_id", F.lit("")).alias("tenant"), "subject", "object").agg(F.min("memory_id").alias("memory_id"), F.count("*").alias("n")),
    "SELECT coalesce(user_id, '') AS tenant, subject, object, min(memory_id) AS memory_id, count(*) AS n FROM mem WHERE status = 'active' AND memory_type = 'world_model' GROUP BY ALL",
)
simple("p08_vector_prefilter", lambda m: O.active(m, user_id="u7").where(F.col("memory_type").isin("belief", "skill")).select("memory_id"), "SELECT memory_id FROM mem WHERE status = 'active' AND user_id = 'u7' AND memory_type IN ('belief', 'skill')")
simple(
    "p09_scan_text",
    lambda m: O.active(m).where(F.lower(F.concat_ws(" ", "subject", "relation", "object")).rlike("s1 |o42$")).select("memory_id"),
    "SELECT memory_id FROM mem WHERE status = 'active' AND (lower(subject || ' ' || relation || ' ' || object) LIKE '%s1 %' OR lower(subject || ' ' || relation || ' ' || object) LIKE '%o42')",
)
simple(
    "p12_tenant_modes",
    lambda m: O.active(m).agg(F.count("*").alias("all_tenants"), F.count_if(F.coalesce("user_id", F.lit("")) == "").alias("no_tenant"), F.count_if(F.col("user_id") == "u3").alias("one_tenant")),
    "SELECT count(*) AS all_tenants, count(*) FILTER (coalesce(user_id, '') = '') AS no_tenant, count(*) FILTER (user_id = 'u3') AS one_tenant FROM mem WHERE status = 'active'",
)
simple("p13_tier_exclusion", lambda m: O.active(m).where(~F.col("doc_tier").eqNullSafe("TX")).groupBy("doc_tier").agg(F.count("*").alias("n")), "SELECT doc_tier, count(*) AS n FROM mem WHERE status = 'active' AND doc_tier IS DISTINCT FROM 'TX' GROUP BY doc_tier")
simple("p14_locality", lambda m: O.active(m).groupBy(O.is_local("r1").alias("local")).agg(F.count("*").alias("n")), "SELECT repo_id IS NULL OR repo_id = 'r1' OR lower(trim(subject)) = 'user' AS local, count(*) AS n FROM mem WHERE status = 'active' GROUP BY ALL")
simple("p15_recent_window", lambda m: O.active(m).where(S.days_between(NOW(), F.col("created_at")).between(0, 7)).groupBy("memory_type").agg(F.count("*").alias("n")), f"SELECT memory_type, count(*) AS n FROM mem WHERE status = 'active' AND {DAYS.format('created_at')} BETWEEN 0 AND 7 GROUP BY ALL")
simple("p16_low_confidence", lambda m: O.active(m, "belief").where("confidence < 0.25").orderBy("confidence", "updated_at", "memory_id").limit(100).select("memory_id", "confidence"), "SELECT memory_id, confidence FROM mem WHERE status = 'active' AND memory_type = 'belief' AND confidence < 0.25 ORDER BY confidence, updated_at, memory_id LIMIT 100")
simple("p17_superseded_report", lambda m: m.where("status = 'superseded'").orderBy(F.desc("updated_at"), "memory_id").limit(100).select("memory_id", "subject", "relation"), "SELECT memory_id, subject, relation FROM mem WHERE status = 'superseded' ORDER BY updated_at DESC, memory_id LIMIT 100")
simple("p19_search_text", lambda m: O.active(m).select("memory_id", F.lower(F.concat_ws(" ", "subject", "relation", "object", "domain", "doc_tier")).alias("search_text")), "SELECT memory_id, lower(concat_ws(' ', subject, relation, object, domain, doc_tier)) AS search_text FROM mem WHERE status = 'active'")

TRANSITIONS = {"created": ("in_progress", "completed", "failed", "abandoned"), "in_progress": ("completed", "failed", "abandoned")}
_STATES = "array('created','in_progress','completed','failed','abandoned')"


def _machine(m):
    allowed = F.lit(False)
    for a, into in TRANSITIONS.items():
        allowed = allowed | ((F.col("a") == a) & F.col("b").isin(*into))
    rows = m.selectExpr("memory_id", f"{_STATES}[cast(event_id % 5 as int)] as a", f"{_STATES}[cast((event_id div 5) % 5 as int)] as b")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("allowed", allowed)


simple(
    "p23_event_transitions",
    _machine,
    """, s AS (SELECT ['created','in_progress','completed','failed','abandoned'][1 + event_id % 5] AS a, ['created','in_progress','completed','failed','abandoned'][1 + (event_id // 5) % 5] AS b FROM mem)
    SELECT a, b, count(*) AS n, (a = 'created' AND b <> 'created') OR (a = 'in_progress' AND b IN ('completed', 'failed', 'abandoned')) AS allowed FROM s GROUP BY a, b""",
)

simple("a01_stats", lambda m: O.active(m).groupBy("memory_type").agg(F.count("*").alias("n")), "SELECT memory_type, count(*) AS n FROM mem WHERE status = 'active' GROUP BY ALL")
simple("a02_by_type_status", lambda m: m.groupBy("memory_type", "status").agg(F.count("*").alias("n")), "SELECT memory_type, status, count(*) AS n FROM mem GROUP BY ALL")
simple(
    "a03_leaderboard",
    lambda m: O.leaderboard(m, F.col("event_id") % 7, F.col("event_id") % 13, 20),
    """, p AS (SELECT * FROM mem WHERE status = 'active' AND memory_type = 'skill' ORDER BY confidence DESC, memory_id LIMIT 200)
    SELECT memory_id, confidence, event_id % 13 AS attempts, CASE WHEN event_id % 13 > 0 THEN (event_id % 7) / (event_id % 13) ELSE 0.0 END AS success_rate FROM p ORDER BY success_rate DESC, attempts DESC, confidence DESC, memory_id LIMIT 20""",
)
simple("a05_usage_peak", lambda m: O.active(m).agg(F.max("access_count").cast("long").alias("most")), "SELECT CAST(max(access_count) AS BIGINT) AS most FROM mem WHERE status = 'active'")
simple(
    "a08_patterns",
    lambda m: O.patterns(m, NOW()),
    f""", r AS (SELECT *, lower(subject) AS s, lower(relation) AS r, lower(object) AS o FROM mem WHERE status = 'active' AND {DAYS.format("created_at")} BETWEEN 0 AND 7)
    SELECT 'recurring_subject' AS pattern, s AS pattern_key, arg_min(subject, (created_at, memory_id)) AS subject, count(*) AS n FROM r WHERE memory_type = 'belief' GROUP BY s HAVING count(*) >= 3
    UNION ALL SELECT 'repeated_event', s || '|' || r || '|' || o, arg_min(subject, (created_at, memory_id)), count(*) FROM r WHERE memory_type = 'event' GROUP BY s, r, o HAVING count(*) >= 3
    UNION ALL SELECT 'skill_generalisation', s || '|' || o, arg_min(subject, (created_at, memory_id)), count(*) FROM r WHERE memory_type = 'skill' GROUP BY s, o HAVING count(*) >= 3""",
)
QUERIES["q27_reflection"], ORACLES["q27_reflection"] = QUERIES["a08_patterns"], ORACLES["a08_patterns"]
simple("a13_tenants", lambda m: m.select("user_id").where("user_id is not null").distinct(), "SELECT DISTINCT user_id FROM mem WHERE user_id IS NOT NULL")
simple(
    "a18_best_similarity",
    lambda m: m.selectExpr("memory_id", "confidence as sim").unionByName(m.where("event_id % 2 = 0").selectExpr("memory_id", "round((event_id % 10) / 10.0D, 1) as sim")).groupBy("memory_id").agg(F.max("sim").alias("sim")),
    "SELECT memory_id, max(sim) AS sim FROM (SELECT memory_id, confidence AS sim FROM mem UNION ALL SELECT memory_id, round((event_id % 10) / 10.0, 1) FROM mem WHERE event_id % 2 = 0) GROUP BY memory_id",
)



def _feed():
    return ["memory_id", "memory_type", F.round("score", 6).alias("score")]


simple("q01_recent_feed", lambda m: O.recent_feed(m, NOW(), 12).select(*_feed()), f", {NEWEST}, {SCORED} SELECT memory_id, memory_type, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, updated_at DESC, memory_id LIMIT 12")
simple("k11_feed_by_type", lambda m: O.ranked_by_type(O.recent_feed(m, NOW(), 40)).select(*_feed(), F.col("type_rank").cast("long").alias("type_rank")), f""", {NEWEST}, {SCORED}, f AS (SELECT * FROM scored ORDER BY score DESC, updated_at DESC, memory_id LIMIT 40)
    SELECT memory_id, memory_type, round(score, 6) AS score, row_number() OVER (PARTITION BY memory_type ORDER BY f.score DESC, updated_at DESC, memory_id) AS type_rank FROM f""")
_context = f""", {NEWEST}, {SCORED}, l AS (SELECT *, CASE WHEN repo_id IS NULL OR repo_id = 'r2' OR lower(trim(subject)) = 'user' THEN 0 ELSE 1 END AS is_foreign FROM scored),
    p AS (SELECT *, row_number() OVER (PARTITION BY is_foreign ORDER BY score DESC, memory_id) AS place FROM l)
    SELECT memory_id, is_foreign, round(score, 6) AS score FROM p WHERE is_foreign = 0 OR place <= 3 ORDER BY is_foreign, p.score DESC, memory_id LIMIT 12"""
simple("q02_session_context", lambda m: O.context_rows(m, NOW(), "r2").select("memory_id", "is_foreign", F.round("score", 6).alias("score")), _context)
simple(
    "q31_store_health",
    lambda m: O.active(m).agg(F.count("*").alias("active"), F.count_if(O.is_local("r1")).alias("local"), F.count_if(~O.is_local("r1")).alias("foreign_rows")),
    "SELECT count(*) AS active, count(*) FILTER (repo_id IS NULL OR repo_id = 'r1' OR lower(trim(subject)) = 'user') AS local, count(*) FILTER (NOT (repo_id IS NULL OR repo_id = 'r1' OR lower(trim(subject)) = 'user')) AS foreign_rows FROM mem WHERE status = 'active'",
)

_l10 = f"""SELECT memory_id, round(nc, 6) AS new_confidence, CASE WHEN nc < 0.15 AND memory_type <> 'skill' THEN 'archived' ELSE status END AS new_status
    FROM (SELECT *, greatest(0.0, least(1.0, confidence * exp(-decay_rate * {DAYS.format("updated_at")}))) AS nc FROM mem WHERE status = 'active' AND decay_rate > 0 AND {DAYS.format("updated_at")} > 0)"""
simple("l10_daily_decay", lambda m: O.decay_pass(m, NOW()).select("memory_id", F.round("new_confidence", 6).alias("new_confidence"), "new_status"), _l10)
simple("l10_decay_counts", lambda m: O.decay_pass(m, NOW()).agg(F.count("*").alias("decayed"), F.count_if(F.col("new_status") == "archived").alias("archived")), f"SELECT count(*) AS decayed, count(*) FILTER (new_status = 'archived') AS archived FROM ({_l10})")
_late = f"TIMESTAMP '2024-05-15 00:00:00'"
simple(
    "l11_prune",
    lambda m: O.prune_pass(m, F.lit("2024-05-15 00:00:00").cast("timestamp_ntz")).select("memory_id", "memory_type", "new_status"),
    f"""SELECT * FROM (SELECT memory_id, memory_type, CASE WHEN memory_type = 'event' AND (epoch_us({_late}) - epoch_us(created_at)) / 86400000000.0 > 90 AND unlinked THEN 'archived'
      WHEN memory_type = 'skill' AND (epoch_us({_late}) - epoch_us(coalesce(last_used, created_at))) / 86400000000.0 > 60 THEN 'deprecated' END AS new_status FROM mem WHERE status = 'active') WHERE new_status IS NOT NULL""",
)
simple(
    "f01_f05_scores",
    lambda m: m.select(
        "memory_id",
        F.round(S.recency(NOW(), F.col("updated_at")), 6).alias("recency"),
        F.round(S.usage(F.col("access_count"), F.lit(12)), 6).alias("used"),
        S.tier_factor(F.col("doc_tier")).alias("tier"),
        F.round(S.bm25_similarity(-F.col("confidence") * 4), 6).alias("sim"),
        F.round(S.decayed(F.col("confidence"), F.col("decay_rate"), S.days_between(NOW(), F.col("created_at"))), 6).alias("decayed"),
        F.round(S.bayes_update(F.col("confidence"), F.lit(2.0), F.col("decay_rate"), F.lit(3.0), F.lit(0.7), F.lit(0.9)), 6).alias("bayes"),
        F.round(S.skill_outcome(F.col("confidence"), F.col("event_id") % 2 == 0), 6).alias("skill"),
        S.approx_tokens(F.concat("subject", "object")).alias("tokens"),
    ),
    f"""SELECT memory_id, round({RECENCY}, 6) AS recency, round(ln(1 + access_count) / ln(13), 6) AS used, CAST({TIER} AS DOUBLE) AS tier, round(1 / (1 + exp(greatest(-50, least(50, -confidence * 4)))), 6) AS sim,
    round(CASE WHEN decay_rate = 0 THEN confidence ELSE greatest(0, least(1, confidence * exp(-decay_rate * {DAYS.format("created_at")}))) END, 6) AS decayed,
    round(greatest(0, least(1, (confidence * 2 * exp(-decay_rate * 3) + CAST(0.7 AS DOUBLE) * 0.9) / 3)), 6) AS bayes,
    round(CASE WHEN event_id % 2 = 0 THEN least(1, confidence + 0.1) ELSE confidence * 0.85 END, 6) AS skill, CAST((length(subject || object) + 3) // 4 AS BIGINT) AS tokens FROM mem""",
)
simple("f11_source_weights", lambda m: m.select("memory_id", S.source_weight(F.element_at(F.array(*[F.lit(x) for x in [*S.SOURCE_WEIGHTS, "other"]]), (F.col("event_id") % 7 + 1).cast("int"))).alias("w")), "SELECT memory_id, CAST([1.0, 0.7, 0.85, 0.75, 0.5, 0.5, 0.5][1 + event_id % 7] AS DOUBLE) AS w FROM mem")
_reinforced = "mem.memory_type = 'belief'"
simple(
    "l02_reinforce",
    lambda m: O.fold_reinforcements(m).select("user_id", "subject", "relation", "object", F.col("times").cast("long").alias("times"), F.round("confidence", 6).alias("confidence"), "prior_weight"),
    f""", b AS (SELECT user_id, subject, relation, object, confidence, decay_rate, epoch_us(created_at) AS at, row_number() OVER (PARTITION BY user_id, subject, relation, object ORDER BY created_at, memory_id) AS i,
        lag(epoch_us(created_at)) OVER (PARTITION BY user_id, subject, relation, object ORDER BY created_at, memory_id) AS prev FROM mem WHERE {_reinforced}),
    k AS (SELECT *, dense_rank() OVER (ORDER BY user_id, subject, relation, object) AS g FROM b),
    w AS (WITH RECURSIVE f AS (SELECT g, i, confidence AS c FROM k WHERE i = 1 UNION ALL
      SELECT k.g, k.i, greatest(0, least(1, (f.c * f.i * exp(-k.decay_rate * (k.at - k.prev) / 86400000000.0) + CAST(0.7 AS DOUBLE) * k.confidence) / (f.i + 1))) FROM f JOIN k ON k.g = f.g AND k.i = f.i + 1) SELECT * FROM f)
    SELECT user_id, subject, relation, object, max(k.i) AS times, round(arg_max(w.c, w.i), 6) AS confidence, CAST(max(k.i) AS DOUBLE) AS prior_weight FROM k JOIN w ON k.g = w.g AND k.i = w.i GROUP BY ALL""",
)
simple(
    "l03_supersede",
    lambda m: _chain(m),
    """SELECT memory_id, lead(memory_id) OVER p AS superseded_by, lag(memory_id) OVER p AS supersedes, CASE WHEN lead(memory_id) OVER p IS NULL THEN 'active' ELSE 'superseded' END AS new_status
    FROM mem WHERE memory_type = 'belief' WINDOW p AS (PARTITION BY coalesce(user_id, ''), subject, relation ORDER BY created_at, memory_id)""",
)


def _chain(m):
    from pyspark.sql import Window

    w = Window.partitionBy(F.coalesce("user_id", F.lit("")), "subject", "relation").orderBy("created_at", "memory_id")
    after = F.lead("memory_id").over(w)
    return m.where("memory_type = 'belief'").select("memory_id", after.alias("superseded_by"), F.lag("memory_id").over(w).alias("supersedes"), F.when(after.isNull(), "active").otherwise("superseded").alias("new_status"))


simple(
    "l06_world_upsert",
    lambda m: m.where("memory_type = 'world_model'").groupBy(F.coalesce("user_id", F.lit("")).alias("tenant"), "subject").agg(F.max_by("object", F.struct("created_at", "memory_id")).alias("object"), F.count("*").alias("writes"), F.count_distinct("object").alias("versions")),
    "SELECT coalesce(user_id, '') AS tenant, subject, arg_max(object, (created_at, memory_id)) AS object, count(*) AS writes, count(DISTINCT object) AS versions FROM mem WHERE memory_type = 'world_model' GROUP BY ALL",
)
simple(
    "l05_skill_outcomes",
    lambda m: _skills(m),
    """, s AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY created_at, memory_id) AS i FROM mem WHERE memory_type = 'skill'),
    f AS (WITH RECURSIVE r AS (SELECT subject, i, CAST(0.5 AS DOUBLE) AS c FROM s WHERE i = 1 UNION ALL
      SELECT s.subject, s.i, CASE WHEN s.event_id % 3 > 0 THEN least(1, r.c + 0.1) ELSE r.c * 0.85 END FROM r JOIN s ON s.subject = r.subject AND s.i = r.i + 1) SELECT * FROM r)
    SELECT subject, round(arg_max(c, i), 6) AS confidence, max(i) AS outcomes, arg_max(c, i) <= 0.15 AS deprecated FROM f GROUP BY subject""",
)


def _skills(m):
    rows = m.where("memory_type = 'skill'").select("subject", "created_at", "memory_id", "event_id")
    done = O.fold_outcomes(rows, "subject", ["created_at", "memory_id"], F.col("event_id") % 3 > 0)
    return done.select("subject", F.round("confidence", 6).alias("confidence"), "outcomes", (F.col("confidence") <= S.SKILL_FLOOR).alias("deprecated"))


simple(
    "l09_update_forget",
    lambda m: m.select("memory_id", F.when(F.col("event_id") % 10 == 0, "deprecated").when(F.col("event_id") % 10 == 1, "archived").otherwise(F.col("status")).alias("status"), S.clamp01(F.when(F.col("event_id") % 10 == 2, F.col("confidence") + 0.5).otherwise(F.col("confidence"))).alias("confidence")),
    "SELECT memory_id, CASE event_id % 10 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'archived' ELSE status END AS status, greatest(0, least(1, CASE WHEN event_id % 10 = 2 THEN confidence + 0.5 ELSE confidence END)) AS confidence FROM mem",
)
simple(
    "j01_hydrate",
    lambda m: m.where("event_id % 50 = 0").select("memory_id", (F.col("event_id") / 50).cast("long").alias("hit_pos")).join(O.active(m), "memory_id").where("doc_tier is null or doc_tier <> 'TX'").select("memory_id", "hit_pos", "memory_type"),
    "SELECT memory_id, CAST(event_id / 50 AS BIGINT) AS hit_pos, memory_type FROM mem WHERE event_id % 50 = 0 AND status = 'active' AND doc_tier IS DISTINCT FROM 'TX'",
)
simple(
    "j20_identity_probe",
    lambda m: m.where("event_id % 2 = 1 and memory_type = 'belief'").select("memory_id", "subject", "relation", "object").join(O.active(m.where("event_id % 2 = 0"), "belief").select("subject", "relation", "object"), ["subject", "relation", "object"], "left_semi").select("memory_id"),
    "SELECT memory_id FROM mem a WHERE event_id % 2 = 1 AND memory_type = 'belief' AND EXISTS (SELECT 1 FROM mem b WHERE b.event_id % 2 = 0 AND b.status = 'active' AND b.memory_type = 'belief' AND a.subject = b.subject AND a.relation = b.relation AND a.object = b.object)",
)


simple("l26_session_partition", lambda m: m.select("memory_id", F.concat(F.lit("session:"), F.coalesce("user_id", F.lit(""))).alias("tenant")), "SELECT memory_id, 'session:' || coalesce(user_id, '') AS tenant FROM mem")
simple("k05_keyset_page", lambda m: m.where("memory_id > 'm0000000100'").orderBy("memory_id").limit(500).select("memory_id"), "SELECT memory_id FROM mem WHERE memory_id > 'm0000000100' ORDER BY memory_id LIMIT 500")
simple(
    "w05_running_tokens",
    lambda m: O.within_budget(O.newest(m, 300), [F.desc("updated_at"), F.asc("memory_id")], S.approx_tokens(F.concat_ws(" ", "subject", "relation", "object")), 900).select("memory_id", F.col("running").cast("long").alias("running")),
    """, n AS (SELECT * FROM mem WHERE status = 'active' ORDER BY updated_at DESC, memory_id LIMIT 300)
    SELECT memory_id, CAST(running AS BIGINT) AS running FROM (SELECT memory_id, sum((length(subject || ' ' || relation || ' ' || object) + 3) // 4) OVER (ORDER BY updated_at DESC, memory_id ROWS UNBOUNDED PRECEDING) AS running FROM n) WHERE running <= 900""",
)
simple(
    "w06_latest_per_key",
    lambda m: m.groupBy("subject", "relation").agg(F.max_by("memory_id", F.struct("created_at", "memory_id")).alias("memory_id")),
    "SELECT subject, relation, arg_max(memory_id, (created_at, memory_id)) AS memory_id FROM mem GROUP BY ALL",
)
simple(
    "x02_bump_access",
    lambda m: m.where("event_id % 3 = 0").select("memory_id", (F.coalesce("access_count", F.lit(0)) + 1).cast("long").alias("access_count"), seconds("updated_at")),
    f"SELECT memory_id, CAST(coalesce(access_count, 0) + 1 AS BIGINT) AS access_count, {sec('updated_at')} FROM mem WHERE event_id % 3 = 0",
)
