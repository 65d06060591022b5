"""Queries of search, names and recall, each with its oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.functions import scoring as S
from memlake.functions import text as T
from memlake.functions import unicode as U
from memlake.operators import index as IX
from memlake.operators import phrases as PH
from memlake.operators import resolve as RS
from memlake.operators import search as SE
from memlake.operators import vector as V
from memlake.plans import docs as D
from memlake.plans.stems import porter_sql
from memlake.sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def NOW():
    return F.lit(X.NOW_E).cast("timestamp_ntz")


def fold_sql(text: str) -> str:
    return f"replace(strip_accents(lower({text})), 'ß', 'ss')"


def tokens_sql(text: str) -> str:
    """Search tokens of texts without characters of unspaced scripts."""
    return f"list_filter(regexp_extract_all({fold_sql(text)}, '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1 AND NOT list_contains([{_quoted(T.STOP_WORDS)}], w))"


def once_sql(array: str) -> str:
    return f"list_filter({array}, lambda x, i: list_position({array}, x) = i)"


# ---- texts
D_ = lambda s, d: X.read(s, d, "documents")
add("t01_fold", lambda s, d: D_(s, d).select("doc_id", F.md5(U.fold(F.col("text"))).alias("digest")), f"SELECT doc_id, md5({fold_sql('text')}) AS digest FROM documents")
add("t02_tokenize", lambda s, d: D_(s, d).select("doc_id", U.search_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest")),
    f"WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM t")
add("t05_stems", lambda s, d: D_(s, d).select(F.explode(U.search_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).select("word", U.stem(F.col("word")).alias("stem"), "n"),
    f"WITH v AS (SELECT unnest({tokens_sql('text')}) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM v GROUP BY word), {porter_sql('n')} SELECT word, stem, n FROM n JOIN stems USING (word)")
add("t07_normal_name", lambda s, d: D_(s, d).select("doc_id", F.md5(U.canonical_name(F.col("text"))).alias("digest")), "SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}+#]+', ' ', 'g'))) AS digest FROM documents")
_GROUPS = "[" + ", ".join(f"[{_quoted(g)}]" for g in T.SYNONYMS) + "]"


def _synonyms(s, d):
    words = s.createDataFrame([(w,) for g in T.SYNONYMS for w in g], "term string")
    found = D_(s, d).select(F.explode(U.search_tokens(F.col("text"))).alias("term")).union(words).distinct()
    return found.select("term", F.array_join(T.synonyms_of(F.col("term")), " ").alias("alike"))


add("t03_synonyms", _synonyms, f"""WITH g AS (SELECT gid, unnest(grp) AS term FROM (SELECT unnest(range({len(T.SYNONYMS)})) AS gid, unnest({_GROUPS}) AS grp)),
    w AS (SELECT term FROM g UNION SELECT unnest({tokens_sql('text')}) FROM documents)
    SELECT w.term, coalesce(string_agg(DISTINCT b.term, ' ' ORDER BY b.term), w.term) AS alike FROM w LEFT JOIN g a ON w.term = a.term LEFT JOIN g b USING (gid) GROUP BY w.term""")
_PROMPTS = lambda s, d: X.read(s, d, "conversations").where("role = 'user' and turn = 0")


def _match(s, d):
    t = F.array_distinct(U.search_tokens(F.col("text")))
    rows = X.read(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", t.alias("t"))
    stem = F.array_join(F.transform("t", lambda w: F.concat(F.lit('"'), w, F.lit('"*'))), " OR ")
    part = F.array_join(F.transform(F.filter("t", lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")
    return rows.select("conv_id", "turn", F.md5(stem).alias("stemmed"), F.md5(part).alias("substrings"))


add("t04_match", _match, f"""WITH t AS (SELECT conv_id, turn, {tokens_sql('text')} AS a FROM conversations WHERE role = 'user'), u AS (SELECT conv_id, turn, {once_sql('a')} AS t FROM t)
    SELECT conv_id, turn, md5(array_to_string(list_transform(t, lambda w: '"' || w || '"*'), ' OR ')) AS stemmed, md5(array_to_string(list_transform(list_filter(t, lambda w: length(w) >= 3), lambda w: '"' || w || '"'), ' OR ')) AS substrings FROM u""")


def _substrings(s, d):
    """Documents that hold the longest word of a conversation's first turn."""
    t = F.array_sort(U.search_tokens(F.col("text")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    words = _PROMPTS(s, d).select(F.get(t, 0).alias("word")).distinct()  # null for a turn without tokens
    texts = D_(s, d).select(F.col("doc_id").alias("text_id"), U.fold(F.col("text")).alias("text"))
    return PH.phrase_hits(texts, words.where("length(word) >= 3").select(F.col("word").alias("phrase"))).select(F.col("phrase").alias("word"), F.col("text_id").alias("doc_id"))


add("t06_substring_match", _substrings, f"""WITH w AS (SELECT DISTINCT list_sort(list_transform({tokens_sql('text')}, lambda x: {{'n': -length(x), 'w': x}}))[1].w AS word FROM conversations WHERE role = 'user' AND turn = 0), t AS (SELECT doc_id, {fold_sql('text')} AS folded FROM documents)
    SELECT word, doc_id FROM w, t WHERE length(word) >= 3 AND contains(folded, word)""")
add("k04_top_k_clamp", lambda s, d: X.mem(s, d).where("status = 'active'").withColumn("k", F.greatest(F.lit(0), F.col("event_id") * 0 + F.coalesce(F.substring("user_id", 2, 9).cast("long"), F.lit(0)) % 5 - 2)).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("confidence"), "memory_id"))).where("rn <= k").select("user_id", "memory_id"),
    f"WITH {X.MEM} SELECT user_id, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, memory_id) AS rn FROM mem WHERE status = 'active') WHERE rn <= greatest(0, coalesce(CAST(substr(user_id, 2) AS BIGINT), 0) % 5 - 2)")


# ---- search
def _asked(s, d):
    """First turns of the conversations whose number is divisible by 20, whole."""
    return _PROMPTS(s, d).where("conv_id % 20 = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))


def _searched(s, d):
    notes = X.notes(s, d)
    return SE.search(notes, SE.build_index(notes, "memory_id", F.col("text")), _asked(s, d), 8, NOW()).select("query_id", "memory_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


RECENCY = f"exp(-0.01 * greatest(0, epoch(TIMESTAMP '{X.NOW_E}' - updated_at) / 86400))"
TIER = "CASE doc_tier WHEN 'T0' THEN 1.2 WHEN 'T1' THEN 1.1 WHEN 'T3' THEN 0.8 ELSE 1.0 END"


def composed_sql(hits: str, k: int) -> str:
    """hits: query_id, memory_id, similarity."""
    return f"""f AS (SELECT h.query_id, h.similarity, n.*, max(access_count) OVER (PARTITION BY h.query_id) AS most FROM {hits} h JOIN notes n USING (memory_id) WHERE n.status = 'active'),
    c AS (SELECT query_id, memory_id, similarity, (0.65 * similarity + 0.20 * confidence + 0.10 * {RECENCY} + 0.05 * CASE WHEN most <= 0 THEN 0 ELSE ln(1 + access_count) / ln(1 + most) END) * {TIER} AS score FROM f WHERE doc_tier IS DISTINCT FROM 'TX')
    SELECT query_id, memory_id, round(similarity, 6) AS similarity, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, memory_id) AS rn FROM c) WHERE rn <= {k}"""


def _scanned(s, d):
    notes = X.notes(s, d)
    groups = SE.query_groups(_asked(s, d))
    index = SE.build_index(notes, "memory_id", F.col("text"), kinds=("grams",))  # a scan asks for no stems
    hits = SE.scan_hits(notes, index, groups, "memory_id")
    return SE.composed(notes, hits, "memory_id", 8, NOW()).select("query_id", "memory_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


#: a: tokens of a query; g: each token's synonyms; tx: the texts.
_ASKED_SQL = f"""a AS (SELECT conv_id AS query_id, {tokens_sql('text')} AS t0 FROM conversations WHERE role = 'user' AND turn = 0 AND conv_id % 20 = 0),
    q AS (SELECT query_id, {once_sql('t0')} AS t FROM a), sy AS (SELECT gid, unnest(grp) AS term FROM (SELECT unnest(range({len(T.SYNONYMS)})) AS gid, unnest({_GROUPS}) AS grp)),
    qt AS (SELECT query_id, unnest(t) AS token FROM q), g AS (SELECT DISTINCT query_id, token, coalesce(b.term, token) AS word FROM qt LEFT JOIN sy a2 ON token = a2.term LEFT JOIN sy b USING (gid)),
    tx AS (SELECT memory_id, updated_at, {fold_sql('text')} AS folded, {tokens_sql('text')} AS terms FROM notes WHERE status = 'active')"""
_SCAN_SQL = """held AS (SELECT DISTINCT query_id, tx.memory_id, tx.updated_at, tx.terms FROM g JOIN tx ON contains(folded, word) WHERE query_id IN (SELECT query_id FROM {of})),
    newest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, memory_id) AS rn FROM held),
    sc AS (SELECT n.query_id, n.memory_id, count(DISTINCT g.token) / CAST(any_value(z.n) AS DOUBLE) AS similarity FROM newest n JOIN g ON g.query_id = n.query_id AND list_contains(n.terms, g.word) JOIN (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id) z ON z.query_id = n.query_id WHERE rn <= 1000 GROUP BY ALL)"""
add("q04_scan_search", _scanned, f"WITH {X.NOTES}, {_ASKED_SQL}, {_SCAN_SQL.format(of='q')}, {composed_sql('sc', 8)}")


def bm25_sql(found: str, asked: str, by: str, out: str, mean: str) -> str:
    """found: by, memory_id, tf, dl; asked: query_id, by; the 32 best of each query."""
    return f"""{out}_df AS (SELECT {by}, count(*) AS df FROM {found} GROUP BY ALL),
    {out}_s AS (SELECT query_id, memory_id, sum(greatest(1e-6, ln(((SELECT count(*) FROM tx) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / {mean}))) AS s FROM {asked} JOIN {found} USING ({by}) JOIN {out}_df USING ({by}) GROUP BY ALL),
    {out} AS (SELECT query_id, memory_id, 1 / (1 + exp(greatest(-50, least(50, -s)))) AS similarity FROM {out}_s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, memory_id) <= 32)"""


add("q03_lexical_search", _searched, f"""WITH {X.NOTES}, {_ASKED_SQL}, ow AS (SELECT memory_id, len(terms) AS dl, unnest(terms) AS word FROM tx), vw AS (SELECT word FROM ow UNION SELECT word FROM g), {porter_sql('vw')},
    po AS (SELECT stem AS term, memory_id, dl, count(*) AS tf FROM ow JOIN stems USING (word) GROUP BY ALL), qs AS (SELECT DISTINCT query_id, stem FROM g JOIN stems USING (word)), ds AS (SELECT DISTINCT stem FROM qs),
    fo AS (SELECT stem, memory_id, dl, sum(tf) AS tf FROM ds JOIN po ON starts_with(term, stem) GROUP BY ALL), {bm25_sql('fo', 'qs', 'stem', 'st', '(SELECT avg(len(terms)) FROM tx)')},
    few AS (SELECT query_id FROM q LEFT JOIN st USING (query_id) GROUP BY query_id HAVING count(st.memory_id) < 8), sw AS (SELECT DISTINCT query_id, word FROM g WHERE length(word) >= 3 AND query_id IN (SELECT query_id FROM few)), dw AS (SELECT DISTINCT word FROM sw),
    su AS (SELECT word, memory_id, CAST((length(folded) - length(replace(folded, word, ''))) / length(word) AS DOUBLE) AS tf, length(folded) - 2 AS dl FROM dw JOIN tx ON contains(folded, word)), {bm25_sql('su', 'sw', 'word', 'tr', '(SELECT avg(length(folded) - 2) FROM tx WHERE length(folded) >= 3)')},
    hm AS (SELECT query_id, memory_id, max(similarity) AS similarity FROM (SELECT * FROM st UNION ALL SELECT * FROM tr) GROUP BY ALL), no AS (SELECT DISTINCT query_id FROM qt WHERE query_id NOT IN (SELECT query_id FROM hm)), {_SCAN_SQL.format(of='no')},
    hits AS (SELECT * FROM hm UNION ALL SELECT * FROM sc), {composed_sql('hits', 8)}""")


# ---- the kept index
def _kept(s, d):
    """An index of four fifths of the documents; then the others are added and every seventh is replaced, at last every eleventh is removed."""
    docs = D_(s, d).select("doc_id", F.col("doc_id").alias("id"), "text")
    index = IX.KeptIndex(s).apply(docs.where("doc_id % 5 <> 0").select("id", "text"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat_ws(" ", "text", F.lit("postponed deliveries"), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    index.apply(docs.where("doc_id % 5 = 0 or doc_id % 7 = 0").select("id", changed.alias("text")))
    return index.apply(docs.where("doc_id % 11 = 0").select("id", F.lit(None).cast("string").alias("text")))


_KEPT_SQL = f"""d AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN concat_ws(' ', text, 'postponed deliveries', CAST(doc_id AS VARCHAR)) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0),
    ow AS (SELECT id, unnest({tokens_sql('text')}) AS word FROM d), vw AS (SELECT DISTINCT word FROM ow), {porter_sql('vw')}"""


def _live_terms(index):
    return index.totals("stems")


add("s17_kept_index", lambda s, d: _live_terms(_kept(s, d)), f"WITH {_KEPT_SQL} SELECT stem AS term, count(DISTINCT id) AS df, count(*) AS tf FROM ow JOIN stems USING (word) GROUP BY stem")
add("s17_merged_index", lambda s, d: _live_terms(_kept(s, d).merge()), f"WITH {_KEPT_SQL} SELECT stem AS term, count(DISTINCT id) AS df, count(*) AS tf FROM ow JOIN stems USING (word) GROUP BY stem")
add("t06_kept_grams", lambda s, d: _kept(s, d).totals("grams").where("not contains(term, '\0')").select("term", "df"),
    f"WITH {_KEPT_SQL}, x AS (SELECT DISTINCT id, substr(f, i, 3) AS term FROM (SELECT id, f, unnest(range(1, length(f) - 1)) AS i FROM (SELECT id, {fold_sql('text')} AS f FROM d))) SELECT term, count(*) AS df FROM x GROUP BY term")
add("j22_index_todo", lambda s, d: _kept(s, d).todo(D_(s, d).where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"))), "SELECT doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN 'add' ELSE 'remove' END AS todo FROM documents WHERE (doc_id % 4 <> 0) <> (doc_id % 11 <> 0)")


def _prefixed(s, d):
    """Terms of the dictionary that begin with the stem of a word of a first turn."""
    words = _PROMPTS(s, d).select(F.explode(U.search_tokens(F.col("text"))).alias("word")).distinct()
    index = IX.KeptIndex(s, kinds=("stems",)).apply(D_(s, d).select(F.col("doc_id").alias("id"), "text"))
    return index.prefix_totals("stems", words.select(U.stem(F.col("word")).alias("prefix")).distinct())


add("j24_prefix_terms", _prefixed, f"""WITH dw AS (SELECT doc_id, unnest({tokens_sql('text')}) AS word FROM documents), qw AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM conversations WHERE role = 'user' AND turn = 0), vw AS (SELECT word FROM dw UNION SELECT word FROM qw), {porter_sql('vw')},
    v AS (SELECT stem AS term, count(DISTINCT doc_id) AS df FROM dw JOIN stems USING (word) GROUP BY stem), p AS (SELECT DISTINCT stem AS prefix FROM qw JOIN stems USING (word))
    SELECT prefix, count(*) AS terms, CAST(sum(df) AS BIGINT) AS df, min(term) AS first FROM p JOIN v ON starts_with(term, prefix) GROUP BY prefix""")


def _by_vector(s, d):
    vectors = X.read(s, d, "embeddings")
    near = V.nearest_blocks(vectors, X.read(s, d, "embeddings").where("vec_id % 20 = 0"), SE.OVERSAMPLE * 8)
    pairs = near.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")), "query_id").join(vectors.select("vec_id", F.col("embedding").alias("b")), "vec_id")
    hits = pairs.select("query_id", F.concat(F.lit("D"), "vec_id").alias("id"), S.cosine(F.col("a"), F.col("b")).alias("similarity"))
    return SE.composed(X.notes(s, d), hits, "memory_id", 8, NOW()).select("query_id", "memory_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


add("q05_vector_composite", _by_vector, f"""WITH {X.NOTES}, v AS (SELECT a.vec_id AS query_id, b.vec_id, {D.COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
    h AS (SELECT query_id, 'D' || vec_id AS memory_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rn FROM v) WHERE rn <= 32), {composed_sql('h', 8)}""")
add("f07_fit_width", lambda s, d: X.read(s, d, "embeddings").select("vec_id", S.fit_width(F.col("embedding"), 1536).alias("w"), S.fit_width(F.col("embedding"), 16).alias("c")).select("vec_id", F.size("w").cast("long").alias("wide"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 4).alias("cut"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 4).alias("all")),
    "SELECT vec_id, CAST(1536 AS BIGINT) AS wide, round(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE))), 4) AS cut, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS all FROM embeddings".replace(" AS all", ' AS "all"'))
add("f16_exp_ln", lambda s, d: X.mem(s, d).select("memory_id", F.round(F.exp(-F.col("confidence")), 9).alias("e"), F.round(F.log(F.col("access_count") + 1), 9).alias("l")), f"WITH {X.MEM} SELECT memory_id, round(exp(-confidence), 9) AS e, round(ln(access_count + 1), 9) AS l FROM mem")

# ---- recall
STOP = _quoted(T.PROMPT_STOP_WORDS)


def _said(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9_\\-.]{{2,}}'), lambda w: NOT list_contains([{STOP}], w)))"


def _prompts_of(s, d):
    return _PROMPTS(s, d).select(F.col("conv_id").alias("session"), F.concat(F.lit("src"), F.col("conv_id") % 20).alias("repo_id"), "text")


def _recalled(s, d):
    shown = X.notes(s, d).where("doc_id % 5 = 0").select("memory_id").crossJoin(F.broadcast(_PROMPTS(s, d).where("conv_id % 40 = 0").select(F.col("conv_id").alias("session"))))
    return SE.prompt_recall(X.notes(s, d), _prompts_of(s, d), shown).select("session", "memory_id", "hits", "is_foreign")


_RECALL = f"""WITH {X.NOTES}, t AS (SELECT memory_id, unnest({_said("naming || ' ' || text")}) AS token FROM notes WHERE status = 'active'),
    n AS (SELECT memory_id, unnest({_said('naming')}) AS token FROM notes WHERE status = 'active'), r AS (SELECT token, count(*) <= 3 AS rare FROM t GROUP BY token),
    p AS (SELECT conv_id AS session, 'src' || (conv_id % 20) AS here, unnest({_said('text')}) AS token FROM conversations WHERE role = 'user' AND turn = 0 AND length(text) >= 12 AND NOT starts_with(ltrim(text), '/')),
    h AS (SELECT session, here, t.memory_id, count(*) AS every, count(*) FILTER (rare AND n.token IS NOT NULL AND length(p.token) >= 4) AS naming FROM p JOIN t USING (token) JOIN r USING (token) LEFT JOIN n ON n.memory_id = t.memory_id AND n.token = p.token GROUP BY ALL),
    f AS (SELECT h.*, confidence, CASE WHEN repo_id IS NULL OR repo_id = here OR lower(trim(subject)) = 'user' THEN 0 ELSE 1 END AS is_foreign FROM h JOIN notes USING (memory_id)),
    k AS (SELECT *, every + naming AS hits FROM f WHERE CASE WHEN is_foreign = 1 THEN every >= 2 AND naming > 0 ELSE every >= 2 OR naming > 0 END
          AND NOT (session % 40 = 0 AND CAST(substr(memory_id, 2) AS BIGINT) % 5 = 0))
    SELECT session, memory_id, hits, is_foreign FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY is_foreign, hits DESC, confidence DESC, memory_id) AS rn FROM k) WHERE rn <= 3"""
add("q26_prompt_recall", _recalled, _RECALL)
add("t32_prompt_tokens", lambda s, d: X.read(s, d, "conversations").select("conv_id", "turn", F.size(T.prompt_tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(T.prompt_tokens(F.col("text"))), " ")).alias("digest")),
    f"SELECT conv_id, turn, CAST(len({_said('text')}) AS BIGINT) AS n, md5(array_to_string(list_sort({_said('text')}), ' ')) AS digest FROM conversations")


def _shared_tokens(s, d):
    rows = X.read(s, d, "conversations").select("conv_id", "turn", T.prompt_tokens(F.col("text")).alias("t"))
    nxt = F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", "t", nxt.alias("u")).where("u is not null").select("conv_id", "turn", F.size(F.array_intersect("t", "u")).cast("long").alias("shared"))


add("u08_shared_tokens", _shared_tokens, f"WITH t AS (SELECT conv_id, turn, {_said('text')} AS t FROM conversations), u AS (SELECT *, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM t) SELECT conv_id, turn, CAST(len(list_intersect(t, u)) AS BIGINT) AS shared FROM u WHERE u IS NOT NULL")


# ---- names
def _neighbours(s, d):
    """Each part's name with that of the next of its brand."""
    p = X.read(s, d, "part").selectExpr("p_partkey as k", "p_brand as g", "p_name as name")
    return p.withColumn("other", F.lead("name").over(Window.partitionBy("g").orderBy("k"))).where("other is not null")


def _similar(s, d):
    a, b = F.col("name"), F.col("other")
    return _neighbours(s, d).select("k", F.round(U.jaro(a, b), 6).alias("jaro"), F.round(U.jaro_winkler(a, b), 6).alias("winkler"), U.prefix_score(a, b).alias("prefix"), F.round(U.name_similarity(a, b), 6).alias("similarity"))


def names_sql(a: str, b: str) -> str:
    same = f"CASE WHEN {a}[1:4] = {b}[1:4] THEN least(4, length({a}), length({b})) WHEN {a}[1:3] = {b}[1:3] THEN least(3, length({a}), length({b})) WHEN {a}[1:2] = {b}[1:2] THEN least(2, length({a}), length({b})) WHEN {a}[1:1] = {b}[1:1] THEN 1 ELSE 0 END"
    return f"""jaro_similarity({a}, {b}) AS j, jaro_similarity({a}, {b}) + ({same}) * CAST(0.1 AS DOUBLE) * (1 - jaro_similarity({a}, {b})) AS w,
      CAST(CASE WHEN length({a}) > 0 AND length({b}) > 0 AND (starts_with({a}, {b}) OR starts_with({b}, {a})) AND least(length({a}), length({b})) >= CAST(0.6 AS DOUBLE) * greatest(length({a}), length({b})) THEN 0.95 ELSE 0 END AS DOUBLE) AS p"""


add("f14_name_similarity", _similar, f"""WITH n AS (SELECT p_partkey AS k, p_name AS name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other FROM part),
    x AS (SELECT k, {names_sql('name', 'other')} FROM n WHERE other IS NOT NULL) SELECT k, round(j, 6) AS jaro, round(w, 6) AS winkler, p AS prefix, round(greatest(w, p), 6) AS similarity FROM x""")
_SEEDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in U.SEED_ALIASES.items()) + "}"


def _aliased(s, d):
    seeds = s.createDataFrame([(k,) for k in U.SEED_ALIASES], "name string")
    words = D_(s, d).select(F.explode(F.split(U.canonical_name(F.col("text")), " ")).alias("name")).union(seeds).distinct()
    return words.select("name", U.seed_alias(F.col("name")).alias("canonical"))


add("t08_seed_aliases", _aliased, f"WITH w AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}+#]+', ' ', 'g')), ' ')) AS name FROM documents UNION SELECT unnest(map_keys({_SEEDS}))) SELECT name, coalesce({_SEEDS}[name], name) AS canonical FROM w")


def _graph_nodes(s, d):
    """Nations and regions; every seventh nation is merged into the next, and customers are called by their market."""
    n = X.read(s, d, "nation").selectExpr("concat('N', n_nationkey) as node_id", "n_name as display_name", "'nation' as entity_type", "cast(n_nationkey % 4 as int) as mention_count", "case when n_nationkey % 7 = 3 then 'merged' else 'active' end as status", "case when n_nationkey % 7 = 3 then concat('N', n_nationkey + 1) end as merged_into")
    r = X.read(s, d, "region").selectExpr("concat('R', r_regionkey) as node_id", "r_name as display_name", "'region' as entity_type", "5 as mention_count", "'active' as status", "cast(null as string) as merged_into")
    return n.unionByName(r).withColumn("canonical", U.canonical_name(F.col("display_name")))


def _aliases(s, d):
    return X.read(s, d, "nation").selectExpr("concat('n ', n_nationkey) as alias", "concat('N', n_nationkey) as node_id")


def _names(s, d):
    """Names as they are, in lower case, without the last letter, with a word more, by alias, and unknown ones."""
    n = X.read(s, d, "nation").selectExpr("explode(array(n_name, lower(n_name), left(n_name, length(n_name) - 1), concat('the ', n_name), concat('N ', n_nationkey), concat('x', n_nationkey * 7919, 'q'))) as name", "'nation' as entity_type")
    r = X.read(s, d, "region").selectExpr("explode(array(concat(r_name, 'X'), lower(r_name))) as name", "'region' as entity_type")
    return n.union(r).union(s.createDataFrame([("user", None), ("  ", "nation"), ("K8s", "tool")], "name string, entity_type string")).distinct()


_CANON = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}+#]+', ' ', 'g'))"
_RESOLVE = f"""WITH nd AS (SELECT 'N' || n_nationkey AS node_id, {_CANON.format('n_name')} AS canonical, 'nation' AS entity_type, n_nationkey % 4 AS mention_count, CASE WHEN n_nationkey % 7 = 3 THEN 'merged' ELSE 'active' END AS status, CASE WHEN n_nationkey % 7 = 3 THEN 'N' || (n_nationkey + 1) END AS merged_into FROM nation
      UNION ALL SELECT 'R' || r_regionkey, {_CANON.format('r_name')}, 'region', 5, 'active', NULL FROM region),
    al AS (SELECT 'n ' || n_nationkey AS alias, 'N' || n_nationkey AS node_id FROM nation),
    nm AS (SELECT DISTINCT unnest([n_name, lower(n_name), n_name[1:length(n_name) - 1], 'the ' || n_name, 'N ' || n_nationkey, 'x' || (n_nationkey * 7919) || 'q']) AS name, 'nation' AS entity_type FROM nation UNION SELECT unnest([r_name || 'X', lower(r_name)]), 'region' FROM region UNION VALUES ('user', NULL), ('K8s', 'tool')),
    q AS (SELECT *, {_CANON.format('name')} AS norm FROM nm), c AS (SELECT *, coalesce({_SEEDS}[norm], norm) AS canonical FROM q),
    ex AS (SELECT c.name, c.entity_type, arg_max(nd.node_id, (CASE WHEN nd.entity_type = c.entity_type THEN 1 ELSE 0 END, mention_count, -1 * CAST(substr(nd.node_id, 2) AS INT))) AS node_id FROM c JOIN nd ON nd.canonical = c.canonical AND nd.status = 'active' WHERE c.canonical NOT IN ('user', 'skill') GROUP BY ALL),
    av AS (SELECT al.alias, coalesce(t.node_id, nd.node_id) AS node_id FROM al JOIN nd USING (node_id) LEFT JOIN nd t ON nd.status = 'merged' AND nd.merged_into = t.node_id WHERE coalesce(t.status, nd.status) = 'active'),
    kn AS (SELECT c.*, ex.node_id AS exact_id, coalesce(a.node_id, b.node_id) AS alias_id FROM c LEFT JOIN ex ON ex.name = c.name AND ex.entity_type IS NOT DISTINCT FROM c.entity_type LEFT JOIN av a ON a.alias = c.norm LEFT JOIN av b ON b.alias = c.canonical),
    op AS (SELECT DISTINCT canonical FROM kn WHERE exact_id IS NULL AND alias_id IS NULL AND canonical NOT IN ('user', 'skill')),
    pr AS (SELECT op.canonical, nd.node_id, {names_sql('op.canonical', 'nd.canonical')} FROM op, nd WHERE nd.status = 'active'),
    sm AS (SELECT canonical, list_sort(list(node_id)) AS alike FROM pr WHERE greatest(w, p) >= 0.90 GROUP BY canonical)
    SELECT name, entity_type, kn.canonical, coalesce(exact_id, alias_id, CASE WHEN len(alike) = 1 THEN alike[1] END) AS node_id,
      CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN alias_id IS NOT NULL THEN 'alias' WHEN len(alike) = 1 THEN 'similar' WHEN alike IS NOT NULL THEN 'possible' ELSE 'new' END AS how,
      CASE WHEN exact_id IS NULL AND alias_id IS NULL AND len(alike) > 1 THEN array_to_string(alike, ',') END AS possible FROM kn LEFT JOIN sm USING (canonical)"""
add("q11_entity_resolution", lambda s, d: RS.resolve(_names(s, d), _graph_nodes(s, d), _aliases(s, d)), _RESOLVE)
add("j28_merged_redirect", lambda s, d: RS.redirected(_graph_nodes(s, d)).select("node_id", "target"), "SELECT 'N' || a.n_nationkey AS node_id, coalesce('N' || b.n_nationkey, 'N' || a.n_nationkey) AS target FROM nation a LEFT JOIN nation b ON a.n_nationkey % 7 = 3 AND b.n_nationkey = a.n_nationkey + 1 UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey FROM region")
add("j29_similar_names", lambda s, d: RS.similar_nodes(X.read(s, d, "part").select(F.col("p_name").alias("canonical")).distinct(), X.read(s, d, "part").selectExpr("p_name as node_id", "p_name as canonical", "'active' as status").distinct()).select("canonical", "node_id", F.round("similarity", 6).alias("similarity")),
    f"WITH n AS (SELECT DISTINCT p_name FROM part), x AS (SELECT a.p_name AS canonical, b.p_name AS node_id, {names_sql('a.p_name', 'b.p_name')} FROM n a, n b WHERE len(list_intersect(list_transform(range(1, length(a.p_name) - 1), lambda i: substr(a.p_name, i, 3)), list_transform(range(1, length(b.p_name) - 1), lambda i: substr(b.p_name, i, 3)))) > 0) SELECT canonical, node_id, round(greatest(w, p), 6) AS similarity FROM x WHERE greatest(w, p) >= 0.90")
add("l21_new_aliases", lambda s, d: RS.new_aliases(_aliases(s, d).where("node_id <> 'N3'"), _aliases(s, d).unionByName(X.read(s, d, "nation").select(F.lower("n_name").alias("alias"), F.concat(F.lit("N"), "n_nationkey").alias("node_id")))), "SELECT 'n 3' AS alias, 'N3' AS node_id UNION ALL SELECT lower(n_name), 'N' || n_nationkey FROM nation")
add("j26_node_names", lambda s, d: RS.names_of(_graph_nodes(s, d), _aliases(s, d)), f"SELECT 'N' || n_nationkey AS node_id, {_CANON.format('n_name')} || ' n ' || n_nationkey AS names FROM nation UNION ALL SELECT 'R' || r_regionkey, {_CANON.format('r_name')} FROM region")
add("t14_leaked_markup", lambda s, d: X.read(s, d, "pages").select("page_id", R.has_marker(F.col("html"), [*R.LEAKED_MARKERS, "track(1"]).alias("leaked")), "SELECT page_id, " + " OR ".join(f"contains(lower(html), '{m}')" for m in [*R.LEAKED_MARKERS, "track(1"]) + " AS leaked FROM pages")
