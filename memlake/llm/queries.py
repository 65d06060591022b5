"""Registered queries of this subpackage: ``QUERIES`` and ``ORACLES`` by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .clustering import cluster_vectors
from .embedding_dedup import embedding_near_duplicates
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .language_id import address_suffix, fit_text_model, identify, page_declared, page_text
from .lm_score import score
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack_documents
from .sharding import hilbert_shards
from .suffix_dedup import repeated_passages
from .url_filter import filter_urls, host_of, parent_domains

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the contract wants the SHA-256 of every text, so all texts are hashed whole in the one scan."""
    return exact_dedup(table(spark, sf_dir, "documents"), fingerprint_all=True)


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWER}) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""

def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "fr": 2, "de": 2, "es": 1}
BUDGET_SHARE = 0.6
MAX_EPOCHS = 2
MIX_SEED = 17


def source_domain() -> Column:
    """Domain of a source: its number mod 4."""
    return F.concat(F.lit("d"), (F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 4).cast("string"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), source_domain(), DOMAIN_WEIGHTS, LANG_WEIGHTS, budget_share=BUDGET_SHARE, max_epochs=MAX_EPOCHS, seed=MIX_SEED)


def _weights(column: str, table: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in table.items()) + " ELSE 1 END"


def _fill(src: str, parent: str, name: str, budget: str, cap: str, weight: str) -> str:
    """SQL of one level of water-filling, by its definition: the level is the largest at which the shares fit the budget."""
    return f"""
SELECT *, CAST(CASE WHEN share IS NULL THEN {cap} ELSE greatest(0, least({cap}, floor(share * w))) END AS BIGINT) AS got FROM (
  SELECT *, min(CASE WHEN level < ratio THEN pos END) OVER (PARTITION BY {parent}) AS first_open,
         max(CASE WHEN pos = open_pos THEN level END) OVER (PARTITION BY {parent}) AS share FROM (
    SELECT *, min(CASE WHEN level < ratio THEN pos END) OVER (PARTITION BY {parent}) AS open_pos FROM (
      SELECT *, ({budget} - CAST(cap_before AS DOUBLE)) / CAST(weight_left AS DOUBLE) AS level FROM (
        SELECT *, row_number() OVER o AS pos,
               coalesce(sum({cap}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
               sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
        FROM (SELECT *, {weight} AS w, CAST({cap} AS DOUBLE) / ({weight}) AS ratio FROM {src})
        WINDOW o AS (PARTITION BY {parent} ORDER BY ratio, {name})))))"""


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce('d' || CAST(CAST(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS INT) % 4 AS VARCHAR), '(none)') AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         md5('{MIX_SEED}|' || doc_id) AS k
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
lng AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, 0 AS root, (SELECT floor(sum(tokens) * CAST({BUDGET_SHARE} AS DOUBLE)) FROM leaf) AS total FROM lng GROUP BY ALL),
dom_b AS ({_fill("dom", "root", "domain", "total", "cap", _weights("domain", DOMAIN_WEIGHTS))}),
lng_in AS (SELECT lng.*, dom_b.got AS budget FROM lng JOIN dom_b USING (domain)),
lng_b AS ({_fill("lng_in", "domain", "lang", "budget", "cap", _weights("lang", LANG_WEIGHTS))}),
leaf_in AS (SELECT leaf.*, lng_b.got AS budget FROM leaf JOIN lng_b USING (domain, lang)),
leaf_b AS ({_fill("leaf_in", "domain, lang", "source", "budget", "cap", "1")}),
run AS (SELECT d.*, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
plan AS (SELECT domain, lang, source, got, tokens, CASE WHEN tokens > 0 THEN CAST(floor(got / tokens) AS BIGINT) ELSE 0 END AS epochs FROM leaf_b)
SELECT doc_id, domain, lang, source, n_tokens, got AS leaf_budget,
       CAST(epochs + CASE WHEN before < got - epochs * tokens THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM run JOIN plan USING (domain, lang, source)
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"), shards=8)


#: The lists of the query: (name, hex digits of md5(list:key) that put a key on it).
LISTS = {"malware": "01", "spam": "0123", "adult": "4"}
FIRST_DAY = "2024-01-01"


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made from the hosts of the pages and their parents, by hashes of list and key.

    A key whose hash begins with one of the list's digits is added on a day of
    2024, removed 30 to 285 days later and, for every other key, added again
    60 days after that.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    keys = hosts.select(F.explode(parent_domains(F.col("host"))).alias("key")).distinct()
    names = F.array(*[F.struct(F.lit(k).alias("list"), F.lit(v).alias("digits")) for k, v in LISTS.items()])
    rows = keys.select("key", F.explode(names).alias("l")).select("key", "l.list", "l.digits")
    rows = rows.withColumn("h", F.md5(F.concat_ws(":", "list", "key"))).where(F.expr("contains(digits, substr(h, 1, 1))"))

    def number(at: int, digits: int) -> Column:
        return F.conv(F.substring("h", at, digits), 16, 10).cast("int")

    start = F.date_add(F.lit(FIRST_DAY).cast("date"), number(2, 4) % 300)
    end = F.date_add(start, 30 + number(6, 2))
    again = F.when(number(8, 1) % 2 == 0, F.date_add(end, 60))
    made = F.array(F.struct(F.lit("add").alias("action"), start.alias("day")), F.struct(F.lit("remove").alias("action"), end.alias("day")), F.struct(F.lit("add").alias("action"), again.alias("day")))
    return rows.select("list", "key", F.explode(made).alias("e")).select("list", "key", "e.action", "e.day").where("day is not null")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")))
    return filter_urls(captures, list_entries(pages)).withColumn("fetch_day", F.col("fetch_day").cast("string"))


OP9_SQL = rf"""
WITH cap AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
                    DATE '{FIRST_DAY}' + CAST((page_id * 37) % 365 AS INT) AS fetch_day FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS parts FROM cap WHERE host <> ''),
suffixes AS (SELECT host, array_to_string(parts[i:], '.') AS key FROM (SELECT host, parts, unnest(range(1, greatest(1, len(parts) - 1) + 1)) AS i FROM hosts)),
named AS (SELECT DISTINCT key, list, digits FROM suffixes, (VALUES {", ".join(f"('{k}', '{v}')" for k, v in LISTS.items())}) AS l(list, digits)),
hashed AS (SELECT key, list, md5(list || ':' || key) AS h FROM named WHERE contains(digits, substr(md5(list || ':' || key), 1, 1))),
days AS (SELECT key, list, h, DATE '{FIRST_DAY}' + CAST(CAST('0x' || substr(h, 2, 4) AS INT) % 300 AS INT) AS d1 FROM hashed),
ends AS (SELECT *, d1 + CAST(30 + CAST('0x' || substr(h, 6, 2) AS INT) AS INT) AS d2 FROM days),
spans AS (SELECT list, key, d1 AS a, d2 AS b FROM ends UNION ALL
          SELECT list, key, d2 + 60, DATE '9999-12-31' FROM ends WHERE CAST('0x' || substr(h, 8, 1) AS INT) % 2 = 0),
hits AS (SELECT DISTINCT c.host, c.fetch_day, s.key, p.list FROM cap c JOIN suffixes s ON c.host = s.host JOIN spans p ON p.key = s.key AND c.fetch_day >= p.a AND c.fetch_day < p.b),
v AS (SELECT host, fetch_day, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, arg_max(key, lpad(CAST(length(key) AS VARCHAR), 6, '0') || key) AS matched FROM hits GROUP BY ALL)
SELECT page_id, host, CAST(fetch_day AS VARCHAR) AS fetch_day, coalesce(n, 0) > 0 AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(lists, '') AS lists, matched
FROM cap LEFT JOIN v USING (host, fetch_day)
"""

def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of a label; sums of 64 products in double precision.
OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
             WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
               AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
               AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a WHERE r.c < l.b),
c AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.a AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, c.a = component_id AS kept
FROM c LEFT JOIN k ON c.a = k.a
"""


def tokenizer_path() -> str:
    """The tokenizer of the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by text, html lang attribute, address suffix and host, and all documents, by text and source.

    The text model learns from the labels of documents (their column lang),
    which therefore is no evidence about them. A row has either a doc_id or a
    page_id.
    """
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit_text_model(documents, "doc_id", "text", "lang")
    of_documents = identify(documents, host=F.col("source"), model=model).withColumn("page_id", F.lit(None).cast("long"))
    host = host_of(F.col("url"))
    read = pages.select("page_id", page_text(F.col("html")).alias("text"), page_declared(F.col("html")).alias("declared"), host.alias("host"))
    of_pages = identify(read, id_col="page_id", declared=F.col("declared"), suffix=address_suffix(F.col("host")), host=F.col("host"), model=model)
    of_pages = of_pages.withColumn("page_id", F.col("doc_id")).withColumn("doc_id", F.lit(None).cast("long"))
    return of_documents.unionByName(of_pages)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _round(n: int) -> str:
    """SQL of the assignment to the centroids c{n} and of the centroids c{n + 1} after it."""
    return f"""
a{n} AS (SELECT vec_id, v.c, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM (
  SELECT vec_id, v.c, k, list_sum(list_transform(list_zip(v.c, cen.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{n} AS cen) AS v GROUP BY ALL),
m{n} AS (SELECT k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
  SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM a{n}) GROUP BY k, i) GROUP BY k),
c{n + 1} AS (SELECT c{n}.k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))"""


#: Every distance of every round, by its definition; vec_id is unique in the given table.
OP11_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS INT) - 1 AS k, c FROM v QUALIFY k < 16),
{",".join(_round(n) for n in range(3))},
last AS (SELECT vec_id, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM (
  SELECT vec_id, k, list_sum(list_transform(list_zip(v.c, cen.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c3 AS cen) GROUP BY ALL)
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM last JOIN c3 USING (k)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
    return hard_negatives(vectors, F.expr("vec_id % 100 = 0"))


#: Every score of every anchor.
OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS y FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.y, b.y) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False).drop("ids")


QUERIES: dict[str, Query] = {"op1_exact_dedup": op1_exact_dedup, "op2_lm_score": op2_lm_score, "op3_mixing": op3_mixing, "op4_suffix_dedup": op4_suffix_dedup, "op5_near_dedup": op5_near_dedup, "op6_sharding": op6_sharding, "op7_packing": op7_packing, "op8_embedding_dedup": op8_embedding_dedup, "op9_url_filter": op9_url_filter, "op10_language_id": op10_language_id, "op11_centroid_clustering": op11_centroid_clustering, "op12_hard_negatives": op12_hard_negatives, "op13_bpe": op13_bpe}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op3_mixing": OP3_SQL, "op8_embedding_dedup": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_centroid_clustering": OP11_SQL, "op12_hard_negatives": OP12_SQL}
