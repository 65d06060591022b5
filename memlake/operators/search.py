"""Search over memories: a stemmed index with synonyms, substrings for short results, a scan at last, one composite score.

The index is kept (``operators.index``). A query looks its stems up in the
dictionary by prefix and then reads only the buckets with their postings. All
queries of a table are answered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring as S
from memlake.functions import text as T
from memlake.functions import unicode as U
from memlake.operators.cells import best_recalls, best_sums, groups_met
from memlake.operators.index import KINDS, KeptIndex
from memlake.operators.lexical import B, K1
from memlake.sources.scratch import written

#: Candidates for each result that is wanted, and at least so many.
OVERSAMPLE, LEAST = 4, 32
SCAN_ROWS = 1000


def build_index(notes: DataFrame, id_col: str, text: Column, path: str | None = None, kinds: tuple[str, ...] = KINDS) -> KeptIndex:
    """A kept index of the active notes, with postings of some kinds."""
    rows = notes.where("status = 'active'").select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return KeptIndex(notes.sparkSession, path, kinds=kinds).apply(rows)


def query_groups(queries: DataFrame) -> DataFrame:
    """``query_id, place, token, word``: each query's distinct tokens in order, and each token's synonyms, itself included."""
    tokens = queries.select("query_id", F.posexplode(F.array_distinct(U.search_tokens(F.col("query")))).alias("place", "token"))
    return tokens.select("query_id", "place", "token", F.explode(T.synonyms_of(F.col("token"))).alias("word"))


def _part(index: KeptIndex, df: Column, tf: Column, dl: Column, mean: float) -> Column:
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(index.facts["n"]) - df + 0.5) / (df + 0.5)))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "id"))
    return scores.withColumn("rn", rank).where(F.col("rn") <= max(OVERSAMPLE * k, LEAST)).select("query_id", "id", S.bm25_similarity(-F.col("bm25")).alias("similarity"))


def _ranked(index: KeptIndex, asked: DataFrame, found: DataFrame, by: str, mean: float, k: int) -> DataFrame:
    """Best documents of each query by BM25; asked: query_id and ``by``; found: ``by``, id, tf, dl."""
    found = written(found, "search-found")
    df = found.groupBy(by).agg(F.count("*").alias("df"))
    parts = found.join(df, by).select(by, "id", _part(index, F.col("df"), F.col("tf"), F.col("dl"), mean).alias("part"))
    scored = best_sums(asked, parts, by, index.facts["n"], max(OVERSAMPLE * k, LEAST))
    return _best(scored.withColumnRenamed("total", "bm25"), k)


def stem_hits(index: KeptIndex, words: DataFrame, k: int) -> DataFrame:
    """``query_id, id, similarity``: the best by BM25 over words that begin with a query word's stem."""
    stems = written(words.select("query_id", "word").distinct().withColumn("prefix", U.stem(F.col("word"))).select("query_id", "prefix").distinct(), "search-stems")
    terms = index.begins_with("stems", stems.select("prefix").distinct())
    found = index.postings("stems", terms).groupBy("prefix", "id", "dl").agg(F.sum("tf").alias("tf"))
    return _ranked(index, stems, found, "prefix", index.facts["mean"], k)


def substring_hits(index: KeptIndex, words: DataFrame, k: int) -> DataFrame:
    """``query_id, id, similarity``: the best by BM25 over places where a word of three characters or more stands in the text."""
    terms = written(words.where(F.length("word") >= 3).select("query_id", "word").distinct(), "search-words")
    return _ranked(index, terms, index.holders(terms.select("word").distinct()), "word", index.facts["mean_grams"], k)


def scan_hits(notes: DataFrame, index: KeptIndex, groups: DataFrame, id_col: str) -> DataFrame:
    """``query_id, id, similarity``: of the newest rows that hold a query word somewhere, the share of the query's groups that they have as a token.

    The newest rows of a query are among the newest of its words, so each word
    keeps no more than a query may.
    """
    rows = notes.where("status = 'active'").select(F.col(id_col).alias("id"), "updated_at")
    asked = groups.select("query_id", "word").distinct()

    def newest(rows: DataFrame, by: str) -> DataFrame:
        # a plain condition on the rank, so that each task keeps no more before rows are shuffled
        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("updated_at"), "id"))
        return rows.withColumn("rn", rank).where(F.col("rn") <= SCAN_ROWS).drop("rn")

    of_word = index.holders(asked.select("word").distinct()).select("word", "id").join(rows, "id")
    of_word = written(newest(of_word, "word"), "search-newest")
    held = asked.join(of_word, "word").select("query_id", "id", "updated_at").distinct()
    held = written(newest(held, "query_id").select("query_id", "id"), "search-scanned")
    # a row's terms are far more than a pair of a query and a row: they meet in cells and are never copied for a query
    docs = index.docs().select("id", "terms").join(held.select("id").distinct(), "id", "left_semi")
    size = groups.select("query_id", "place").distinct().groupBy("query_id").agg(F.count("*").alias("size"))
    hit = groups_met(groups, held, docs, index.facts["n"])
    return hit.join(size, "query_id").select("query_id", "id", (F.col("hits") / F.col("size")).alias("similarity"))


def composed(notes: DataFrame, hits: DataFrame, id_col: str, k: int, now: Column) -> DataFrame:
    """The k best of each query's hits, hydrated from the notes, by composite score; usage is measured by the most used of its hits."""
    full = hits.join(notes.where("status = 'active'").withColumnRenamed(id_col, "id"), "id")
    full = full.withColumn("most", F.max("access_count").over(Window.partitionBy("query_id")))
    score = S.composite(F.col("similarity"), F.col("confidence"), S.recency(now, F.col("updated_at")), S.usage(F.col("access_count"), F.col("most"))) * S.tier_factor(F.col("doc_tier"))
    full = full.where(~F.col("doc_tier").eqNullSafe("TX")).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return full.withColumn("place", rank).where(F.col("place") <= k).select("query_id", F.col("id").alias("memory_id"), "similarity", "score", "place")


def search(notes: DataFrame, index: KeptIndex, queries: DataFrame, k: int, now: Column, id_col: str = "memory_id", types: list[str] | None = None) -> DataFrame:
    """``query_id, memory_id, similarity, score, place``: the k best memories for each row (query_id, query) of queries.

    Words that begin with the stem of a query word or of one of its synonyms
    are found by BM25; queries with fewer than k hits, or with characters of a
    script without word boundaries, also take substrings; those without any
    hit scan the newest rows. A k below 0 counts as 0; no types, no results.
    """
    k = max(0, k)
    if k == 0 or types == []:
        return composed(notes.limit(0), queries.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("similarity")), id_col, 0, now)
    pool = notes if types is None else notes.where(F.col("memory_type").isin(*types))
    groups = written(query_groups(queries), "search-groups")
    hits = written(stem_hits(index, groups, k), "search-stem-hits")
    many = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    short = groups.select("query_id", "word").join(many, "query_id", "left")
    short = short.withColumn("foreign", F.max(F.col("word").rlike(U.CJK).cast("int")).over(Window.partitionBy("query_id")))
    short = written(short.where((F.coalesce("hits", F.lit(0)) < k) | (F.col("foreign") == 1)).select("query_id", "word"), "search-short")
    if not short.isEmpty():
        more = substring_hits(index, short, k)
        hits = written(hits.unionByName(more).groupBy("query_id", "id").agg(F.max("similarity").alias("similarity")), "search-merged")
    none = written(groups.join(hits.select("query_id").distinct(), "query_id", "left_anti"), "search-none")
    if not none.isEmpty():
        hits = hits.unionByName(scan_hits(pool, index, none, id_col))
    return composed(pool, hits, id_col, k, now)


# ---- recall of memories for a prompt

RARE, NAMING, SHOWN_AT_ONCE, SHORTEST_PROMPT = 3, 4, 3, 12


def prompt_recall(notes: DataFrame, prompts: DataFrame, shown: DataFrame | None = None, most: int = SHOWN_AT_ONCE) -> DataFrame:
    """``session, memory_id, hits, is_foreign, place``: what a prompt (session, repo_id, text) brings back.

    A memory (memory_id, naming, text, repo_id, subject, confidence, status)
    is recalled if it shares two tokens with the prompt, or one that names it
    and is rare (in at most RARE memories, of NAMING characters or more). One
    of another repository needs both. Local ones come first, then those with
    more hits (rare naming ones count twice), then the surer ones. What
    ``shown`` (session, memory_id) has is left out. Prompts that are short or
    commands recall nothing.
    """
    rows = notes.where("status = 'active'")
    tokens = written(rows.select("memory_id", F.explode(T.prompt_tokens(F.concat_ws(" ", "naming", "text"))).alias("token")), "recall-tokens")
    names = rows.select("memory_id", F.explode(T.prompt_tokens(F.col("naming"))).alias("token")).withColumn("names", F.lit(1))
    asked = prompts.where((F.length("text") >= SHORTEST_PROMPT) & ~F.ltrim("text").startswith("/"))
    asked = asked.select("session", F.col("repo_id").alias("here"), F.explode(T.prompt_tokens(F.col("text"))).alias("token")).distinct()
    wanted = written(tokens.join(asked.select("token").distinct(), "token", "left_semi"), "recall-wanted")
    rare = wanted.groupBy("token").agg((F.count("*") <= RARE).alias("rare"))
    # the tokens that one row of the store shares with a prompt
    wanted = written(wanted.join(rare, "token").join(names, ["memory_id", "token"], "left"), "recall-marked")
    naming = F.col("rare") & (F.col("names") == 1) & (F.length("token") >= NAMING)
    local = F.col("repo_id").isNull() | (F.lower(F.trim("subject")) == "user")
    facts = rows.select("memory_id", "repo_id", F.coalesce(local, F.lit(False)).alias("anywhere"), "confidence")
    held = written(wanted.select("memory_id", "token", F.coalesce(naming, F.lit(False)).alias("naming")).join(facts, "memory_id"), "recall-held")
    asked = written(asked.groupBy("session", "here").agg(F.collect_list("token").alias("tokens")), "recall-asked")
    hits = best_recalls(asked, held, shown, facts.count(), most)
    rank = F.row_number().over(Window.partitionBy("session").orderBy("is_foreign", F.desc("hits"), F.desc("confidence"), "memory_id"))
    return hits.withColumn("place", rank).where(F.col("place") <= most).select("session", "memory_id", "hits", "is_foreign", "place")
