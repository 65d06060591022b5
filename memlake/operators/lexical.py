"""Keyword search: postings, BM25 and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``id, term, tf, dl``: how often each term is in each document, and how many terms it has."""
    terms = docs.select(F.col(id_col).alias("id"), tokens.alias("terms"))
    return terms.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, n_docs: int, mean_length: float, terms: list[str], prefix: bool = False) -> DataFrame:
    """``id, score`` of documents with any of the terms (or words that begin with one).

    Terms are matched against the vocabulary's rows of the index by a filter
    that reaches the scan; document frequencies count the matches of a term.
    """
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    hit = None
    for t in terms:
        one = F.when(F.col("term").startswith(t) if prefix else F.col("term") == t, F.lit(t))
        hit = one if hit is None else F.coalesce(hit, one)
    rows = index.withColumn("query", hit).where("query is not null").groupBy("query", "id", "dl").agg(F.sum("tf").alias("tf"))
    df = rows.groupBy("query").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean_length)))
    return rows.join(F.broadcast(df), "query").groupBy("id").agg(F.sum(part).alias("score"))  # one row a query term


def overlap(docs: DataFrame, id_col: str, tokens: Column, groups: list[list[str]]) -> DataFrame:
    """Share of the query's synonym groups that a document has a word of."""
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("terms"))
    found = sum((F.arrays_overlap("terms", F.array(*map(F.lit, g))).cast("int") for g in groups), F.lit(0))
    return rows.select("id", (found / F.lit(max(1, len(groups)))).alias("similarity")).where("similarity > 0")
