"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Texts are equal when they are identical after lower-casing A-Z only; a null
text is an empty text. Rows are refined in three steps, and each step looks
only at the rows whose group had two or more members in the step before:

1. byte length of the text,
2. length and a hash of the first ``prefix_chars`` characters,
3. length, prefix hash and SHA-256 of the whole text.

All group sizes come from partial aggregation before the shuffle, so a group
with a third of all rows sends one row a task; the way back to the rows is a
join of two plain tables, whose hot partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, ascii_lower, keyed_join, numbered, without_rows, written

PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, fingerprint_all: bool = False) -> DataFrame:
    """One row for each row of docs: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. ``text_sha256`` (of the
    normalised text) is null where a row dropped out of the refinement before
    its whole text was needed; ``fingerprint_all`` asks for it in every row,
    which reads each text once and needs no second scan.

    Null or empty texts are equal to each other. A null id counts as smaller
    than any other and is its own keep_id if all ids of its group are null
    (kept is then true). Rows that repeat an id share that id's fate. An empty
    table gives no rows. Other columns of docs are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = ascii_lower(text)
    size = F.octet_length(text).alias("_len")
    prefix = F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars))).alias("_prefix")
    sha = F.sha2(norm.cast("binary"), 256)
    ident = F.col(id_col).alias("doc_id")
    if fingerprint_all:
        thin = written(docs.select(ident, size, prefix, sha.alias("_sha")), "exact")
    else:
        thin = written(docs.select(ident, size, prefix), "exact")

    by_len = thin.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len")
    step1 = written(keyed_join(thin, by_len, ["_len"], "left_semi", "exact-len"), "exact-step1")
    by_prefix = step1.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1").select("_len", "_prefix")
    if fingerprint_all:
        full = written(keyed_join(step1, by_prefix, ["_len", "_prefix"], "left_semi", "exact-prefix"), "exact-step2")
    else:
        ids = written(keyed_join(step1, by_prefix, ["_len", "_prefix"], "left_semi", "exact-prefix").select(F.col("doc_id").alias("_id")).distinct(), "exact-ids")
        texts = docs.select(ident, size, prefix, norm.alias("_text")).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        full = written(texts.select("doc_id", "_len", "_prefix", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")), "exact-step2")
    groups = full.groupBy("_len", "_prefix", "_sha").agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    if fingerprint_all:
        rows = keyed_join(thin, groups, ["_len", "_prefix", "_sha"], "left", "exact-groups")
    else:
        # rows that repeat an id with the same length and prefix are told apart by their whole text only
        known = full.groupBy("doc_id", "_len", "_prefix").agg(F.collect_set("_sha").alias("_shas"), F.count("*").alias("_rows"))
        alike = written(known.where(F.size("_shas") > 1).select("doc_id", "_len", "_prefix"), "exact-alike")
        same = [thin["doc_id"].eqNullSafe(F.col("_id")), thin["_len"] == F.col("_l"), thin["_prefix"] == F.col("_p")]

        def renamed(table: DataFrame, *more: str) -> DataFrame:
            return table.select(F.col("doc_id").alias("_id"), F.col("_len").alias("_l"), F.col("_prefix").alias("_p"), *more)

        plain = thin.join(renamed(alike), same, "left_anti")
        one = written(renamed(known.where(F.size("_shas") == 1).withColumn("_sha", F.element_at("_shas", 1)), "_sha"), "exact-known")
        rows = plain.join(one, same, "left").select("doc_id", "_len", "_prefix", "_sha")
        rows = rows.unionByName(full.join(renamed(alike), [full["doc_id"].eqNullSafe(F.col("_id")), full["_len"] == F.col("_l"), full["_prefix"] == F.col("_p")], "left_semi"))
        rows = keyed_join(written(rows, "exact-rows"), groups, ["_len", "_prefix", "_sha"], "left", "exact-groups")
    keep = F.coalesce("_keep", "doc_id")
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest id; all columns stay.

    Null and empty texts are equal. Of rows equal in id (or without one) and
    text one stays. An empty table stays empty.
    """
    rows = numbered(docs, "exact-docs")
    thin = rows.select(F.struct(F.col(id_col).alias("id"), F.col(ROW).alias("row")).alias("id"), F.col(text_col).alias("text"))
    gone = exact_dedup(thin, "id", "text", fingerprint_all=True).where(~F.col("kept")).select(F.col("doc_id.row").alias(ROW))
    return without_rows(rows, gone)
