"""The corpus pipeline over ``documents``: filter, deduplicate, mix and pack.

STAGES lists (name, function) in order. Each function takes
``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of
documents. Each stage decides on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import ROW, numbered, without_rows, written
from memlake.llm.exact_dedup import without_copies
from memlake.llm.language_id import fit_text_model, identify
from memlake.llm.mixing import mix
from memlake.llm.near_dedup import without_near_copies
from memlake.llm.packing import pack_documents
from memlake.llm.queries import DOMAIN_WEIGHTS, LANG_WEIGHTS, source_domain, tokenizer_path

#: Share of the tokens that the mixture keeps; no document is taken twice.
MIX_SHARE = 0.8
MIX_SEED = 23

#: No stage but exact dedup can be said in SQL as it decides; see tests/llm.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, by their text and the languages of their source.

    The column lang teaches the text model and is no evidence. Null and empty
    texts go, and texts that a uniform model explains better than any
    language. Each row is judged on its own, whether or not it repeats an id
    or a text or has no id; an empty table stays empty.
    """
    rows = numbered(docs, "language-docs")
    model = fit_text_model(rows, "doc_id", "text", "lang")
    found = identify(rows, id_col=ROW, host=F.col("source"), model=model)
    return without_rows(rows, found.where("rejected").select(F.col("doc_id").alias(ROW)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id.

    Null and empty texts are equal. Of rows equal in id (or without one) and
    text one stays; an empty table stays empty.
    """
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the least id.

    Null and empty texts are linked with nothing and stay. Rows are documents
    of their own, also if they repeat an id or have none; an empty table stays
    empty.
    """
    return without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the target weights take.

    A null language, source or domain is a leaf of its own; null and empty
    texts have no tokens and go with the part of their leaf they lie in. Rows
    that repeat an id are taken or left one by one, those without an id stand
    together in the seeded order; an empty table stays empty.
    """
    rows = numbered(docs, "mixing-docs")
    mixed = mix(rows, source_domain(), DOMAIN_WEIGHTS, LANG_WEIGHTS, budget_share=MIX_SHARE, max_epochs=1, seed=MIX_SEED, carried=(ROW,))
    return without_rows(rows, mixed.where("copies = 0").select(ROW))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of 1024 tokens.

    A null or empty text is a piece of the end id alone. Rows that repeat an
    id, or have none, are packed one by one; an empty table gives no pieces.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
