"""Many phrases in many texts, by automata.

Distinct phrases are dealt into shards of a bounded size and texts into
blocks; each block meets each shard once, in a task that builds the shard's
Aho-Corasick automaton and runs every text through it once, however many
phrases there are. A phrase that many rows share is looked for once. Pairs of
texts and owners of phrases can be far more than both, so they are made within
a task, from lists, and never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases of a shard and of texts of a block, about.
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 64 << 20
#: Of cells that make pairs: bytes of texts, texts, and owners of phrases.
PAIR_BYTES, PAIR_TEXTS, PAIR_OWNERS = 8 << 20, 2_048, 4_096
FOUND = "text_id long, phrase string"


def _size(df: DataFrame, column: str, most: int) -> int:
    return max(1, math.ceil((df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0) / most))


def phrase_hits(texts: DataFrame, phrases: DataFrame, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``text_id, phrase``: which phrases (phrase) stand somewhere in which texts (text_id, text), each pair once; null and empty ones nowhere."""
    import ahocorasick

    said = texts.where("text <> ''").select(F.col("text_id").cast("long").alias("text_id"), "text")
    asked = phrases.where("phrase <> ''").select("phrase").distinct()
    shards, blocks = _size(asked, "phrase", shard_bytes), _size(said, "text", block_bytes)
    left = asked.select("phrase", F.pmod(F.xxhash64("phrase"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = said.select("text_id", "text", F.pmod(F.xxhash64("text_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(asked: pa.Table, said: pa.Table) -> pa.Table:
        ids, found = [], []
        if asked.num_rows and said.num_rows:
            machine = ahocorasick.Automaton()
            for phrase in asked.column("phrase").to_pylist():
                machine.add_word(phrase, phrase)
            machine.make_automaton()
            for i, text in zip(said.column("text_id").to_pylist(), said.column("text").to_pylist(), strict=True):
                hits = {phrase for _, phrase in machine.iter(text)}
                ids += [i] * len(hits)
                found += hits
        return pa.table({"text_id": pa.array(ids, pa.int64()), "phrase": pa.array(found, pa.string())})

    left = left.withColumn("block", F.col("block").cast("long"))
    right = right.withColumn("shard", F.col("shard").cast("long"))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(lambda a, b: search(a, b), FOUND)


def _machine(phrases: list[str]):
    """An automaton that tells phrases by their places."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        machine.add_word(phrase, k)
    machine.make_automaton()
    return machine


def _in_blocks(texts: DataFrame, block_texts: int | None = None) -> tuple[DataFrame, int]:
    """Texts (text_id, text) that aren't empty with their block, and how many blocks there are."""
    said = texts.where("text <> ''").select(F.col("text_id").cast("long").alias("text_id"), "text")
    size, n = said.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    blocks = max(1, math.ceil((size or 0) / PAIR_BYTES), math.ceil(n / (block_texts or 8 * PAIR_TEXTS)))
    return said.withColumn("block", F.pmod(F.xxhash64("text_id"), F.lit(blocks)).cast("int")), blocks


def _everywhere(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("shard", "block")


def owners_in(texts: DataFrame, phrases: DataFrame, owners: int = PAIR_OWNERS, block_texts: int = PAIR_TEXTS) -> DataFrame:
    """``text_id, owner``: each pair once of a text (text_id, text) and an owner (owner, phrase; any number of rows) of which some phrase stands in it.

    All phrases of an owner are in one shard, so a text's owners there are
    the union of its phrases' owners, as bits.
    """
    asked = phrases.where("phrase <> ''").select("owner", "phrase").distinct()
    shards = max(1, -(-asked.select("owner").distinct().count() // owners))
    said, blocks = _in_blocks(texts, block_texts)
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int"))

    def search(asked: pa.Table, said: pa.Table) -> pa.Table:
        ids, found, names = [], [], asked.column("owner").slice(0, 0).combine_chunks()
        if asked.num_rows and said.num_rows:
            dealt = asked.column("owner").combine_chunks().dictionary_encode()
            names, own = dealt.dictionary, dealt.indices.to_numpy()
            coded = asked.column("phrase").combine_chunks().dictionary_encode()
            bits = np.zeros((len(coded.dictionary), -(-len(names) // 8)), np.uint8)
            np.bitwise_or.at(bits, (coded.indices.to_numpy(), own >> 3), (128 >> (own & 7)).astype(np.uint8))
            machine = _machine(coded.dictionary.to_pylist())
            held: dict = {}
            for i, text in zip(said.column("text_id").to_pylist(), said.column("text"), strict=True):
                hits = {k for _, k in machine.iter(text.as_py())}
                if hits:
                    mask = np.bitwise_or.reduce(bits[list(hits)])
                    held[i] = held[i] | mask if i in held else mask
            ids = list(held)
            found = [np.flatnonzero(np.unpackbits(mask, count=len(names))) for mask in held.values()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = names.take(pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        return pa.table({"text_id": pa.array(ids, pa.int64()), "owners": pa.ListArray.from_arrays(ends, flat)})

    pairs = _everywhere(asked, "block", blocks).cogroup(_everywhere(said, "shard", shards)).applyInArrow(lambda a, b: search(a, b), f"text_id long, owners array<{dict(asked.dtypes)['owner']}>")
    return pairs.select("text_id", F.explode("owners").alias("owner"))


def sole_owners_in(texts: DataFrame, phrases: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """As ``owners_in``, for owners of one phrase each: a phrase's texts and its owners meet as two lists."""
    asked = phrases.where("phrase <> ''").select("owner", "phrase").distinct()
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("phrase").cast("long"))).first()
    shards, lists = max(1, math.ceil((8 * n + (size or 0)) / shard_bytes)), max(1, -(-n // PAIR_OWNERS))
    asked = asked.groupBy("phrase", F.pmod(F.xxhash64("owner"), F.lit(lists)).alias("part")).agg(F.collect_list("owner").alias("owners"))
    asked = asked.select("phrase", "owners", F.pmod(F.xxhash64("phrase", "part"), F.lit(shards)).cast("int").alias("shard"))
    said, blocks = _in_blocks(texts)

    def search(asked: pa.Table, said: pa.Table) -> pa.Table:
        rows, held, owners = [], [], asked.column("owners")
        owners = owners.cast(pa.list_(owners.type.value_type))
        if asked.num_rows and said.num_rows:
            coded = asked.column("phrase").combine_chunks().dictionary_encode()
            machine, where = _machine(coded.dictionary.to_pylist()), {}
            for i, text in zip(said.column("text_id").to_pylist(), said.column("text"), strict=True):
                for _, k in machine.iter(text.as_py()):
                    where.setdefault(k, {})[i] = None
            for row, k in enumerate(coded.indices.to_pylist()):
                if k in where:
                    rows.append(row), held.append(list(where[k]))
        return pa.table({"texts": pa.array(held, pa.list_(pa.int64())), "owners": owners.take(pa.array(rows, pa.int64()))})

    kind = dict(asked.dtypes)["owners"]
    lists = _everywhere(asked, "block", blocks).cogroup(_everywhere(said, "shard", shards)).applyInArrow(lambda a, b: search(a, b), f"texts array<long>, owners {kind}")
    return lists.select("owners", F.explode("texts").alias("text_id")).select("text_id", F.explode("owners").alias("owner"))


def matched_skills(contexts: DataFrame, triggers: DataFrame) -> DataFrame:
    """``text_id, skill_id`` of skills (skill_id, trigger; several rows a skill) of which some trigger stands in a context (text_id, text), case aside."""
    lowered = triggers.select(F.col("skill_id").alias("owner"), F.lower("trigger").alias("phrase")).where("phrase <> ''")
    several = lowered.groupBy("owner").agg(F.min("phrase").alias("a"), F.max("phrase").alias("b"))
    texts = contexts.select("text_id", F.lower("text").alias("text"))
    out = sole_owners_in(texts, several.where("a = b").select("owner", F.col("a").alias("phrase")))
    others = several.where("a <> b").select("owner")
    if others.limit(1).count():
        out = out.unionByName(owners_in(texts, lowered.join(others, "owner", "left_semi")))
    return out.withColumnRenamed("owner", "skill_id")
