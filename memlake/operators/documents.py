"""Document ledger: fingerprints, near-copies, references and reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import hamming, shingles
from memlake.sources.scratch import written

BITS = 64
#: Different fingerprints up to which keys of two blocks make fewer rows and pairs than keys of three.
FEW_PRINTS = 1 << 22


def simhash(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id, fingerprint``: each bit is the majority over the hashes of the shingles; documents without words have none.

    The hash is the first 8 bytes of md5. Votes are added up by partial
    aggregation, one row a document and task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.explode(shingles(text)).alias("gram"))
    rows = rows.withColumn("digest", F.md5("gram"))
    rows = rows.withColumn("hi", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")).withColumn("lo", F.conv(F.substring("digest", 9, 8), 16, 10).cast("long"))
    votes = [F.sum(F.shiftright(F.col("hi" if b >= 32 else "lo"), b % 32).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{b}") for b in range(BITS)]
    summed = rows.groupBy("id").agg(*votes)
    out = F.lit(0).cast("long")
    for b in range(BITS):
        out = out.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return summed.select("id", out.alias("fingerprint"))


def near_pairs(prints: DataFrame, most: int = 6, spare: int | None = None) -> DataFrame:
    """Pairs of different fingerprints within ``most`` bits, and members of equal ones through their least id.

    A fingerprint is cut into most + spare blocks. Two within the distance
    differ in ``most`` blocks at most, so they agree in some ``spare`` of
    them: each choice of so many blocks is a key. Two blocks of eight make 28
    keys of 16 bits, three of nine 84 of 21: more rows, but fewer pairs that
    only meet by chance, which count most where prints are very many.
    Equal fingerprints fall together first.
    """
    reps = written(prints.groupBy("fingerprint").agg(F.min("id").alias("id")), "simhash-reps")
    spare = spare or (2 if reps.count() <= FEW_PRINTS else 3)
    n = most + spare
    edges = [BITS * k // n for k in range(n + 1)]
    blocks = F.array(*[F.shiftrightunsigned("fingerprint", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)])
    chosen = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(n), spare)])
    keys = F.transform(chosen, lambda c, i: F.xxhash64(i, F.transform(c, lambda k: F.get("blocks", k))))
    rows = written(reps.withColumn("blocks", blocks).select("id", "fingerprint", F.explode(keys).alias("key")), "simhash-keys")
    left, right = rows, rows.withColumnsRenamed({"id": "other", "fingerprint": "other_print"})
    pairs = left.join(right, "key").where((F.col("id") < F.col("other")) & (hamming(F.col("fingerprint"), F.col("other_print")) <= most)).select("id", "other").distinct()
    same = prints.join(reps.withColumnRenamed("id", "first"), "fingerprint").where("id <> first").select(F.col("first").alias("id"), F.col("id").alias("other"))
    return pairs.unionByName(same)


def clusters(pairs: DataFrame) -> DataFrame:
    """``id, cluster``: least id reachable over the pairs. Each round takes the least label around and then that label's own, so rounds grow with the logarithm of the diameter."""
    both = written(pairs.select("id", "other").unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "cluster-edges")
    labels = written(both.select("id").distinct().withColumn("cluster", F.col("id")), "cluster-0")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("cluster").alias("near"))
        near = written(labels.join(seen, "id").select("id", "cluster", F.least("cluster", "near").alias("least")), "cluster-near")
        jump = near.select(F.col("id").alias("least"), F.col("least").alias("beyond"))
        new = written(near.join(jump, "least", "left").select("id", F.least("least", F.coalesce("beyond", "least")).alias("now"), "cluster"), "cluster")
        labels = new.select("id", F.col("now").alias("cluster"))
        if not new.where("now <> cluster").limit(1).count():
            return labels


def superseding_chain(registry: DataFrame) -> DataFrame:
    """``doc_id, last, hops``: where following superseded_by from each superseded document ends.

    Each round doubles the steps, so a chain takes as many rounds as its
    length has bits. A chain that runs in a circle has no end: it stops after
    as many rounds as the table could need.
    """
    rows = written(registry.where("superseded_by is not null").select("doc_id", F.col("superseded_by").alias("last"), F.lit(1).alias("hops")), "chain-0")
    for turn in range(rows.count().bit_length() + 1):
        ahead = rows.select(F.col("doc_id").alias("last"), F.col("last").alias("end"), F.col("hops").alias("more"))
        new = rows.join(ahead, "last", "left").select("doc_id", F.coalesce("end", "last").alias("last"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("end").isNotNull().alias("moved"))
        new = written(new, f"chain-{turn + 1}")
        rows = new.select("doc_id", "last", "hops")
        if not new.where("moved").limit(1).count():
            break
    return rows


def renames(vanished: DataFrame, fresh: DataFrame) -> DataFrame:
    """One-to-one pairs of vanished and new paths with the same content hash, first with first in order of path."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("path").alias(name), "hash", F.row_number().over(Window.partitionBy("hash").orderBy("path")).alias("rn"))

    return numbered(vanished, "old_path").join(numbered(fresh, "new_path"), ["hash", "rn"]).select("old_path", "new_path")


def glob_type(path: Column, rules: list[tuple[str, str, str | None]]) -> tuple[Column, Column]:
    """(type, tier) by the first glob that fits; ``*`` also crosses slashes."""
    kind, tier = F.lit("unknown"), F.lit("T2")
    for pattern, name, level in reversed(rules):
        regex = "^" + pattern.replace("**", "*").replace(".", "[.]").replace("*", ".*") + "$"
        fits = path.rlike(regex)
        kind = F.when(fits, F.lit(name)).otherwise(kind)
        tier = F.when(fits, F.lit(level or "T2")).otherwise(tier)
    return kind, tier


def reference_changes(known: DataFrame, current: DataFrame, most_new: int = 50) -> DataFrame:
    """References to close (known, not current) and to add (current, not known; at most ``most_new`` a document)."""
    keys = ["doc_id", "ref_value"]
    gone = known.select(*keys).join(current.select(*keys), keys, "left_anti").withColumn("change", F.lit("invalidate"))
    new = current.select(*keys).join(known.select(*keys), keys, "left_anti")
    new = new.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("ref_value"))).where(F.col("rn") <= most_new).drop("rn")
    return gone.unionByName(new.withColumn("change", F.lit("add")))
