"""Ordered folds of clamped linear updates, as compositions that tasks share.

An update x -> min(hi, max(lo, a * x + b)) with a >= 0 followed by another is
such an update again. So a key's updates, in order, are composed FAN at a time
into one, level by level, and it makes no difference how many a key has: the
rows are sorted by range, numbered through, and a level groups by key and
number / FAN. No task holds a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.sources.scratch import written

FAN = 16
#: Stands for no bound; finite, as 0 * BIG must be 0.
BIG = 1e18


def update(a: Column | float, b: Column | float, lo: Column | float = -BIG, hi: Column | float = BIG) -> Column:
    cols = {k: (v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in {"a": a, "b": b, "lo": lo, "hi": hi}.items()}
    return F.struct(*cols.values())


def apply(u: Column, x: Column | float) -> Column:
    return F.least(u["hi"], F.greatest(u["lo"], u["a"] * x + u["b"]))


def after(first: Column, then: Column) -> Column:
    """The update that is ``first`` and then ``then``."""
    return update(first["a"] * then["a"], then["a"] * first["b"] + then["b"], apply(then, first["lo"]), apply(then, first["hi"]))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "fold") -> DataFrame:
    """rows with ``pos`` (0, 1, ... through all of them, by keys and order), ``i`` (from 1 within the key) and ``before`` (the row of the key before it, as a struct of ``order``); written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    sizes = {r[0]: r[1] for r in dealt.groupBy("_part").count().collect()}  # a row a partition
    ends, start = {}, 0
    for p in sorted(sizes):
        ends[p], start = start, start + sizes[p]
    offset = F.create_map(*[F.lit(x) for kv in ends.items() for x in kv])[F.col("_part")] if ends else F.lit(0)
    dealt = dealt.withColumn("pos", (offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at", "_part")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    first = dealt.groupBy(*keys).agg(F.min("pos").alias("_first"))
    prior = dealt.select((F.col("pos") + 1).alias("pos"), *keys, F.struct(*order).alias("before"))
    near = dealt.alias("x").join(prior.alias("y"), [F.col("x.pos") == F.col("y.pos"), *same], "left").select("x.*", "y.before")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"z.{k}")) for k in keys]
    out = near.alias("x").join(first.alias("z"), same).select("x.*", (F.col("x.pos") - F.col("z._first") + 1).alias("i"))
    return written(out, f"{name}-numbered")


def folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, u, n``: the composition of each key's updates u in the order of pos, and how many they are."""
    level = rows.select(*keys, "pos", "u", F.lit(1).cast("long").alias("n"))

    def composed(by: list, at: Column) -> DataFrame:
        slots = F.array(*[F.max(F.when(at == k, F.col("u"))) for k in range(FAN)])
        one = F.aggregate(F.filter(slots, lambda u: u.isNotNull()), update(1.0, 0.0), lambda s, u: after(s, u))
        return level.groupBy(*by).agg(one.alias("u"), F.sum("n").alias("n"))

    while (level.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > FAN:
        level = written(composed([*keys, F.shiftright("pos", 4).alias("pos")], F.col("pos") % FAN), "fold-level")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1  # at most FAN rows a key
    level = level.withColumn("place", place)
    return composed(keys, F.col("place"))
