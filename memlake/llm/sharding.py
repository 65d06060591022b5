"""Hilbert-curve sharding: one order over several metadata dimensions, cut into runs.

Language, source and text size are quantised to ``BITS`` bits each, the cell
they name gets its index on the Hilbert curve, and the rows in curve order are
cut into runs of near equal bytes. Near cells are near on the curve, so each
shard holds few languages, sources and sizes and readers can skip shards by
any of them.

No task ever sorts a whole cell: a cell is cut into sub-buckets by the hash of
the text, a large group of equal texts into salted parts, and positions come
from three running sums (cells, buckets of a cell, rows of a bucket). Built of
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_join, written

BITS = 4
#: Groups of equal texts from this size on are dealt over salted parts.
HOT_GROUP = 256
HOT_PARTS = 32
#: A group of equal texts is kept whole while that moves a cut by at most this share of a shard.
TOLERANCE = 0.01
ROWS_PER_SUB = 65536
LEAST_SUBS = 32


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Index of the cell (x, y, z), each in [0, 2**bits), on the 3-d Hilbert curve.

    The published transform by Skilling (2004): undo excess work from the top
    bit down, Gray-encode, interleave the bits.
    """
    steps = F.array(*[F.struct(F.lit(1 << k).alias("q"), F.lit(i).alias("i")) for k in range(bits - 1, 0, -1) for i in range(3)])
    start = F.struct(x.cast("int").alias("a"), y.cast("int").alias("b"), z.cast("int").alias("c"))

    def turn(s: Column, st: Column) -> Column:
        q, i = st["q"], st["i"]
        own = F.when(i == 0, s["a"]).when(i == 1, s["b"]).otherwise(s["c"])
        low = q - 1
        hit = own.bitwiseAND(q) != 0
        swap = s["a"].bitwiseXOR(own).bitwiseAND(low)
        return F.struct(
            F.when(hit, s["a"].bitwiseXOR(low)).otherwise(s["a"].bitwiseXOR(swap)).alias("a"),
            F.when((i == 1) & ~hit, s["b"].bitwiseXOR(swap)).otherwise(s["b"]).alias("b"),
            F.when((i == 2) & ~hit, s["c"].bitwiseXOR(swap)).otherwise(s["c"]).alias("c"),
        )

    def gray(s: Column) -> Column:
        b = s["a"].bitwiseXOR(s["b"])
        c = b.bitwiseXOR(s["c"])
        t = F.lit(0)
        for k in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(c.bitwiseAND(F.lit(1 << k)) != 0, F.lit((1 << k) - 1)).otherwise(F.lit(0)))
        index = F.lit(0)
        for k in range(bits - 1, -1, -1):
            for axis in (s["a"].bitwiseXOR(t), b.bitwiseXOR(t), c.bitwiseXOR(t)):
                index = index * 2 + F.shiftright(axis, k).bitwiseAND(F.lit(1))
        return index

    return F.aggregate(steps, start, turn, gray)


def hilbert_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tolerance: float = TOLERANCE) -> DataFrame:
    """Each row of docs in a shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``.

    Law ``bytes``: the shards' sizes (UTF-8 bytes plus 1 a row) differ by no
    more than the largest row, or by ``tolerance`` where a group of equal texts
    is kept whole. Equal texts take the least (lang, source) of their group, so
    they lie side by side on the curve, and a cut goes beside a group that is
    smaller than the tolerance. ``slot`` counts from 0 without gaps in curve
    order; ``grown_shard`` is null under this law.

    A null text counts as empty, null metadata as ''. Rows that repeat an id
    are placed one by one. An empty table gives no rows. Other columns of docs
    are not looked at, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("_g"),
        F.struct(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("l"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s")).alias("_meta"),
    )
    thin = written(thin, "shard-rows")
    total, rows = thin.agg(F.sum("size"), F.count("*")).first()
    total, subs = total or 1, max(LEAST_SUBS, -(-rows // ROWS_PER_SUB))

    groups = thin.groupBy("_g").agg(F.min("_meta").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    placed = keyed_join(thin, groups, ["_g"], "left", "shard-groups").withColumn("_meta", F.coalesce("_first", "_meta"))
    hot = F.coalesce(F.col("_n") >= HOT_GROUP, F.lit(False))
    side = 1 << BITS
    placed = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "_g",
        "_n",
        F.pmod(F.xxhash64("_meta.l"), F.lit(side)).cast("int").alias("_x"),
        F.pmod(F.xxhash64("_meta.s"), F.lit(side)).cast("int").alias("_y"),
        F.least(F.lit(side - 1), F.floor(F.log2(F.col("size")))).cast("int").alias("_z"),
        F.pmod("_g", F.lit(subs)).alias("_sub"),
        F.when(hot, F.col("_g")).otherwise(F.lit(0)).alias("_hot"),
        F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int").alias("_part"),
    )
    axes = ["_x", "_y", "_z"]
    # at most side**3 = 4096 cells
    curve = placed.select(*axes).distinct().withColumn("curve", hilbert_index(F.col("_x"), F.col("_y"), F.col("_z")))
    placed = written(placed.join(F.broadcast(curve), axes).drop(*axes), "shard-cells")

    bucket = ["curve", "_sub", "_hot", "_part"]
    sums = placed.groupBy(*bucket).agg(F.sum("size").alias("_b"), F.count("*").alias("_c"))

    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    cells = sums.groupBy("curve").agg(F.sum("_b").alias("_b"), F.sum("_c").alias("_c"))
    along = Window.orderBy("curve")
    cells = cells.select("curve", before("_b", along).alias("_cell_b"), before("_c", along).alias("_cell_c"))
    within = Window.partitionBy("curve").orderBy("_sub", "_hot", "_part")
    offsets = sums.select(*bucket, before("_b", within).alias("_off_b"), before("_c", within).alias("_off_c"))
    offsets = offsets.join(F.broadcast(cells), "curve").select(*bucket, (F.col("_off_b") + F.col("_cell_b")).alias("_off_b"), (F.col("_off_c") + F.col("_cell_c")).alias("_off_c"))
    # the parts of a hot group are neighbours: the group begins where the first of them does
    offsets = offsets.withColumn("_hot_from", F.min("_off_b").over(Window.partitionBy("curve", "_sub", "_hot")))

    row = Window.partitionBy(*bucket).orderBy("_g", "doc_id")
    group = Window.partitionBy(*bucket, "_g")
    out = placed.withColumn("_run", before("size", row)).withColumn("_row", F.row_number().over(row) - 1)
    out = out.withColumn("_g_from", F.min("_run").over(group)).withColumn("_g_size", F.col("_n") * F.col("size"))
    out = out.join(offsets, bucket)
    whole = (F.col("_n") > 1) & (F.col("_g_size") <= F.lit(tolerance * total / shards))
    begin = F.when(F.col("_hot") == 0, F.col("_off_b") + F.col("_g_from")).otherwise(F.col("_hot_from"))
    middle = F.when(whole, begin * 2 + F.col("_g_size")).otherwise((F.col("_off_b") + F.col("_run")) * 2 + F.col("size"))
    out = out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2 * total))).cast("int").alias("shard"),
        (F.col("_off_c") + F.col("_row")).cast("long").alias("_at"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
    out = written(out, "shard-out")
    # one row a shard
    first = out.groupBy("shard").agg(F.min("_at").alias("_from"))
    return out.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_at") - F.col("_from")).alias("slot"), "grown_shard", "curve")
