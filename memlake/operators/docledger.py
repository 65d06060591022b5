"""The document ledger kept between scans: what a change of some files makes anew, and no more.

Tables: files (path, hash), docs (task boxes), refs (a document's references),
targets (which documents refer to a path), words (which words a file has) and
dead (a document's dead references). A scan drops files whose content is the
same, reads references and words of the changed ones, and judges anew the
references of changed documents and of documents that refer to a changed
path. All tables are published as one version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators import ledger as L
from memlake.sources.scratch import written
from memlake.sources.versions import Tables

#: Symbols that are looked up a document, the first in order.
PROBES = 8
FILES, DOCS = "path string, hash string", "path string, checked int, total int, ratio double"
REFS, TARGETS = "path string, place int, kind string, value string, target string", "target string, path string"
WORDS, DEAD = "path string, word string", "path string, dead_files long, dead_symbols long"


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def references(docs: DataFrame) -> DataFrame:
    """Rows REFS of documents (path, text)."""
    each = docs.select("path", F.posexplode(L.extract_refs(F.col("text"))).alias("place", "r"))
    return each.select("path", "place", "r.kind", "r.value", F.when(F.col("r.kind").isin("file", "doc", "symbol"), F.substring_index("r.value", "::", 1)).alias("target"))


def dead_references(refs: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """``path, dead_files, dead_symbols`` of the documents of refs.

    A file is dead if it isn't there; a symbol, of the first PROBES, if its
    file isn't there or has no such word.
    """
    nth = F.row_number().over(Window.partitionBy("path", "kind").orderBy("place"))
    asked = refs.where("target is not null").withColumn("nth", nth).where((F.col("kind") != "symbol") | (F.col("nth") <= PROBES))
    there = files.select(F.col("path").alias("target"), F.lit(True).alias("there"))
    has = known.select(F.col("path").alias("target"), "word", F.lit(True).alias("has"))
    word = F.when(F.col("kind") == "symbol", F.substring_index("value", "::", -1))
    judged = asked.withColumn("word", word).join(there, "target", "left").join(has, ["target", "word"], "left")
    file, symbol = (F.col("kind") != "symbol") & F.col("there").isNull(), (F.col("kind") == "symbol") & (F.col("there").isNull() | F.col("has").isNull())
    counts = judged.groupBy("path").agg(F.count_if(file).alias("dead_files"), F.count_if(symbol).alias("dead_symbols"))
    return refs.select("path").distinct().join(counts, "path", "left").select("path", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("dead_files", "dead_symbols")])


class DocLedger:
    """Below ``path``; documents are the files whose name ends in .md."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.tables = Tables(spark, path)

    def scan(self, files: DataFrame) -> dict:
        """Takes changes (path, text; one row a path, a null text says that the file is gone); returns how many were new, changed, gone and the same, and how many documents were judged."""
        t, base = self.tables, self.tables.newest()
        parts = t.manifest(base)["parts"]
        seen = files.select("path", "text", F.sha2("text", 256).alias("hash"))
        known = t.near(parts, "files", "path", FILES, files.select("path")).withColumnRenamed("hash", "old")
        # texts are few bytes and much work: they are dealt out to all cores, and stay so
        both = written(seen.join(known, "path", "left").repartition(2 * self.spark.sparkContext.defaultParallelism, "path"), "ledger-seen")
        counts = both.selectExpr("count_if(old is null and hash is not null)", "count_if(old <> hash)", "count_if(old is not null and hash is null)", "count_if(old = hash)").first()
        changed = both.where("not (old <=> hash)")
        paths, left = changed.select("path"), changed.where("text is not null")
        here = t.buckets(paths, "path")  # the folders of all that is kept by path
        docs = left.where("path like '%.md'")
        refs = written(references(docs), "ledger-refs")
        box = L.checkboxes(F.col("text"))
        old_refs = written(t.near(parts, "refs", "path", REFS, paths, here), "ledger-old-refs")
        aims = lambda r: r.where("target is not null").select("target", "path").distinct()
        was, now = aims(old_refs), aims(refs)
        near = was.select("path").unionByName(docs.select("path")).unionByName(t.near(parts, "targets", "target", TARGETS, paths.withColumnRenamed("path", "target")).select("path"))
        parts = t.change(parts, "files", "path", FILES, paths, left.select("path", "hash"), here)
        parts = t.change(parts, "docs", "path", DOCS, paths, docs.select("path", box["checked"].alias("checked"), box["total"].alias("total"), box["ratio"].alias("ratio")), here)
        parts = t.change(parts, "refs", "path", REFS, paths, refs, here)
        parts = t.change(parts, "targets", "target", TARGETS, was, now)
        parts = t.change(parts, "words", "path", WORDS, paths, left.select("path", F.explode(words(F.col("text"))).alias("word")), here)
        # documents that changed, or refer to what changed; those that went have no row in docs
        near = written(near.distinct(), "ledger-near")
        judged = written(t.near(parts, "docs", "path", DOCS, near).select("path"), "ledger-judged")
        own = written(t.near(parts, "refs", "path", REFS, judged), "ledger-own")
        targets = own.where("target is not null").select(F.col("target").alias("path"))
        there, has = t.near(parts, "files", "path", FILES, targets), t.near(parts, "words", "path", WORDS, own.where("kind = 'symbol'").select(F.col("target").alias("path")))
        dead = judged.join(dead_references(own, there, has), "path", "left").na.fill(0, ["dead_files", "dead_symbols"])
        again = judged.unionByName(paths)
        parts = t.change(parts, "dead", "path", DEAD, again, dead, t.buckets(again, "path"))
        t.publish(parts, base)
        return dict(zip(("new", "changed", "gone", "same"), counts, strict=True)) | {"judged": judged.count()}

    def signals(self, version: int | None = None) -> DataFrame:
        """``path, checked, total, ratio, dead_files, dead_symbols`` of all documents."""
        parts = self.tables.manifest(version)["parts"]
        return self.tables.rows(parts, "docs", DOCS).join(self.tables.rows(parts, "dead", DEAD), "path")

    def references_by_value(self, version: int | None = None) -> DataFrame:
        """``value, docs``: how many documents of the ledger refer to each path, address, symbol and issue."""
        parts = self.tables.manifest(version)["parts"]
        return self.tables.rows(parts, "refs", REFS).join(self.tables.rows(parts, "docs", DOCS).select("path"), "path").groupBy("value").agg(F.count_distinct("path").alias("docs"))
