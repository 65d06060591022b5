"""Verdicts on documents as commits of a versioned registry: classify, supersede, fulfil, archive, restore.

A commit judges all its requests against the newest version, changes the
registry, adds an attestation for each that took effect and, for fulfilled
documents, the memories distilled from them; these three are published
together or not at all. Of several requests about one document the first, by
number, is judged; the others are told so, for the next commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators.ledger import TIERS
from memlake.operators.report import PROTECTED
from memlake.sources.scratch import written
from memlake.sources.versions import Tables

REGISTRY = "doc_id string, rel_path string, hash string, doc_type string, tier string, lifecycle string, type_source string, superseded_by string, fulfilled_by string"
ATTESTED = "doc_id string, seq long, verdict string, hash string, prior string, origin string"
MEMORIES = "memory_id string, doc_id string, doc_tier string, text string"
#: seq, verdict (classify, supersede, fulfill, archive or restore), path; doc_type and tier to classify, successor (a path) to supersede, facts and evidence to fulfil.
REQUESTS = "seq long, verdict string, path string, doc_type string, tier string, successor string, facts array<string>, evidence string"
KIND = r"^[A-Za-z0-9][A-Za-z0-9 ._-]{0,39}$"


class Registry:
    """Below ``path``; ``archive_dir`` is where archived documents go."""

    def __init__(self, spark: SparkSession, path: str | None = None, archive_dir: str = "docs/archive"):
        self.tables, self.archive_dir = Tables(spark, path), archive_dir.rstrip("/")

    def start(self, registry: DataFrame) -> int:
        """The first version, of rows REGISTRY."""
        parts = self.tables.change([], "registry", "doc_id", REGISTRY, registry.select("doc_id").limit(0), registry.select(*[c.split()[0] for c in REGISTRY.split(", ")]))
        return self.tables.publish(parts, 0)

    def _read(self, what: str, schema: str, version: int | None, pin: str | None) -> DataFrame:
        version = self.tables.pinned()[pin] if pin else version
        return self.tables.rows(self.tables.manifest(version)["parts"], what, schema)

    def registry(self, version: int | None = None, pin: str | None = None) -> DataFrame:
        return self._read("registry", REGISTRY, version, pin)

    def attestations(self, version: int | None = None, pin: str | None = None) -> DataFrame:
        return self._read("attested", ATTESTED, version, pin)

    def memories(self, version: int | None = None, pin: str | None = None) -> DataFrame:
        return self._read("memories", MEMORIES, version, pin)

    def commit(self, requests: DataFrame) -> DataFrame:
        """Judges rows REQUESTS in one version; returns ``seq, path, action``.

        action: classified, unchanged (the same verdict on the same content was
        given before), superseded, fulfilled, archived, restored; refused (to
        archive T0 and T1); missing (no such document, or to restore one that
        isn't archived); invalid (a type or tier of the wrong form, nothing
        distilled); later (another request about the document came first).
        """
        t, base = self.tables, self.tables.newest()
        parts = t.manifest(base)["parts"]
        docs = t.rows(parts, "registry", REGISTRY)
        asked = requests.select(*[c.split()[0] for c in REQUESTS.split(", ")]).withColumn("rel_path", F.replace("path", F.lit("\\"), F.lit("/")))
        asked = asked.join(docs.withColumnsRenamed({"doc_type": "old_type", "tier": "old_tier"}), "rel_path", "left")
        by = docs.select(F.col("rel_path").alias("successor"), F.col("doc_id").alias("by_id"))
        asked = asked.join(by, "successor", "left")
        verdict = F.when(F.col("verdict") == "classify", F.concat_ws(":", F.lit("classify"), F.trim("doc_type"), "tier")).otherwise(F.col("verdict"))
        asked = asked.withColumn("said", verdict)
        given = t.rows(parts, "attested", ATTESTED)
        before = given.where("verdict like 'classify:%'").select("doc_id", F.col("verdict").alias("said"), "hash", F.lit(True).alias("again")).distinct()
        last = given.where("verdict = 'archived'").groupBy("doc_id").agg(F.max_by(F.struct("prior", "origin"), "seq").alias("before"))
        asked = asked.join(before, ["doc_id", "said", "hash"], "left").join(last, "doc_id", "left")
        first = F.row_number().over(Window.partitionBy(F.coalesce("doc_id", "path")).orderBy("seq")) == 1
        shape = F.coalesce(F.trim("doc_type").rlike(KIND), F.lit(False)) & (F.col("tier").isNull() | F.col("tier").isin(*TIERS))
        action = (
            F.when((F.col("verdict") == "classify") & ~shape, "invalid")
            .when((F.col("verdict") == "fulfill") & (F.coalesce(F.size("facts"), F.lit(0)) <= 0), "invalid")
            .when(~F.coalesce(F.col("verdict").isin("classify", "supersede", "fulfill", "archive", "restore"), F.lit(False)), "invalid")
            .when(F.col("doc_id").isNull() | ((F.col("verdict") == "supersede") & F.col("by_id").isNull()) | ((F.col("verdict") == "restore") & (F.col("lifecycle") != "archived")), "missing")
            .when(~F.col("first"), "later")
            .when(F.col("again"), "unchanged")
            .when((F.col("verdict") == "archive") & F.col("old_tier").isin(*PROTECTED), "refused")
            .otherwise(F.element_at(F.create_map(*[F.lit(x) for x in ("classify", "classified", "supersede", "superseded", "fulfill", "fulfilled", "archive", "archived", "restore", "restored")]), F.col("verdict")))
        )
        judged = written(asked.withColumn("first", first).withColumn("action", action), "verdicts")
        took = judged.where("action in ('classified', 'superseded', 'fulfilled', 'archived', 'restored')")
        was = F.col("action")
        lifecycle = F.when(was.isin("superseded", "fulfilled", "archived"), was).when(was == "restored", F.coalesce("before.prior", F.lit("active"))).otherwise(F.col("lifecycle"))
        place = F.when(was == "archived", F.concat_ws("/", F.lit(self.archive_dir), "rel_path")).when(was == "restored", F.coalesce("before.origin", "rel_path")).otherwise(F.col("rel_path"))
        ids = F.transform(F.sequence(F.lit(1), F.size("facts")), lambda i: F.concat_ws("-", "doc_id", F.col("seq").cast("string"), i.cast("string")))
        new = took.select(
            "doc_id",
            place.alias("rel_path"),
            "hash",
            F.when(was == "classified", F.trim("doc_type")).otherwise(F.col("old_type")).alias("doc_type"),
            F.when(was == "classified", F.coalesce("tier", "old_tier")).otherwise(F.col("old_tier")).alias("tier"),
            lifecycle.alias("lifecycle"),
            F.when(was == "classified", "agent").otherwise(F.col("type_source")).alias("type_source"),
            F.when(was == "superseded", F.col("by_id")).otherwise(F.col("superseded_by")).alias("superseded_by"),
            F.when(was == "fulfilled", F.to_json(F.struct("evidence", ids.alias("memory_ids")))).otherwise(F.col("fulfilled_by")).alias("fulfilled_by"),
        )
        said = took.select("doc_id", "seq", F.when(was == "classified", F.col("said")).otherwise(was).alias("verdict"), "hash", F.col("lifecycle").alias("prior"), F.col("rel_path").alias("origin"))
        memories = took.where("action = 'fulfilled'").select("doc_id", F.col("old_tier").alias("doc_tier"), F.posexplode(F.arrays_zip(ids.alias("id"), F.col("facts").alias("text"))).alias("n", "f"))
        parts = t.change(parts, "registry", "doc_id", REGISTRY, took.select("doc_id"), new)
        parts = t.change(parts, "attested", "doc_id", ATTESTED, took.select("doc_id").limit(0), said)
        parts = t.change(parts, "memories", "doc_id", MEMORIES, took.select("doc_id").limit(0), memories.select(F.col("f.id").alias("memory_id"), "doc_id", "doc_tier", F.col("f.text").alias("text")))
        t.publish(parts, base)
        return judged.select("seq", "path", "action")


def rescanned(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Registry rows after a scan found (rel_path, hash, doc_type, tier, type_source): types and tiers that a person or a reviewer has set stay."""
    own = F.col("r.type_source").isin("agent", "user")
    both = registry.alias("r").join(found.alias("f"), F.col("r.rel_path") == F.col("f.rel_path"), "left")
    pick = lambda c: F.when(own | F.col("f.rel_path").isNull(), F.col(f"r.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
    return both.select("r.doc_id", "r.rel_path", F.coalesce("f.hash", "r.hash").alias("hash"), pick("doc_type"), pick("tier"), "r.lifecycle", pick("type_source"), "r.superseded_by", "r.fulfilled_by")
