"""Tables with versions: folders of Parquet, and numbered manifests that name the folders of a version.

Data is staged first, under a name of its own, and counts for nothing until a
manifest names it. A manifest is written aside and renamed to its number,
which fails if the number is taken; so a commit is whole or isn't there, and
of two writers on the same base one is told so (where a rename to a name that
is taken fails at once, as on HDFS; a plain local disk has a short gap). A
version stays readable as long as its manifest is kept.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.sources.scratch import shared_dir


class Conflict(Exception):
    """Another writer has published on the same base."""


class Versions:
    """Manifests and folders below ``path``; version 0 is the empty one."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/memlake/versions-{uuid.uuid4().hex}").rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._jvm, self._place = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        for folder in ("manifests", "data", "pins"):
            self._fs.mkdirs(self._place(f"{self.path}/{folder}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._place(f"{self.path}/{folder}")))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._place(f"{self.path}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _rename_new(self, content: dict, name: str) -> bool:
        """Writes aside and renames; False if the name is taken."""
        aside = self._place(f"{self.path}/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._context.rename(aside, self._place(f"{self.path}/{name}"), options)
            return True
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("manifests") if n.isdigit()]

    def newest(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``parts`` (a list of dicts, each with its folder) and ``facts`` of a version, the newest by default."""
        version = self.newest() if version is None else version
        return self._read(f"manifests/{version:012d}") if version else {"parts": [], "facts": {}}

    def stage(self, df: DataFrame, *by: str) -> dict:
        """Writes df, in folders by the columns ``by``; returns the part (``folder, schema``) that a version may name."""
        folder = uuid.uuid4().hex
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.path}/data/{folder}")
        return {"folder": folder, "schema": df.schema.json()}

    def load(self, part: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(part["schema"]))).parquet(f"{self.path}/data/{part['folder']}")

    def publish(self, parts: list[dict], base: int, facts: dict | None = None) -> int:
        """The version after ``base``, of just these parts; raises Conflict if there is one already."""
        if not self._rename_new({"parts": parts, "facts": facts or {}}, f"manifests/{base + 1:012d}"):
            raise Conflict(f"version {base + 1} of {self.path} is there already")
        return base + 1

    def pin(self, name: str, version: int | None = None) -> int:
        """Keeps a version under a name."""
        version = self.newest() if version is None else version
        if not self._rename_new({"version": version}, f"pins/{name}"):
            raise Conflict(f"{name} is pinned already")
        return version

    def pinned(self) -> dict[str, int]:
        return {n: self._read(f"pins/{n}")["version"] for n in self._names("pins") if not n.startswith(".")}

    def unpin(self, name: str) -> None:
        self._fs.delete(self._place(f"{self.path}/pins/{name}"), False)

    def expire(self, keep: int) -> tuple[int, int]:
        """Forgets all versions but the ``keep`` newest and the pinned ones, then deletes folders that no version names; returns how many of both went.

        Folders that are staged meanwhile by others would go too: one writer at a time.
        """
        versions = self.versions()
        held = set(versions[-keep:] if keep else []) | set(self.pinned().values())
        gone = [v for v in versions if v not in held]
        for v in gone:
            self._fs.delete(self._place(f"{self.path}/manifests/{v:012d}"), False)
        used = {p["folder"] for v in self.versions() for p in self.manifest(v)["parts"]}
        unused = [f for f in self._names("data") if f not in used]
        for f in unused:
            self._fs.delete(self._place(f"{self.path}/data/{f}"), True)
        return len(gone), len(unused)


class VersionedTable:
    """Rows with a key, a column ``by`` that lays them into folders, and versions.

    A commit rewrites only the folders whose rows it changes; the others go on
    as they are, so a version costs what it changes.
    """

    def __init__(self, spark: SparkSession, key: str, by: str, path: str | None = None):
        self.files, self.key, self.by = Versions(spark, path), key, by

    def read(self, version: int | None = None, *, pin: str | None = None) -> DataFrame | None:
        """The rows of a version or of a pinned one; None if nothing was written yet."""
        version = self.files.pinned()[pin] if pin else version
        out = None
        for part in self.files.manifest(version)["parts"]:
            own = self.files.load(part).where(F.col(self.by).isin(part["values"]))
            out = own if out is None else out.unionByName(own)
        return out

    def commit(self, changes: DataFrame, base: int | None = None) -> int:
        """A new version in which rows of ``changes`` replace those with their key; all of them or none.

        A row may change its folder. Of rows with one key any may win: give one.
        """
        base = self.files.newest() if base is None else base
        parts = self.files.manifest(base)["parts"]
        old, touched = self.read(base), {r[0] for r in changes.select(self.by).distinct().collect()}  # folders are few
        rows = changes
        if old is not None:
            hit = old.join(changes.select(self.key), self.key, "left_semi").select(self.by).distinct()
            touched |= {r[0] for r in hit.collect()}
            kept = old.where(F.col(self.by).isin(*touched)).join(changes.select(self.key), self.key, "left_anti")
            rows = kept.unionByName(changes)
        new = self.files.stage(rows.repartition(F.col(self.by), F.pmod(F.xxhash64(self.key), F.lit(8))), self.by)
        left = [p | {"values": [v for v in p["values"] if v not in touched]} for p in parts]
        return self.files.publish([p for p in left if p["values"]] + [new | {"values": sorted(touched)}], base)


class Tables(Versions):
    """Several tables that are published together, each in folders by the hash of a column; a change rewrites the folders that it touches."""

    BUCKETS = 16
    #: Tasks that write a folder, at most; rows are dealt to them by all their columns, so a frequent key isn't one task's.
    SPREAD = 4

    def _bucketed(self, df: DataFrame, by: str) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(self.BUCKETS)).cast("int"))

    def rows(self, parts: list[dict], what: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        """A table's rows, or those of some of its folders."""
        # an empty table made from a list is a job of Python workers; one without rows by its filter is left out of the plan
        out = self.spark.createDataFrame([], schema).where(F.lit(False))
        for p in parts:
            if p["what"] == what and (here := [b for b in p["buckets"] if buckets is None or b in buckets]):
                out = out.unionByName(self.load(p).where(F.col("bucket").isin(*here)).drop("bucket"))
        return out

    def buckets(self, keys: DataFrame, by: str) -> set[int]:
        """The folders of the values of a column."""
        return {r[0] for r in self._bucketed(keys.select(by), by).select("bucket").distinct().collect()}

    def near(self, parts: list[dict], what: str, by: str, schema: str, keys: DataFrame, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a table whose column ``by`` is among keys (one column of that name); only their folders are read (``buckets``, where they are known)."""
        buckets = self.buckets(keys, by) if buckets is None else buckets
        return self.rows(parts, what, schema, buckets).join(keys.distinct(), by, "left_semi")

    def change(self, parts: list[dict], what: str, by: str, schema: str, gone: DataFrame, new: DataFrame, touched: set[int] | None = None) -> list[dict]:
        """The parts after rows that agree with ``gone`` in its columns (``by`` is one) went and ``new`` came; staged, not published.

        ``touched``: the folders of both, where they are known; else both are computed once more for them.
        """
        touched = self.buckets(gone.select(by).union(new.select(by)), by) if touched is None else touched
        if not touched:
            return parts
        left = self.rows(parts, what, schema, touched).join(gone.distinct(), gone.columns, "left_anti")
        rows = self._bucketed(left.unionByName(new), by)
        part = self.stage(rows.repartition("bucket", F.pmod(F.xxhash64(*left.columns), F.lit(self.SPREAD))), "bucket")
        kept = [p | {"buckets": [b for b in p["buckets"] if b not in touched]} if p["what"] == what else p for p in parts]
        return [p for p in kept if p["buckets"]] + [part | {"what": what, "buckets": sorted(touched)}]
