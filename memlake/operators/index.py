"""A search index that is kept: segments of postings by stem and by trigram, changed by deltas and tombstones, merged now and then.

Documents get a block of up to 64 and a place in it when they are indexed. A
posting is a row for a term and a block: a mask of the places that have the
term and, where some document has it more than once, how often each has it. So
there are far fewer rows than documents have terms, and what is alive is a mask
a block too.

A segment has postings in buckets, which are ranges of the sorted terms, and a
dictionary: pages of up to PAGE terms in order, with the first and last term
of each. Words that begin with a prefix lie between the prefix and the prefix
followed by the last character there is. The bounds of the buckets say in
which of them that is, and a task looks the prefixes of a bucket up in the
bucket's sorted terms; only those buckets are read.

A change of a document writes a new segment and a tombstone, which hides the
document's rows in all earlier segments. Merging writes all live rows as one
segment. Every state is a version (``sources.versions``): readers of an older
one aren't disturbed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import unicode as U
from memlake.sources.scratch import drop, written
from memlake.sources.versions import Versions

KINDS = ("stems", "grams")
#: Postings of a bucket, buckets of a segment at most (their bounds are broadcast), terms of a page.
BUCKET_ROWS, MOST_BUCKETS, PAGE = 200_000, 100_000, 64
#: Buckets that a read names in its partition filter; a read of more goes by a join alone.
NAMED_BUCKETS = 2_000
#: Tombstones that are broadcast, by count.
BROADCAST_DEAD = 1_000_000
#: Prefixes that are looked up in a bucket together.
PREFIXES = 50_000
#: Tasks of a look-up at most.
MOST_TASKS = 4_096
#: Documents of a block (bits of a mask); documents and characters that a task looks at together; stems that it remembers.
PLACES, AT_ONCE, CHARACTERS, KNOWN = 64, 512, 1 << 21, 500_000
POSTING = "term string, block long, mask long, tfs array<int>"


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def word_trigrams(word: Column) -> Column:
    """As ``trigrams``, by whole characters outside the basic plane too; for short texts."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda i: F.substr(word, i, F.lit(3))))


def _masks(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each begins, and all bits of each."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, keys[starts], np.bitwise_or.reduceat(bits, starts)


def _gram_keys(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers, two ends after it, so that every character begins one."""
    codes = np.frombuffer((text + "\0\0").encode("utf-32-le"), np.uint32).astype(np.int64)
    parts = [codes[k : k + CHARACTERS + 2] for k in range(0, max(0, len(codes) - 2), CHARACTERS)]
    found = [np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) for c in parts]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))


def _gram_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of trigrams of documents (block, place, folded), documents of a block together."""

    def made(block: int, keys: list[np.ndarray], places: list[int]) -> pa.RecordBatch:
        every = np.concatenate([*keys, np.zeros(0, np.int64)])
        bits = np.repeat(np.left_shift(np.uint64(1), np.array(places, np.uint64)), [len(k) for k in keys])
        order = np.argsort(every, kind="stable")
        terms, masks = [], np.zeros(0, np.uint64)
        if len(every):
            _, found, masks = _masks(every[order], bits[order])
            codes = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], 1).astype("<u4")
            text = codes.tobytes().decode("utf-32-le")
            terms = [text[k : k + 3] for k in range(0, len(text), 3)]
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(np.full(len(terms), block), pa.int64()), pa.array(masks.view(np.int64)), pa.nulls(len(terms), pa.list_(pa.int32()))], names=["term", "block", "mask", "tfs"])

    here, keys, places = None, [], []
    for batch in batches:
        for block, place, text in zip(batch.column("block").to_pylist(), batch.column("place").to_pylist(), batch.column("folded"), strict=True):
            if keys and (block != here or sum(map(len, keys)) > CHARACTERS):
                yield made(here, keys, places)
                keys, places = [], []
            here = block
            keys.append(_gram_keys(text.as_py()))
            places.append(place)
    if keys:
        yield made(here, keys, places)


def _stem_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of stems of documents (block, place, terms)."""
    known: dict[str, str] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(at, AT_ONCE)
            lists = batch.column("terms")
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            if not words:
                continue
            if len(known) > KNOWN:
                known.clear()
            coded_stems = pa.array([known.get(w) or known.setdefault(w, U.porter_stem(w)) for w in words], pa.string()).dictionary_encode()
            stems, code = coded_stems.dictionary, coded_stems.indices.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            blocks, block = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            key = (block[row] * len(stems) + code[coded.indices.to_numpy()].astype(np.int64)) * PLACES + batch.column("place").to_numpy()[row]
            key, tf = np.unique(key, return_counts=True)
            starts, found, masks = _masks(key // PLACES, np.left_shift(np.uint64(1), (key % PLACES).astype(np.uint64)))
            ends = np.append(starts, len(key)).astype(np.int32)
            once = np.maximum.reduceat(tf, starts) == 1
            tfs = pa.ListArray.from_arrays(pa.array(ends), pa.array(tf, pa.int32()), mask=pa.array(once))
            yield pa.RecordBatch.from_arrays([stems.take(pa.array(found % len(stems))), pa.array(blocks[found // len(stems)], pa.int64()), pa.array(masks.view(np.int64)), tfs], names=["term", "block", "mask", "tfs"])


def _met(bounds: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The buckets whose terms may begin with a prefix; bounds: segment, bucket, lo, hi of each. ``again``: the bucket's first term is the last of the one before."""
    segments: dict[int, tuple[list, list, list]] = {}
    for segment, bucket, lo, hi in sorted(bounds):
        for column, x in zip(segments.setdefault(segment, ([], [], [])), (bucket, lo, hi), strict=True):
            column.append(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for prefix in batch.column("prefix").to_pylist():
                for segment, (bucket, lo, hi) in segments.items():
                    first = bisect_left(hi, prefix)
                    for k in range(first, bisect_right(lo, prefix, first, key=lambda t: t[: len(prefix)])):
                        out.append((prefix, segment, bucket[k], k > 0 and hi[k - 1] == lo[k]))
                        if len(out) >= PREFIXES:
                            yield _rows(out, MET)
                            out = []
            yield _rows(out, MET)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


MET = pa.schema([("prefix", pa.string()), ("segment", pa.int32()), ("bucket", pa.int32()), ("again", pa.bool_())])


def _looked_up(asked: pa.Table, pages: pa.Table) -> tuple[pa.Table, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: the prefixes, its terms and their counts, and from which to which term each prefix goes."""
    each = pages.sort_by("page").column("terms").combine_chunks().flatten()
    names, prefixes = each.field("term").to_pylist(), asked.column("prefix").to_pylist()
    low = [bisect_left(names, p) for p in prefixes]
    high = [bisect_right(names, p, a, key=lambda t: t[: len(p)]) for p, a in zip(prefixes, low, strict=True)]
    return asked, names, each.field("df").to_numpy(zero_copy_only=False), np.array(low, np.int64), np.array(high, np.int64)


def _each_term(asked: pa.Table, pages: pa.Table) -> pa.Table:
    asked, names, df, low, high = _looked_up(asked, pages)
    row = np.repeat(np.arange(len(low)), high - low)
    at = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
    row, terms = pa.array(row), pa.array(names, pa.string())
    return pa.table({**{c: asked.column(c).take(row) for c in ("prefix", "segment", "bucket")}, "term": terms.take(pa.array(at)), "df": pa.array(df[at], pa.int64())})


def _summed_terms(asked: pa.Table, pages: pa.Table) -> pa.Table:
    asked, names, df, low, high = _looked_up(asked, pages)
    some = high > low
    asked, low, high = asked.filter(pa.array(some)), low[some], high[some]
    sums = np.concatenate([[0], np.cumsum(df, dtype=np.int64)])
    seen = (low == 0) & asked.column("again").to_numpy()  # counted in the bucket before
    first = pa.array(names, pa.string()).take(pa.array(low))
    return pa.table({"prefix": asked.column("prefix"), "terms": pa.array(high - low - seen, pa.int64()), "df": pa.array(sums[high] - sums[low], pa.int64()), "first": first})


def _has(mask: Column, place: Column) -> Column:
    return F.bit_get(mask, place) == 1


def _places(mask: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda p: _has(mask, p))


class KeptIndex:
    """An index under a path; ``version`` reads a state other than the newest. A new one may have postings of some ``kinds`` only."""

    def __init__(self, spark: SparkSession, path: str | None = None, version: int | None = None, kinds: tuple[str, ...] = KINDS):
        self.files, self.kinds = Versions(spark, path), kinds
        self.at(version)

    def at(self, version: int | None = None) -> KeptIndex:
        self.version = self.files.newest() if version is None else version
        manifest = self.files.manifest(self.version)
        self.parts, self.facts = manifest["parts"], manifest["facts"]
        self.kinds = tuple(k for k in KINDS if any(p["what"] == k for p in self.parts)) or self.kinds
        return self

    # ---- reading

    def stored(self, what: str) -> DataFrame | None:
        """What all segments have of one kind as it is stored, with the number of the segment; hidden rows too."""
        out = None
        for p in self.parts:
            if p["what"] == what:
                one = self.files.load(p).withColumn("segment", F.lit(p["segment"]))
                out = one if out is None else out.unionByName(one)
        return out

    def rows(self, what: str) -> DataFrame | None:
        """As ``stored``; postings with a row ``term, id, tf, dl`` for each document."""
        return self._spread(self.stored(what)) if what in KINDS else self.stored(what)

    def _spread(self, postings: DataFrame) -> DataFrame:
        """Stored postings (with other columns) as a row a document."""
        one = postings.withColumn("at", F.explode(F.arrays_zip(_places(F.col("mask")).alias("place"), F.coalesce("tfs", F.array().cast("array<int>")).alias("tf"))))
        one = one.withColumn("place", F.col("at.place")).withColumn("tf", F.coalesce("at.tf", F.lit(1)).cast("long")).drop("at", "mask", "tfs")
        return one.join(self.stored("docs").select("segment", "block", "place", "id", "dl"), ["segment", "block", "place"]).drop("block", "place")

    def _alive(self, postings: DataFrame) -> DataFrame:
        """Stored postings of documents that are there, none empty."""
        if self.stored("dead") is None:
            return postings
        alive = self.live(self.stored("docs").select("id", "segment", "block", "place"))
        alive = alive.groupBy("segment", "block").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("alive"))  # a row a block
        both = postings.join(alive, ["segment", "block"]).withColumn("left", F.col("mask").bitwiseAND(F.col("alive"))).where("left <> 0")
        kept = F.transform(F.filter(F.arrays_zip(_places(F.col("mask")).alias("place"), F.col("tfs").alias("tf")), lambda x: _has(F.col("left"), x["place"])), lambda x: x["tf"])
        tfs = F.when(F.col("left") == F.col("mask"), F.col("tfs")).when(F.col("tfs").isNotNull(), kept)
        return both.withColumn("tfs", tfs).withColumn("mask", F.col("left")).drop("left", "alive")

    def totals(self, kind: str) -> DataFrame:
        """``term, df, tf``: in how many documents that are there each term is, and how often."""
        tf = F.coalesce(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x), F.bit_count("mask").cast("long"))
        return self._alive(self.stored(kind)).groupBy("term").agg(F.sum(F.bit_count("mask")).alias("df"), F.sum(tf).alias("tf"))

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (id, segment) that no later tombstone hides."""
        dead = self.stored("dead")
        if dead is None:
            return rows
        dead = dead.groupBy(F.col("id").alias("dead_id")).agg(F.max("segment").alias("dead_at"))
        few = sum(p["rows"] for p in self.parts if p["what"] == "dead") <= BROADCAST_DEAD
        return rows.join(F.broadcast(dead) if few else dead, (F.col("id") == F.col("dead_id")) & (F.col("segment") < F.col("dead_at")), "left_anti")

    def docs(self) -> DataFrame:
        """``id, folded, terms, dl`` of the documents that are there."""
        return self.live(self.stored("docs")).withColumn("terms", U.tokens_of(F.col("folded"))).select("id", "folded", "terms", "dl")

    def begins_with(self, kind: str, prefixes: DataFrame) -> DataFrame:
        """``prefix, segment, bucket, term, df``: the terms that begin with each distinct ``prefix``, by segment and bucket (a hot term has several); df counts hidden documents too."""
        return self._in_buckets(kind, prefixes, _each_term, "prefix string, segment int, bucket int, term string, df long")

    def prefix_totals(self, kind: str, prefixes: DataFrame) -> DataFrame:
        """``prefix, terms, df, first``: of the terms that begin with each distinct ``prefix`` how many there are, the sum of their df, and the first."""
        if len({p["segment"] for p in self.parts}) > 1:  # a term may be in several
            return self.begins_with(kind, prefixes).groupBy("prefix").agg(F.count_distinct("term").alias("terms"), F.sum("df").alias("df"), F.min("term").alias("first"))
        sums = self._in_buckets(kind, prefixes, _summed_terms, "prefix string, terms long, df long, first string")
        return sums.groupBy("prefix").agg(F.sum("terms").alias("terms"), F.sum("df").alias("df"), F.min("first").alias("first"))

    def _in_buckets(self, kind: str, prefixes: DataFrame, look_up: Callable, out: str) -> DataFrame:
        """look_up of each bucket's prefixes and pages."""
        bounds = [tuple(r) for r in self.stored(f"{kind}-bounds").select("segment", "bucket", "lo", "hi").collect()]  # at most MOST_BUCKETS a segment
        met = written(prefixes.select("prefix").where("prefix is not null").mapInArrow(_met(bounds), "prefix string, segment int, bucket int, again boolean"), "index-met")
        here = ["segment", "bucket"]
        parts = written(met.groupBy(*here).agg(F.ceil(F.count("*") / PREFIXES).cast("int").alias("parts")), "index-met-parts")  # a row a bucket
        asked = met.join(F.broadcast(parts), here).withColumn("part", F.pmod(F.xxhash64("prefix"), F.col("parts")).cast("int"))
        pages = self.stored(f"{kind}-pages").select(*here, "page", "terms").join(F.broadcast(parts), here).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # by their number, not by their size: few bytes are much work
        tasks = max(1, min(MOST_TASKS, parts.agg(F.sum("parts")).first()[0] or 0))
        cells = [df.drop("parts").repartition(tasks, *here, "part").groupBy(*here, "part") for df in (asked, pages)]
        return cells[0].cogroup(cells[1]).applyInArrow(look_up, out)

    def postings(self, kind: str, terms: DataFrame) -> DataFrame:
        """``prefix, id, tf, dl`` of the live postings of what ``begins_with`` found."""
        terms = written(terms.select("prefix", "segment", "bucket", "term"), "index-terms")
        needed = terms.select("segment", "bucket").distinct().limit(NAMED_BUCKETS + 1).collect()
        rows = self.stored(kind)
        if len(needed) <= NAMED_BUCKETS:  # whole folders are left out
            here = F.lit(False)
            for segment in sorted({r["segment"] for r in needed}):
                here = here | ((F.col("segment") == segment) & F.col("bucket").isin(*[r["bucket"] for r in needed if r["segment"] == segment]))
            rows = rows.where(here)
        return self.live(self._spread(rows.join(terms, ["segment", "bucket", "term"]))).select("prefix", "id", "tf", "dl")

    def holders(self, words: DataFrame) -> DataFrame:
        """``word, id, tf, dl``: the documents whose folded text holds each distinct ``word`` somewhere, how often (apart), and the text's trigrams.

        Of a word's trigrams the one in the fewest documents finds the
        candidates, for a shorter word all trigrams that begin with it; their
        texts are searched.
        """
        grams = words.select("word", F.explode(F.when(F.length("word") < 3, F.array("word")).otherwise(word_trigrams(F.col("word")))).alias("prefix"))
        found = written(self.begins_with("grams", grams.select("prefix").distinct()), "index-grams")
        count = found.groupBy("prefix").agg(F.sum("df").alias("n"))
        rarest = grams.join(count, "prefix").groupBy("word").agg(F.min_by("prefix", F.struct("n", "prefix")).alias("prefix"), F.count("*").alias("met"))
        # a word of which some trigram is nowhere is nowhere
        wanted = grams.groupBy("word").agg(F.count("*").alias("grams"))
        rarest = written(rarest.join(wanted, "word").where("met = grams").select("word", "prefix"), "index-rarest")
        rows = self.postings("grams", found.join(rarest.select("prefix").distinct(), "prefix", "left_semi")).select("prefix", "id").distinct()
        candidates = rows.join(rarest, "prefix").select("word", "id").join(self.docs().select("id", "folded"), "id")
        tf = (F.length("folded") - F.length(F.replace(F.col("folded"), F.col("word"), F.lit("")))) / F.length("word")
        return candidates.where(F.contains("folded", "word")).select("word", "id", tf.alias("tf"), (F.length("folded") - 2).alias("dl"))

    # ---- writing

    def _segment(self, number: int, docs: dict, postings: dict[str, DataFrame], dead: DataFrame | None) -> list[dict]:
        """Stages a segment; docs: its staged part; postings: POSTING by kind."""
        out = [docs]
        for kind, rows in postings.items():
            rows = written(rows, f"index-{kind}")
            buckets = max(1, min(MOST_BUCKETS, -(-(rows.agg(F.sum(F.bit_count("mask"))).first()[0] or 0) // BUCKET_ROWS)))
            # by term and block: the rows of a hot term are several buckets
            dealt = rows.repartitionByRange(buckets, "term", "block").withColumn("bucket", F.spark_partition_id()).sortWithinPartitions("bucket", "term", "block")
            part = self.files.stage(dealt, "bucket")
            drop(rows)
            terms = self.files.load(part).groupBy("bucket", "term").agg(F.sum(F.bit_count("mask")).alias("df"))
            page = F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("term")) - 1) / PAGE).cast("int")
            pages = self.files.stage(terms.withColumn("page", page).groupBy("bucket", "page").agg(F.min("term").alias("lo"), F.max("term").alias("hi"), F.sort_array(F.collect_list(F.struct("term", "df"))).alias("terms")))
            bounds = self.files.stage(self.files.load(pages).groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
            out += [p | {"what": what, "segment": number} for what, p in ((kind, part), (f"{kind}-pages", pages), (f"{kind}-bounds", bounds))]
        if dead is not None:
            dead = self.files.stage(dead)
            out.append(dead | {"what": "dead", "segment": number, "rows": self.files.load(dead).count()})
        return out

    def _publish(self, parts: list[dict]) -> KeptIndex:
        base, self.parts = self.version, parts
        n, dl, n3, gl = self.live(self.stored("docs")).agg(F.count("*"), F.sum("dl"), F.count_if(F.length("folded") >= 3), F.sum(F.when(F.length("folded") >= 3, F.length("folded") - 2))).first()
        return self.at(self.files.publish(parts, base, {"n": n, "mean": (dl or 0) / max(1, n) or 1.0, "mean_grams": (gl or 0) / max(1, n3) or 1.0}))

    def apply(self, changes: DataFrame) -> KeptIndex:
        """Adds, replaces and (where ``text`` is null) removes documents: changes has one row ``id, text`` an id."""
        number = 1 + max((p["segment"] for p in self.parts), default=0)
        folded = changes.where("text is not null").select("id", F.coalesce(U.fold(F.col("text")), F.lit("")).alias("folded"))
        # blocks have numbers of their own, so that they can be merged as they are
        row = F.monotonically_increasing_id()
        block = F.lit(number).cast("long") * (1 << 44) + F.shiftright(row, 33) * (1 << 24) + F.shiftright(row.bitwiseAND(F.lit((1 << 33) - 1)), 6)
        docs = folded.select("id", "folded", F.size(U.tokens_of(F.col("folded"))).alias("dl"), block.alias("block"), row.bitwiseAND(F.lit(PLACES - 1)).cast("int").alias("place"))
        part = self.files.stage(docs) | {"what": "docs", "segment": number}
        docs = self.files.load(part)
        postings = {
            "stems": docs.select("block", "place", U.tokens_of(F.col("folded")).alias("terms")).mapInArrow(_stem_blocks, POSTING),
            "grams": docs.select("block", "place", "folded").mapInArrow(_gram_blocks, POSTING),
        }
        dead = changes.select("id") if number > 1 else None
        return self._publish([*self.parts, *self._segment(number, part, {k: postings[k] for k in self.kinds}, dead)])

    def merge(self) -> KeptIndex:
        """All live rows as one segment; nothing is read from texts again, and blocks stay as they are, less what is gone."""
        if not self.parts:
            return self
        number = 1 + max(p["segment"] for p in self.parts)
        docs = self.files.stage(self.live(self.stored("docs")).select("id", "folded", "dl", "block", "place")) | {"what": "docs", "segment": number}
        return self._publish(self._segment(number, docs, {k: self._alive(self.stored(k)).select("term", "block", "mask", "tfs") for k in self.kinds}, None))

    def todo(self, rows: DataFrame) -> DataFrame:
        """``id, todo`` against the active rows (id): 'add' what isn't indexed, 'remove' what isn't active."""
        there = self.live(self.stored("docs")).select("id")
        add = rows.select("id").join(there, "id", "left_anti").withColumn("todo", F.lit("add"))
        return add.unionByName(there.join(rows.select("id"), "id", "left_anti").withColumn("todo", F.lit("remove")))
