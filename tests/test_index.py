import random
import threading

import pytest
from pyspark.sql import functions as F

from memlake.operators import index as IX
from memlake.sources.versions import Conflict, VersionedTable, Versions

WORDS = ["deploy", "deployed", "deploying", "database", "databases", "café", "naïve", "連絡先", "go", "x1", "retrying", "retries", "zone"]


def texts(rng, ids):
    return {i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) for i in ids}


def made(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id int, text string")


def state(index):
    return {k: sorted(tuple(r) for r in index.live(index.rows(k)).select("term", "id", "tf", "dl").collect()) for k in IX.KINDS}


def test_deltas_equal_a_rebuild(spark, monkeypatch):
    monkeypatch.setattr(IX, "BUCKET_ROWS", 40)
    monkeypatch.setattr(IX, "PAGE", 4)
    rng = random.Random(3)
    now = texts(rng, range(40))
    index = IX.KeptIndex(spark).apply(made(spark, now))
    first = index.version
    before = state(index)
    for turn in range(3):
        change = texts(rng, rng.sample(range(60), 12)) | {i: None for i in rng.sample(range(40), 5)}
        index.apply(made(spark, change))
        now = {k: v for k, v in (now | change).items() if v is not None}
        fresh = IX.KeptIndex(spark).apply(made(spark, now))
        assert state(index) == state(fresh) and index.facts == fresh.facts and index.facts["n"] == len(now)
    assert state(index.merge()) == state(fresh) and len({p["segment"] for p in index.parts}) == 1
    assert state(IX.KeptIndex(spark, index.files.path, first)) == before  # an older version is still what it was
    # prefixes against all terms, over several buckets and pages
    terms = {r.term for r in fresh.rows("stems").collect()}
    asked = ["deploi", "d", "連", "", "zz", "x1", "caf", "\U0010ffff"]
    for i in (index, fresh):
        got = {(r.prefix, r.term) for r in i.begins_with("stems", spark.createDataFrame([(a,) for a in asked], "prefix string")).collect()}
        assert got == {(a, t) for a in asked for t in terms if t.startswith(a)}
    holders = {(r.word, r.id): r.tf for r in index.holders(spark.createDataFrame([(w,) for w in ("ploy", "o", "go", "é", "base d", "nowhere", "連絡")], "word string")).collect()}
    folded = {r.id: r.folded for r in index.docs().collect()}
    assert holders == {(w, i): f.count(w) for w in ("ploy", "o", "go", "é", "base d", "nowhere", "連絡") for i, f in folded.items() if w in f}


def test_reads_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(IX, "BUCKET_ROWS", 10)
    index = IX.KeptIndex(spark).apply(made(spark, texts(random.Random(1), range(80))))
    assert index.rows("stems").select("bucket").distinct().count() > 5
    rows = index.postings("stems", index.begins_with("stems", spark.createDataFrame([("zone",)], "prefix string")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "CartesianProduct" not in plan
    dictionary = index.begins_with("stems", spark.createDataFrame([("zone",)], "prefix string"))._jdf.queryExecution().executedPlan().toString()
    assert "substring" not in dictionary.lower() and "CartesianProduct" not in dictionary


def test_empty_index(spark):
    none = spark.createDataFrame([], "id int, text string")
    index = IX.KeptIndex(spark).apply(none)
    assert state(index) == {"stems": [], "grams": []} and index.facts["n"] == 0
    index.apply(made(spark, {1: "zone"})).apply(made(spark, {1: None}))
    assert state(index) == {"stems": [], "grams": []} and state(index.merge()) == state(index)


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, "id", "kind", f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "b", "z")], "id int, kind string, v string")
    assert table.read() is None and table.commit(rows) == 1
    table.files.pin("backup", 1)
    assert table.commit(spark.createDataFrame([(3, "a", "new"), (4, "c", "w")], rows.schema)) == 2
    read = lambda **k: sorted(tuple(r) for r in table.read(**k).select("id", "kind", "v").collect())
    assert read() == [(1, "a", "x"), (2, "b", "y"), (3, "a", "new"), (4, "c", "w")]
    assert read(version=1) == read(pin="backup") == [(1, "a", "x"), (2, "b", "y"), (3, "b", "z")]
    with pytest.raises(Conflict):
        table.commit(rows, base=1)  # somebody else has published 2
    assert table.files.versions() == [1, 2]
    # a commit that is torn before its manifest counts for nothing, and its folder goes
    table.files.stage(rows, "kind")
    assert len(read()) == 4
    for k in range(3):
        table.commit(spark.createDataFrame([(10 + k, "c", "n")], rows.schema))
    gone, folders = table.files.expire(2)
    assert table.files.versions() == [1, 4, 5] and gone == 2 and folders >= 1
    assert read(pin="backup") == [(1, "a", "x"), (2, "b", "y"), (3, "b", "z")] and len(read()) == 7
    table.files.unpin("backup")
    table.files.expire(1)
    assert table.files.versions() == [5] and len(read()) == 7
    plan = table.read().where("kind = 'c'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_one_of_many_writers_wins(spark, tmp_path):
    files, won = Versions(spark, f"file://{tmp_path}/v"), []

    def write(k):
        try:
            files.publish([{"folder": str(k)}], 0)
            won.append(k)
        except Conflict:
            pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert files.versions() == [1] and files.manifest()["parts"][0]["folder"] in map(str, won)


def test_postings_are_by_block(spark):
    """A word of every document is a row a block of them, and totals count what is there; before, it was a row a document."""
    rows = {i: "zone retry" + " zone" * (i % 3) + (" 𐐷𐐷𐐲" if i % 2 else "") for i in range(200)}
    index = IX.KeptIndex(spark).apply(made(spark, rows).coalesce(1))
    for kind, term in (("stems", "zone"), ("grams", "zon")):
        assert index.stored(kind).where(f"term = '{term}'").count() == 4
    index.apply(made(spark, {0: None, 5: "retry", 300: "zone zone zone"}))
    left = (rows | {5: "retry", 300: "zone zone zone"}).items()
    for i in (index, index.merge()):
        got = {r.term: (r.df, r.tf) for r in i.totals("stems").collect()}
        assert got["zone"] == (199, sum(t.split().count("zone") for k, t in left if k)) and got["retri"] == (199, 199)
        assert {r.term: r.df for r in i.totals("grams").collect()}["zon"] == 199
    assert index.holders(spark.createDataFrame([("𐐷𐐷𐐲",)], "word string")).count() == 99  # letters outside the basic plane


def test_prefixes_are_dealt_over_tasks(spark, monkeypatch):
    """Buckets of few bytes are looked up in a task each, in parts of few prefixes; their sums are those of all terms, also where a term fills several buckets."""
    monkeypatch.setattr(IX, "BUCKET_ROWS", 12)
    monkeypatch.setattr(IX, "PREFIXES", 2)
    rows = {i: f"zone w{i % 20:02d} v{i}" for i in range(64)} | {i: "zone" for i in range(64, 200)}
    index = IX.KeptIndex(spark, kinds=("stems",)).apply(made(spark, rows))
    assert index.kinds == ("stems",) and {p["what"] for p in index.parts} == {"docs", "stems", "stems-pages", "stems-bounds"}
    assert index.rows("stems").where("term = 'zone'").select("bucket").distinct().count() > 1
    asked = spark.createDataFrame([(p,) for p in ("", "w", "w1", "w17", "v", "v19", "zone", "zones", "x", None)], "prefix string")
    met = index.begins_with("stems", asked)
    assert met.rdd.getNumPartitions() >= index.stored("stems-bounds").count() > 5

    def totals(i):
        df = {r.term: r.df for r in i.begins_with("stems", spark.createDataFrame([("",)], "prefix string")).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        return {(p, len(t), sum(df[x] for x in t), min(t)) for p in ("", "w", "w1", "w17", "v", "v19", "zone", "zones", "x") if (t := [x for x in df if x.startswith(p)])}

    assert {tuple(r) for r in index.prefix_totals("stems", asked).collect()} == totals(index)
    index.apply(made(spark, {7: "zone w01", 500: "zoned"}))
    assert index.kinds == ("stems",) and {tuple(r) for r in index.prefix_totals("stems", asked).collect()} == totals(index)
    assert {r.term for r in index.merge().begins_with("stems", asked.where("prefix = 'w1'")).collect()} == {f"w1{k}" for k in range(10)}
