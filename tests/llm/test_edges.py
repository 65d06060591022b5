"""Null and repeated ids, empty and very long texts, ties, clashing columns, hot groups: defined results, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import near_dedup as N
from memlake.llm import packing as P
from memlake.llm.embedding_dedup import embedding_near_duplicates
from memlake.llm.exact_dedup import exact_dedup, without_copies
from memlake.llm.mixing import mix
from memlake.llm.sharding import hilbert_shards
from memlake.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string, lang string, source string, keep_id string, component string, _len int"


def prose(rng, n):
    return " ".join("w" + str(rng.randrange(400)) for _ in range(n))


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows (id, text): ids that are null or repeated with the same and other texts, near copies in chains, one long text."""
    rng = random.Random(21)
    a, b, c = (prose(rng, 120) for _ in range(3))
    texts = [(1, a), (2, a + " tail"), (2, b), (3, b + " end"), (4, c), (4, c), (None, a), (None, a), (None, c), (5, None), (5, ""), (6, " \t\n"), (7, "one"), (7, "ONE"), (8, c.upper()), (9, prose(rng, 400_000)), (10, "one two three four"), (11, "One Two Three Four")]
    # a group of near copies that is large beside the rest, and of exact ones
    texts += [(100 + k, a.replace("w1 ", f"v{k} ", 1) + f" x{k % 3}") for k in range(40)] + [(200 + k, b) for k in range(60)]
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"src{k % 3}", "x", "y", 0) for k, (i, t) in enumerate(texts)], SCHEMA)


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_exact(odd):
    rows = rows_of(odd)
    same = {}
    for i, t in rows:
        same.setdefault(lower(t), []).append(i)
    for full in (True, False):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd, fingerprint_all=full).collect())
        want = Counter()
        for i, t in rows:
            ids = [x for x in same[lower(t)] if x is not None]
            keep = max(ids) if ids else None
            want[i, keep if ids else i, len(same[lower(t)]), i == keep] += 1
        assert got == want


def test_without_copies(odd):
    left = [(r.doc_id, lower(r.text)) for r in without_copies(odd).collect()]
    best = {}
    for i, t in rows_of(odd):
        best[lower(t)] = max(best.get(lower(t), -1), -1 if i is None else i)
    assert sorted(t for _, t in left) == sorted(best) and all((-1 if i is None else i) == best[t] for i, t in left)
    assert without_copies(odd).columns == odd.columns


def shingles(t):
    w = lower(t).encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(sets, nodes):
    """Least node reachable for each node, over rows linked by their sets."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (x, a) in enumerate(zip(nodes, sets, strict=True)):
        for y, b in list(zip(nodes, sets, strict=True))[:i]:
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("small", [16, 2])
def test_near(odd, small, monkeypatch):
    monkeypatch.setattr(N, "SMALL_KEY", small)
    monkeypatch.setattr(N, "BLOCK_DOCS", 7)
    rows = rows_of(odd)
    known = [(i, shingles(t)) for i, t in rows if i is not None]
    least = linked([s for _, s in known], [i for i, _ in known])
    want = Counter((i, len(shingles(t)), least.get(i), i is None or least[i] == i) for i, t in rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(odd).collect()) == want


def test_without_near_copies(odd):
    rows = rows_of(odd)
    left = Counter((i, t) for i, t in rows_of(N.without_near_copies(odd)))
    # rows are documents of their own here; ids that are null come last
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    group = linked([shingles(rows[k][1]) for k in order], list(range(len(order))))
    assert left == Counter(rows[order[n]] for n, g in group.items() if n == g)


def test_near_recall(spark):
    """Pairs at all similarities around the threshold: none above it is lost, none below it is linked."""
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(150):
        words = prose(rng, 300).split()
        other = list(words)
        for _ in range(rng.randrange(0, 14)):
            other[rng.randrange(300)] = f"z{rng.random()}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want[2 * k + 1] = 2 * k if 100 * len(a & b) >= 75 * len(a | b) else 2 * k + 1
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in want} == want and len(set(want.values()) & set(range(0, 300, 2))) > 50


@pytest.mark.parametrize("copies", [200, 300])
def test_sharding_keeps_groups_whole(spark, copies):
    """Groups of equal texts under the tolerance lie in one shard, however many rows they have."""
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(20, 60) + str(i), "en", f"src{i % 7}") for i in range(30_000)]
    rows += [(40_000 + i, "tie", "en", "src0") for i in range(copies)] + [(None, None, None, None), (7, "again", "en", "src1"), (7, "again", "en", "src1")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("x")).withColumn("size", F.lit(0))
    for shards in (2, 5, 8):
        got = hilbert_shards(table, shards=shards).toPandas()
        assert len(got) == len(rows) and got[got.doc_id >= 40_000].shard.nunique() == 1
        sizes = got.groupby("shard")["size"].sum()
        assert sizes.max() - sizes.min() <= 0.02 * sizes.mean() + 2 * got["size"].max()
        for _, s in got.groupby("shard"):
            assert sorted(s.slot) == list(range(len(s)))


def test_packing_of_whole_documents(spark):
    """Ids of every document by the plain tokenizer; bins; repeated and null ids; a long text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (0, ""), (90_001, "é 日本 \x85 " * 40_000)], "doc_id long, text string"))
    got = P.pack_documents(table, path).toPandas()
    want = Counter()
    for r in table.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], range(first, len(ids) + 1, 1024), strict=True)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, b in got.groupby("sequence_id"):
        b = b.sort_values("offset")
        assert b.length.sum() <= 1024 and (b.offset.values == b.length.cumsum().shift(fill_value=0).values).all()
    assert got.sequence_id.nunique() <= P.lower_bound(got.length.to_numpy(), 1024) * 1.01 + 1


def test_packing_rounds(spark):
    """Several groups exchange pieces; small cases use as few bins as there can be."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 100, 3000))]
    got = P.pack_pieces(spark.createDataFrame(rows, P.PIECES), 100, 400).toPandas()
    assert sorted(got.doc_id) == list(range(3000)) and got.groupby("sequence_id").length.sum().max() <= 100
    assert got.sequence_id.nunique() <= 1.02 * P.lower_bound(got.length.to_numpy(), 100)

    def fewest(items, room=()):
        if not items:
            return len(room)
        best = fewest(items[1:], (*room, 10 - items[0]))
        for k in {r: k for k, r in enumerate(room) if r >= items[0]}.values():
            best = min(best, fewest(items[1:], tuple(r - items[0] if j == k else r for j, r in enumerate(room))))
        return best

    for _ in range(30):
        items = rng.integers(1, 11, 8)
        exact = fewest(tuple(sorted(items.tolist(), reverse=True)))
        _, _, fill = P.best_fit_decreasing(items, 10)
        assert P.lower_bound(items, 10) <= exact <= len(fill) <= exact + 1


def test_mixing_rows(odd):
    got = mix(odd, F.lit("d"), {}, {}, budget_share=0.5, max_epochs=1, carried=("component",))
    assert got.count() == odd.count() and got.where("copies not in (0, 1) or component <> 'y'").count() == 0


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.02], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 0), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [1.0, None], 0), (9, [-1.0, 0.0], 0), (10, [2.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("list", F.lit("y"))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(table).collect())
    assert got == Counter([(1, 3, 1, True), (1, 3, 1, True), (None, 0, None, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 3, 1, False)])


def test_url_entries(spark):
    """A key that comes back, a parent that ties, and lists that agree; clashing columns."""
    entries = spark.sql("select * from values ('s', 'a.org', 'add', date'2024-01-01'), ('s', 'a.org', 'remove', date'2024-01-05'), ('s', 'a.org', 'add', date'2024-01-08'), ('t', 'x.a.org', 'add', date'2024-01-02'), ('t', 'a.org', 'add', date'2024-01-02'), ('s', 'b.org', 'remove', date'2024-01-01'), ('s', 'a.org', 'add', date'2024-01-08') as e(list, key, action, day)")
    captures = spark.sql("select id as page_id, concat('http://x.a.org/', id) as url, date_add(date'2024-01-01', cast(id as int)) as fetch_day, 'z' as host, 'q' as key from range(0, 10)")
    got = {r.page_id: (r.n_active, r.lists, r.matched) for r in filter_urls(captures, entries).collect()}
    want = {}
    for k in range(10):
        s = k < 4 or k >= 7
        t = k >= 1
        want[k] = (s + 2 * t, ",".join(["s"] * s + ["t"] * t), "x.a.org" if t else ("a.org" if s else None))
    assert got == want


def test_hashes_are_of_whole_texts(odd):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup(odd, fingerprint_all=True).where("doc_id = 9").collect()}
    text = next(t for i, t in rows_of(odd) if i == 9)
    assert got[9] == hashlib.sha256(lower(text).encode()).hexdigest()
