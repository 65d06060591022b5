import hashlib
import random
import zlib

import numpy as np
import pytest

from memlake.llm import components as C
from memlake.llm import near_dedup as N
from memlake.llm import packing as P
from memlake.llm import suffix_dedup as S
from memlake.llm.embedding_dedup import embedding_near_duplicates
from memlake.llm.exact_dedup import exact_dedup
from memlake.llm import language_id as LI
from memlake.llm.lm_score import score
from memlake.llm.mixing import mix
from memlake.llm.sharding import hilbert_shards
from memlake.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string, lang string, source string, shard int, fp string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and short texts, copies, near copies, a shared passage, clashing column names."""
    rng = random.Random(5)
    base, passage = words(rng, 200), words(rng, 90)
    texts = [None, "", "one", "ONE", "a b c d", base, base.upper().lower(), base + " tail", base.replace("eta", "ETA", 1), passage + " " + words(rng, 50), words(rng, 40) + " " + passage, passage + passage, words(rng, 300)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact(docs, empty):
    rows = {r.doc_id: lower(r.text) for r in docs.collect()}
    for full in (True, False):
        got = {r.doc_id: r for r in exact_dedup(docs, fingerprint_all=full).collect()}
        assert len(got) == len(rows)
        for i, t in rows.items():
            same = [j for j, u in rows.items() if u == t]
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
            if full:
                assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert exact_dedup(empty, fingerprint_all=full).count() == 0


def shingles(t):
    w = lower(t).encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near(docs, empty):
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    for r in N.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), r.doc_id == find(r.doc_id))
    assert N.near_duplicates(empty).count() == 0


def test_components_over_blocks(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 12)] + [(20, 21), (22, 21), (30, 30)], "a long, b long")
    want = {k: 1 for k in range(1, 13)} | {20: 20, 21: 20, 22: 20}
    for block in (3, 1000):
        assert {r.node: r.component for r in C.components(edges, block_edges=block).collect()} == want


@pytest.fixture(scope="module")
def passages(spark):
    """Repeated ids with other texts, null ids, copies, overlapping and self-repeating passages, a passage in many texts, long texts."""
    rng = random.Random(12)
    a, b, c = (words(rng, 80) for _ in range(3))
    texts = [(1, a + " x"), (1, "y " + words(rng, 90)), (None, "z " + a), (None, words(rng, 20)), (2, b + b), (3, "ab" * 900), (4, "ba" * 600), (5, a[:450] + b[50:600] + c), (6, c), (7, c), (7, c), (8, None), (9, ""), (10, words(rng, 4000) + c + words(rng, 3000)), (11, "q" * 400), (12, "q" * 399), (13, "é" * 300 + a)]
    texts += [(100 + k, words(rng, rng.randrange(3, 30)) + " " + b[: 420 + 7 * (k % 9)] + " " + words(rng, 5)) for k in range(40)]
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, spans string, n_bytes string")


def brute_first(texts, limit):
    """Runs that stay with keep='first': each string's earliest place, by id (null last) and row."""
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0, k))
    seen, out = set(), [None] * len(texts)
    for k in order:
        t = texts[k][1]
        gone = [False] * len(t)
        for j in range(len(t) - limit + 1):
            if t[j : j + limit] in seen:
                gone[j : j + limit] = [True] * limit
            seen.add(t[j : j + limit])
        out[k] = gone
    return out


def digest_rows(texts, gone):
    rows = []
    for (i, t), g in zip(texts, gone, strict=True):
        spans = sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g))
        rows.append((str(i), len(t), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(t, g, strict=True) if not y)).hexdigest()))
    return sorted(rows)


@pytest.mark.parametrize(("covers", "slice_bytes", "shard_bytes", "blocks"), [(1024, 8 << 20, 64 << 20, 2048), (1, 5_000, 9_000, 3), (6, 20_000, 30_000, 8)])
def test_repeats(docs, passages, empty, covers, slice_bytes, shard_bytes, blocks):
    for table in (docs, passages):
        texts = [(r.doc_id, (r.text or "").encode()) for r in table.collect()]
        seen = {}
        for _, t in texts:
            for k in range(len(t) - 399):
                seen[t[k : k + 400]] = seen.get(t[k : k + 400], 0) + 1
        gone = []
        for _, t in texts:
            g = [False] * len(t)
            for k in range(len(t) - 399):
                if seen[t[k : k + 400]] > 1:
                    g[k : k + 400] = [True] * 400
            gone.append(g)
        options = {"group_covers": covers, "slice_bytes": slice_bytes, "shard_bytes": shard_bytes, "block_covers": blocks}
        got = S.repeated_passages(table, **options).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == digest_rows(texts, gone)
        if covers < 1024:
            first = S.repeated_passages(table.coalesce(1), keep="first", **options).collect()
            assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in first) == digest_rows(texts, brute_first(texts, 400))
    assert S.repeated_passages(empty).count() == 0


def test_without_passages(spark):
    text = "start " + "é" * 250 + " end"
    table = spark.createDataFrame([(1, text, 5), (1, "other", 8), (2, "é" * 250, 6), (3, None, 7), (None, "é" * 250, 9)], "doc_id long, text string, _id long")
    got = {r._id: r for r in S.without_passages(table, S.repeated_passages(table)).collect()}
    assert {k: (r.doc_id, r.text) for k, r in got.items()} == {5: (1, "start  end"), 8: (1, "other"), 6: (2, ""), 7: (3, None), 9: (None, "")}


def test_longest_previous_factor():
    rng = random.Random(1)
    for _ in range(20):
        t = bytes(rng.choice(b"ab") for _ in range(60))
        length, source = S.longest_previous_factor(t)
        for i in range(len(t)):
            best = max((next((k for k in range(len(t) - i) if t[j + k] != t[i + k]), len(t) - i) for j in range(i)), default=0)
            assert length[i] == best
            assert best == 0 or t[source[i] : source[i] + best] == t[i : i + best]


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = docs.unionByName(spark.createDataFrame([(100, "a <|endoftext|> b  <|endoftext|><|endof", None, None, 1, "x"), (101, "<|endoftext|>", None, None, 1, "x")], SCHEMA))
    got = P.pack_documents(docs, path, capacity=256).toPandas()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        own = got[got.doc_id == r.doc_id].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[1:] == 256).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.length.sum() <= 256 and (bin_.offset.values == bin_.length.cumsum().shift(fill_value=0).values).all()
    assert P.pack_documents(empty, path).count() == 0


def test_packing_bound():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 100, 200)
        _, _, fill = P.best_fit_decreasing(lengths, 100)
        assert P.lower_bound(lengths, 100) <= len(fill) and fill.max() <= 100 and fill.sum() == lengths.sum()


def test_chunks_are_independent():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(rng.choice([" ", "  ", "\n", " \n", "a", "Bc", "é", "12", "'s", "<|endoftext|>", "\x85", "日本"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for t, ids in zip(texts, P.ChunkEncoder(path).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_sharding(docs, empty):
    got = hilbert_shards(docs, shards=3).toPandas()
    assert len(got) == docs.count() and set(got.law) == {"bytes"}
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert got.groupby("shard")["size"].sum().max() <= got["size"].sum() / 3 + got["size"].max()
    assert hilbert_shards(empty).count() == 0


def test_mixing(docs, empty):
    from pyspark.sql import functions as F

    got = mix(docs, F.lit("d"), {"d": 1}, {"en": 3}, budget_share=0.5, max_epochs=2).toPandas()
    assert len(got) == docs.count() and got.copies.between(0, 2).all()
    leaf = got.groupby(["domain", "lang", "source"]).apply(lambda g: (g.n_tokens * g.copies).sum() - g.leaf_budget.iloc[0])
    assert (leaf >= 0).all() and (leaf <= got.n_tokens.max()).all()
    assert mix(empty, F.lit("d"), {}, {}).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x[30:40] = x[:10] + 0.02 * rng.normal(size=(10, 8))
    x[45] = x[44]
    rows = [(i, [float(v) for v in r], i % 2 if i < 30 else (i - 30) % 2) for i, r in enumerate(x)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, rows[0][1], None)]
    got = {r.vec_id: r for r in embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), list_rows=10, chunk=16).collect()}
    f = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows[:60]}
    label = {i: k for i, _, k in rows}
    for i, a in f.items():
        want = sum(i != j and label[i] == label[j] and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93 for j, b in f.items())
        assert got[i].n_links == want
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103))


def test_url_filter(spark):
    from datetime import date

    entries = spark.createDataFrame([("spam", "bad.org", "add", date(2024, 1, 10)), ("spam", "bad.org", "remove", date(2024, 2, 1)), ("spam", None, "add", date(2024, 1, 1))], "list string, key string, action string, day date")
    urls = [("http://www.bad.org/x", date(2024, 1, 9)), ("http://www.BAD.org:80/x", date(2024, 1, 10)), ("http://u@bad.org", date(2024, 1, 31)), ("http://bad.org", date(2024, 2, 1)), (None, date(2024, 1, 20)), ("http://notbad.org", date(2024, 1, 20)), ("http://bad.org", None)]
    captures = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(urls)], "page_id long, url string, fetch_day date")
    got = {r.page_id: r.blocked for r in filter_urls(captures, entries).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert filter_urls(captures.limit(0), entries).count() == 0 and filter_urls(captures, entries.limit(0)).where("blocked").count() == 0


LANGUAGE_TEXTS = {"en": "the cat and the dog went to the house of the man ", "de": "der hund und die katze gingen in das haus des mannes ", "fr": "le chat et le chien sont dans la maison de la dame "}


def pages_table(spark):
    """Languages that agree or not with the markup, the suffix and the host; nulls, ties, repeated ids, a long text, clashing columns."""
    rng = random.Random(8)
    rows = []
    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        words_ = LANGUAGE_TEXTS[lang].split()
        n = 1 if i % 10 == 0 else 30
        rows.append((i, " ".join(rng.choice(words_) for _ in range(n)), lang if i % 4 else None, ["com", "de", "fr"][i % 3] if i % 5 else "com", f"h{i % 9}" if i % 7 else "", "x"))
    rows += [(None, LANGUAGE_TEXTS["en"], "en", None, None, "x"), (5, LANGUAGE_TEXTS["de"], "", "", "", "x"), (5, LANGUAGE_TEXTS["de"], "", "", "", "x"), (200, None, "en", "com", "h1", "x"), (201, "", "en", "com", "h1", "x"), (202, "ab", "de", "de", "h1", "x"), (203, LANGUAGE_TEXTS["fr"] * 20_000, "fr", "fr", "h2", "x"), (204, "\x01\x02" * 500, "en", "com", "h1", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string, best string")


def test_language_posterior(spark):
    """Against Bayes by hand: likelihoods from the model, shares and priors from plain counts."""
    from pyspark.sql import functions as F

    table = pages_table(spark)
    labels = spark.createDataFrame([(i, t * 3, k) for i, (k, t) in enumerate(LANGUAGE_TEXTS.items())], "doc_id long, text string, lang string")
    langs = ("en", "de", "fr")
    model = LI.fit_text_model(labels, "doc_id", "text", "lang", langs)
    rows = table.collect()
    grams = [LI.trigram_buckets(np.frombuffer((r.text or "").encode(), np.uint8)) if len((r.text or "").encode()) > 2 else np.zeros(0, np.int64) for r in rows]
    ll = [model[g].sum(axis=0, dtype=float) * min(1, LI.EVIDENCE / max(1, len(g))) for g in grams]
    noise = [-np.log(LI.BUCKETS) * len(g) * min(1, LI.EVIDENCE / max(1, len(g))) for g in grams]
    sure = [k for k in range(len(rows)) if len(grams[k]) and ll[k].max() > noise[k]]
    best = [int(v.argmax()) for v in ll]

    def counts(same):
        return np.bincount([best[k] for k in sure if same(rows[k])], minlength=3).astype(float)

    everywhere = counts(lambda r: True) + 1
    base = everywhere / everywhere.sum()

    def smoothed(c, prior):
        return (c + LI.SMOOTH * prior) / (c.sum() + LI.SMOOTH)

    got = LI.identify(table, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"), model=model, languages=langs).collect()
    assert len(got) == len(rows)
    left = [(r.doc_id, r.declared, r.host, r.n_grams, round(r.posterior, 9), r.language, r.rejected) for r in got]
    for k, r in enumerate(rows):
        suffix, host, declared = r.suffix or "", r.host or "", r.declared or ""
        by_suffix = smoothed(counts(lambda x: (x.suffix or "") == suffix), base)
        own = counts(lambda x: (x.suffix or "", x.host or "") == (suffix, host))
        prior = smoothed(own, by_suffix) if host and own.sum() else by_suffix
        said = (counts(lambda x: (x.declared or "") == declared) + LI.ADD) / (everywhere + LI.ADD) if declared else np.ones(3)
        joint = np.exp(ll[k] - ll[k].max()) * prior * said
        posterior = joint.max() / joint.sum()
        rejected = not r.text or (len(grams[k]) > 0 and ll[k].max() <= noise[k]) or posterior < 0.5
        left.remove((r.doc_id, declared, host, len(grams[k]), round(posterior, 9), "und" if rejected else langs[int(joint.argmax())], rejected))
    assert not left


def test_language_tables(spark, empty):
    from pyspark.sql import functions as F

    rows = [(i, LANGUAGE_TEXTS["en" if i % 2 else "de"] * 3, "en" if i % 2 else "de", "h" + str(i % 2)) for i in range(40)] + [(90, LANGUAGE_TEXTS["en"] * 4, "de", "h1"), (91, None, "en", "h1")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in LI.identify(table, host=F.col("source"), label_col="lang").collect()}
    assert got[90].language == "en" and got[91].rejected and all(got[i].language == ("en" if i % 2 else "de") for i in range(40))
    assert LI.identify(empty, host=F.col("source"), label_col="lang").count() == 0


def test_page_evidence(spark):
    from pyspark.sql import functions as F

    html = ['<html  LANG="de-AT"><body><script>var the="en";</script><p>Der <b>Hund</b></p></body>', "<html><p>x", None]
    rows = spark.createDataFrame([(h, u) for h, u in zip(html, ["www.a.de", "localhost", None], strict=True)], "html string, host string")
    got = rows.select(LI.page_declared(F.col("html")), F.trim(LI.page_text(F.col("html"))), LI.address_suffix(F.col("host"))).collect()
    assert [tuple(r) for r in got] == [("de", "Der  Hund", "de"), ("", "x", ""), ("", None, "")]


def test_score(docs, empty):
    import math
    from collections import Counter

    rows = {r.doc_id: lower(r.text).encode().split() for r in docs.collect()}
    counts = Counter()
    for i, w in rows.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    for r in score(docs).collect():
        tokens = [*rows[r.doc_id], None]
        base = sum(math.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in tokens)
        assert abs(base - r.base_score) < 1e-9 * max(1, abs(base))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), n)
        assert r.score < 0
    assert score(empty).count() == 0
