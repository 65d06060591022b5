"""The pipeline's stages one after another, each against what it should do on its own input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from memlake.llm import language_id as LI
from memlake.llm.mixing import mix
from memlake.llm.queries import DOMAIN_WEIGHTS, LANG_WEIGHTS, source_domain, tokenizer_path

SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = lower(t).encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Documents, with rows that repeat an id or have none, and each stage's rows, written and read again as the next one's docs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.where("doc_id in (3, 4)").unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(6).cast("long"))).unionByName(docs.where("doc_id in (7, 8)").withColumn("doc_id", F.lit(None).cast("long")))
    more = more.unionByName(spark.createDataFrame([(900, None, "en", "src1", 0), (901, "", None, None, 0), (902, "\x01\x02" * 400, None, "src2", 800)], docs.schema))
    out = [docs.unionByName(more)]
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "x")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(frame):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in frame.collect()), key=str)


def test_stages(outputs):
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(o.columns == outputs[0].columns for o in outputs[:-1])


def test_language(outputs):
    model = LI.fit_text_model(outputs[0], "doc_id", "text", "lang")
    found = LI.identify(outputs[0].withColumn("k", F.monotonically_increasing_id()), id_col="k", host=F.col("source"), model=model)
    gone = found.where("rejected").count()
    before, after = rows(outputs[0]), rows(outputs[1])
    assert len(before) - len(after) == gone
    assert not any(not r[1] or r[0] == 902 for r in after) and len(after) > 0.95 * len(before)


def test_exact(outputs):
    best = {}
    for r in rows(outputs[1]):
        key = lower(r[1])
        best[key] = max(best.get(key, -1), -1 if r[0] is None else r[0])
    assert sorted((k, v) for k, v in best.items()) == sorted((lower(r[1]), -1 if r[0] is None else r[0]) for r in rows(outputs[2]))


def test_near(outputs):
    before = sorted(rows(outputs[2]), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(r[1]) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert rows(outputs[3]) == sorted((r for i, r in enumerate(before) if find(i) == i), key=str)


def test_mixing(outputs):
    mixed = mix(outputs[3], source_domain(), DOMAIN_WEIGHTS, LANG_WEIGHTS, budget_share=C.MIX_SHARE, max_epochs=1, seed=C.MIX_SEED, carried=("text",))
    want = sorted((str(r.doc_id), r.text) for r in mixed.where("copies > 0").collect())
    assert sorted((str(r[0]), r[1]) for r in rows(outputs[4])) == want
    tokens = sum(len((r[1] or "").encode().split()) for r in rows(outputs[3]))
    taken = sum(len((r[1] or "").encode().split()) for r in rows(outputs[4]))
    assert 0.5 * C.MIX_SHARE * tokens < taken <= tokens


def test_packing(outputs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    got = outputs[5].toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    crc = sorted(zlib.crc32(np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 2][-1024:], "<u4").tobytes()) for r in rows(outputs[4]))
    last = got.sort_values("piece").groupby(got.doc_id.fillna(-1)).tail(1)
    assert set(last.ids_crc32) <= set(crc) and len(got[got.piece == 0]) == len(crc)


def test_run(spark):
    whole = C.run(spark, SF)
    assert whole.columns[:3] == ["doc_id", "piece", "start"] and whole.count() > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0
