import base64
import hashlib
import random

import numpy as np
import public_tokenizers as T
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.llm.bpe import Vocabulary, bpe_decode, bpe_encode, merged_word, replay

PATH = T.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, slice int, word string"


@pytest.fixture(scope="module")
def known():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def plain(known):
    return tiktoken.Encoding("plain", pat_str=T.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def usual(plain, words):
    return [plain.encode_single_piece(w) if hasattr(plain, "encode_single_piece") else plain._encode_single_piece(w) for w in words]


def test_replay_is_the_usual_merging(known, plain):
    rng = random.Random(3)
    alphabets = ["ab", "aeinrst ", "0123456789", "éàü日本語", "\t\n ", "abcdefghijklmnopqrstuvwxyzABC'-_/"]
    words = ["".join(rng.choice(a) for _ in range(rng.randint(1, 60))).encode() for a in alphabets for _ in range(300)]
    words += [b"a" * 5000, b" " * 4097, b"ab" * 3001, b"x", bytes(range(256))]
    got = [x.tolist() for x in replay(words, known)]
    assert got == usual(plain, words)
    assert [merged_word(w, known) for w in words[:400] if w not in known.ranks] == [g for w, g in zip(words[:400], got) if w not in known.ranks]
    assert replay([], known) == [] and b"".join(known.decode(np.array(g)) for g in got) == b"".join(words)


def test_lower_rank_after_a_merge():
    """Made-up ranks in which a merge brings up a pair of lower rank, as trained ones hardly do."""

    class Own(Vocabulary):
        def __init__(self, tokens):
            path = "/dev/null"
            super_tokens = [bytes([b]) for b in range(256)] + tokens
            import tempfile

            with tempfile.NamedTemporaryFile("wb", suffix=".ranks") as f:
                f.write(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(super_tokens)))
                f.flush()
                path = f.name
                super().__init__(path)

    rng = random.Random(8)
    for _ in range(150):
        tokens = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(2, 12))})
        rng.shuffle(tokens)
        known = Own(tokens)
        plain = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=known.ranks, special_tokens={})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 24))) for _ in range(40)]
        assert [x.tolist() for x in replay(words, known)] == usual(plain, words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=8))
def test_any_text(texts):
    import regex

    known = _cached()
    plain = tiktoken.Encoding("plain", pat_str=T.PATTERN, mergeable_ranks=known.ranks, special_tokens={})
    for text in texts:
        words = [w.encode() for w in regex.findall(T.PATTERN, text)]
        assert [i for x in replay(words, known) for i in x.tolist()] == plain.encode_ordinary(text)


_kept = []


def _cached():
    if not _kept:
        _kept.append(Vocabulary(PATH))
    return _kept[0]


def expected(plain, text):
    ids = plain.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("slice_chars,shard_text", [(1, 1 << 12), (3000, 1 << 14), (4 << 20, 4 << 20)])
def test_documents(spark, plain, slice_chars, shard_text):
    """Nulls, empty, repeated and very long texts, special-looking strings, repeated and null ids, clashing columns."""
    rng = random.Random(1)
    texts = [None, "", " ", "a <|endoftext|> b", "  two  spaces\n\nlines\t", "naïve café 日本語 🙂", "don't we'll I'M", "x" * 30_000, " ".join(str(rng.random()) for _ in range(3000)), "same", "same"]
    rows = [(i, t, "own", 7, "z") for i, t in enumerate(texts)] + [(3, "again", "own", 7, "z"), (None, "no id", "own", 7, "z")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = bpe_encode(docs, PATH, T.PATTERN, slice_chars=slice_chars, shard_text=shard_text)
    got = sorted(((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()))
    assert got == sorted((str(i), *expected(plain, t)) for i, t, *_ in rows)
    for r in out.where("doc_id = 5").collect():
        assert np.frombuffer(zstandard.decompress(r.ids), "<u4").tolist() == plain.encode_ordinary(texts[5])
    back = {(str(r.doc_id), r.text) for r in bpe_decode(out, PATH).collect()}
    assert back == {(str(i), t or "") for i, t, *_ in rows}


def test_empty(spark):
    assert bpe_encode(spark.createDataFrame([], SCHEMA), PATH, T.PATTERN).count() == 0


def test_query(spark, plain):
    from memlake.llm.queries import op13_bpe

    sf = "/root/testdata/sf0.001"
    want = {(r.doc_id, *expected(plain, r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {tuple(r) for r in op13_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
