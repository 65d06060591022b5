import random

import pytest

from memlake.operators import phrases as PH


@pytest.mark.parametrize("shard,block", [(1 << 24, 1 << 26), (40, 500), (1, 1 << 26)])
def test_hits(spark, shard, block):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 80))) for _ in range(120)] + [None, "", "aaaa"]
    phrases = ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["aa", "a", "zzz", None, "", "a"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    p = spark.createDataFrame([(x,) for x in phrases], "phrase string")
    got = [tuple(r) for r in PH.phrase_hits(t, p, shard, block).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, x) for i, s in enumerate(texts) if s for x in phrases if x and x in s}


def test_skills(spark):
    t = spark.createDataFrame([(1, "Please DEPLOY the app"), (2, "nothing"), (3, None)], "text_id int, text string")
    k = spark.createDataFrame([("a", "deploy the"), ("a", "app"), ("b", "Thing"), ("c", None)], "skill_id string, trigger string")
    assert {tuple(r) for r in PH.matched_skills(t, k).collect()} == {(1, "a"), (2, "b")}
    assert PH.matched_skills(t, k.limit(0)).count() == 0 and PH.matched_skills(t.limit(0), k).count() == 0


def above_cells(df):
    """The lines of the plan above the tasks that make pairs."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return lines[: next(k for k, x in enumerate(lines) if "FlatMapCoGroups" in x)]


@pytest.mark.parametrize("form", ["several", "sole"])
def test_pairs_stay_in_their_tasks(spark, form):
    rng = random.Random(7)
    texts = [(i, "".join(rng.choice("abc é") for _ in range(rng.randint(0, 60)))) for i in range(90)] + [(90, None), (91, ""), (3, "ccab")]
    asked = [(i if form == "sole" else i % 20, "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))) for i in range(80)] + [(99, None), (98, "")]
    t, p = spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(asked, "owner long, phrase string")
    for df in (PH.owners_in(t, p, owners=7, block_texts=20), PH.owners_in(t, p)) if form == "several" else (PH.sole_owners_in(t, p), PH.sole_owners_in(t, p, shard_bytes=40)):
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == {(i, o) for i, s in texts if s for o, x in asked if x and x in s}
        assert not any("Exchange" in x for x in above_cells(df))


def test_sole_triggers_are_not_shuffled_as_pairs(spark):
    t = spark.createDataFrame([(1, "run it"), (2, "do")], "text_id int, text string")
    k = spark.createDataFrame([("a", "Run"), ("a", "run"), ("b", "it")], "skill_id string, trigger string")
    pairs = PH.matched_skills(t, k)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, "a"), (1, "b")] and not any("Exchange" in x for x in above_cells(pairs))


def test_scan_by_words_makes_pairs_in_cells(spark):
    import __spark_entry__ as E

    found = E.queries()["p09_scan_words"](spark, E.SMOKE_DIR)
    assert not any("Exchange" in x for x in above_cells(found)) and found.count() == found.distinct().count() > 0


def test_first_turns_without_tokens(spark, tmp_path):
    """A turn of stop words or signs has no longest word; asking for it ended the whole query."""
    from memlake.plans import search as P

    said = [(k, 0, "user", text) for k, text in enumerate(["the and", "", "?!", None, "deploy the app", "it"])] + [(9, 1, "user", "the")]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "We deployed it"), (2, "the and"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in P.QUERIES["t06_substring_match"](spark, str(tmp_path)).collect()] == [("deploy", 1)]
