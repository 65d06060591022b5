import random

from pyspark.sql import functions as F

from memlake.operators import cells as CE


def test_best_sums_over_cells(spark, monkeypatch):
    monkeypatch.setattr(CE, "CELL", 20)
    rng = random.Random(2)
    asked = [(q, w) for q in range(12) for w in rng.sample("abcdefgh", 3)]
    parts = [(w, f"D{i}", float(rng.randint(1, 3))) for i in range(150) for w in rng.sample("abcdefgx", 4)]
    sums = {}
    for q, w in asked:
        for v, i, p in parts:
            if v == w:
                sums[q, i] = sums.get((q, i), 0) + p
    want = {(q, i) for q in range(12) for i in sorted((i for k, i in sums if k == q), key=lambda i: (-sums[q, i], i))[:5]}
    got = CE.best_sums(spark.createDataFrame(asked, "query_id long, word string"), spark.createDataFrame(parts, "word string, id string, part double"), "word", 150, 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # words of queries and rows used to meet in a join, whose pairs were shuffled
    rows = [(r.query_id, r.id, r.total) for r in got.collect()]
    assert all(sums[q, i] == t for q, i, t in rows)
    kept = {(q, i) for q in range(12) for i in sorted((i for k, i, _ in rows if k == q), key=lambda i: (-sums[q, i], i))[:5]}
    assert kept == want and len(rows) <= 12 * 5 * 8
    none = CE.best_sums(spark.createDataFrame([], "query_id long, word string"), spark.createDataFrame(parts, "word string, id string, part double"), "word", 0, 5)
    assert none.count() == 0 and none.select(F.col("total")).dtypes == [("total", "double")]


def test_recall_keeps_the_best_of_a_cell(spark, monkeypatch):
    """Pairs of sessions and memories stay within a task, over several cells; what was shown is left out there."""
    from memlake.operators import search as SE

    monkeypatch.setattr(CE, "CELL", 10)
    rows = [(f"D{i:02d}", "name", "common words here", "r1" if i % 2 else "r2", "s", i / 100, "active") for i in range(60)]
    rows.append(("D60", "zebra", "other", "r2", "s", 0.5, "active"))
    notes = spark.createDataFrame(rows, "memory_id string, naming string, text string, repo_id string, subject string, confidence double, status string")
    prompts = spark.createDataFrame([(1, "r1", "common words of a zebra"), (2, None, "common words again")], "session long, repo_id string, text string")
    shown = spark.createDataFrame([(1, "D59"), (2, "D60")], "session long, memory_id string")
    got = SE.prompt_recall(notes, prompts, shown)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.session, r.memory_id, r.place) for r in got.collect()} == {(1, "D57", 1), (1, "D55", 2), (1, "D53", 3), (2, "D59", 1), (2, "D58", 2), (2, "D57", 3)}


def test_words_of_a_cell_are_hashed_once(monkeypatch):
    """Prompts of a cell are looked up together: each look-up hashes all words of the cell, and there was one a prompt."""
    import pyarrow as pa

    calls, look_up = [], CE.pc.index_in
    monkeypatch.setattr(CE.pc, "index_in", lambda *a, **k: calls.append(1) or look_up(*a, **k))
    held = pa.table({"memory_id": ["a", "a", "b", None], "token": ["x", "y", "x", None], "naming": [False, False, True, None], "repo_id": ["r", "r", "r", None], "anywhere": [False, False, False, None], "confidence": [0.5, 0.5, 0.5, None]})
    held = held.append_column("session", pa.array([None, None, None, 3], pa.int64())).set_column(0, "memory_id", pa.array(["a", "a", "b", "b"]))
    asked = pa.table({"session": pa.array([*range(20)], pa.int64()), "here": ["r"] * 20, "tokens": pa.array([["y", "x"], [], ["none"], ["x"]] + [["x", "zz", "y"]] * 16, pa.list_(pa.string()))})
    got = [(r["session"], r["memory_id"], r["hits"]) for r in CE.recalled_in_cell(asked, held, 3).to_pylist()]
    assert got == [(0, "a", 2), (0, "b", 2)] + [x for s in range(4, 20) for x in ((s, "a", 2), (s, "b", 2))]
    assert len(calls) <= 2


def test_scanned_terms_are_not_copied_for_queries(spark, monkeypatch):
    """Terms of rows meet pairs of queries and rows in cells; each pair used to carry the row's terms through joins."""
    monkeypatch.setattr(CE, "CELL", 10)
    rng = random.Random(5)
    docs = [(f"D{i}", rng.sample("abcdefgh", rng.randint(0, 5)) * 2) for i in range(60)]
    groups = sorted({(q, p, w) for q in range(9) for p in range(3) for w in rng.sample("abcdefxy", 2)})
    held = sorted({(q, f"D{rng.randrange(70)}") for q in range(10) for _ in range(25)})
    terms, want = dict(docs), set()
    for q, i in held:
        hits = len({p for k, p, w in groups if k == q and w in terms.get(i, ())})
        want |= {(q, i, hits)} if hits else set()
    got = CE.groups_met(spark.createDataFrame(groups, "query_id long, place int, word string"), spark.createDataFrame(held, "query_id long, id string"), spark.createDataFrame(docs, "id string, terms array<string>"), 60)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
