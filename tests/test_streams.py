import os
import signal
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from memlake.streaming import drain as DR
from memlake.streaming import stateful as ST

MIN = 60_000


def stream(spark, path, pieces, schema):
    for k, rows in enumerate(pieces):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


ATTEMPT = "key string, seq long, ms long, worker long, kind string"


def test_claims_free_themselves(spark, tmp_path):
    path = f"file://{tmp_path}"
    first = [("a", 1, 1, 1, "claim"), ("a", 2, 5 * MIN, 2, "claim"), ("b", 3, 1, 7, "claim"), ("c", 4, MIN, 3, "claim"), ("c", 5, 2 * MIN, 9, "complete"), ("c", 6, 3 * MIN, 3, "complete"), ("c", 7, 4 * MIN, 9, "claim")]
    second = [("a", 8, 15 * MIN + 1, 2, "claim"), ("d", 9, 18 * MIN, 1, "complete")]
    ST.into_table(spark, ST.claims(stream(spark, path, [first], ATTEMPT)), f"{path}/out", f"{path}/check")
    # a restart: the state is what it was
    ST.into_table(spark, ST.claims(stream(spark, path, [second], ATTEMPT)), f"{path}/out", f"{path}/check")
    third = [("e", 10, 60 * MIN, 1, "claim")]
    ST.into_table(spark, ST.claims(stream(spark, path, [third], ATTEMPT)), f"{path}/out", f"{path}/check")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect())
    want = [(*r, ok) for r, ok in zip(first + second + third, [True, False, True, True, False, True, True, True, False, True])]
    freed = [("a", -1, 15 * MIN + 1, 1, "free", True), ("b", -1, 15 * MIN + 1, 7, "free", True), ("c", -1, 19 * MIN, 9, "free", True), ("a", -1, 30 * MIN + 1, 2, "free", True)]
    assert got == sorted(want + freed)


def test_life_cycles_are_forgotten(spark, tmp_path):
    path, day = f"file://{tmp_path}", ST.FORGET_MS
    rows = [[("a", 1, 1, "in_progress"), ("a", 2, 2, "created"), ("a", 3, 3, "completed"), ("b", 4, 4, "failed")], [("a", 5, day, "failed"), ("a", 6, day + 1, "failed"), ("a", 7, day + 3, "in_progress")], [("b", 8, 9 * day, "abandoned")]]
    ST.into_table(spark, ST.life_cycles(stream(spark, path, rows, "key string, seq long, ms long, wanted string")), f"{path}/out", f"{path}/check")
    got = {r.seq: (r.accepted, r.state) for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {1: (True, "in_progress"), 2: (False, "in_progress"), 3: (True, "completed"), 4: (True, "failed"), 5: (False, "completed"), 6: (False, "completed"), 7: (True, "in_progress"), 8: (True, "abandoned")}


CHANGES = [[(1, "a", "x"), (2, "b", "y"), (3, "a", "x")], [(4, "a", None), (5, "b", "y"), (6, "c", "z"), (7, "c", "w")], [(8, "a", "x"), (9, "d", None), (10, "c", "w")]]
EFFECTS = [(1, "a", "x", "index"), (2, "b", "y", "index"), (4, "a", None, "retire"), (6, "c", "z", "index"), (7, "c", "w", "refresh"), (8, "a", "x", "index")]


@pytest.mark.parametrize("dies", ["never", "before", "after"])
def test_effects_once(spark, tmp_path, dies):
    """The process ends within the second batch, before or after its version is published, and starts again."""
    path = f"file://{tmp_path}"
    changes = stream(spark, path, CHANGES, "seq long, path string, hash string")

    class Dying(DR.Drain):
        def published(self, number, parts, base):
            if number == 1 and dies == "before":
                raise RuntimeError("dies")
            super().published(number, parts, base)
            if number == 1 and dies == "after":
                raise RuntimeError("dies")

    if dies != "never":
        with pytest.raises(Exception, match="dies"):
            DR.run(spark, changes, Dying(spark, f"{path}/state"), f"{path}/check")
    drain = DR.Drain(spark, f"{path}/state")
    DR.run(spark, changes, drain, f"{path}/check")
    DR.run(spark, changes, drain, f"{path}/check")
    assert sorted(tuple(r) for r in drain.effects().collect()) == EFFECTS
    assert {(r.path, r.hash) for r in drain.state().collect()} == {("a", "x"), ("b", "y"), ("c", "w")}
    assert drain.files.versions() == [1, 2, 3]
    drain.apply(spark.createDataFrame([(99, "z", "q")], "seq long, path string, hash string"), 2)  # a batch that was there
    assert drain.effects().where("seq = 99").count() == 0


def test_killed_process(spark, tmp_path):
    """A process that is killed after it has published, before the stream notes the batch: the next one does nothing twice."""
    path = f"file://{tmp_path}"
    changes = stream(spark, path, CHANGES, "seq long, path string, hash string")
    script = textwrap.dedent(f"""
        import os, signal
        from pyspark.sql import SparkSession
        from memlake.streaming import drain as DR
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        class Killed(DR.Drain):
            def published(self, number, parts, base):
                super().published(number, parts, base)
                if number == 1:
                    os.killpg(0, signal.SIGKILL)
        changes = spark.readStream.schema("seq long, path string, hash string").option("maxFilesPerTrigger", 1).parquet("{path}/in")
        DR.run(spark, changes, Killed(spark, "{path}/state"), "{path}/check")
    """)
    ended = subprocess.run([sys.executable, "-c", script], env=os.environ, timeout=180, start_new_session=True, capture_output=True)
    drain = DR.Drain(spark, f"{path}/state")
    assert ended.returncode == -signal.SIGKILL and drain.files.versions() == [1, 2]
    DR.run(spark, changes, drain, f"{path}/check")
    assert sorted(tuple(r) for r in drain.effects().collect()) == EFFECTS and drain.files.versions() == [1, 2, 3]


def test_pieces_are_several_files(spark, tmp_path, monkeypatch):
    """Each batch is one piece, all its files, also where a piece has fewer rows than files."""
    monkeypatch.setattr(DR, "FILE_ROWS", 10)
    ms = [1] * 97 + [2, 3, *range(100, 161)]
    rows = spark.createDataFrame([(f"k{i % 7}", i, m) for i, m in enumerate(ms)], "key string, seq long, ms long")
    batches = []
    stream = DR.in_pieces(rows, "ms", 4, f"file://{tmp_path}/in")
    stream.writeStream.foreachBatch(lambda b, n: batches.append([r.ms for r in b.select("ms").collect()])).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 4 and sorted(m for b in batches for m in b) == sorted(ms)
    assert len(list((tmp_path / "in").glob("part-*"))) == 16
    seen = [b for b in batches if b]
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:]))


def test_state_is_read_once_a_batch():
    """However many rows a key has in a batch."""

    class Value:
        asked = 0
        value = ("created", 0)

        def exists(self):
            Value.asked += 1
            return True

        def get(self):
            Value.asked += 1
            return self.value

        def update(self, value):
            Value.asked += 1

    class Handle:
        def registerTimer(self, at):
            Value.asked += 1

        deleteTimer = registerTimer

        def getValueState(self, name, schema):
            return Value()

    import pandas as pd

    n = 500
    cycle, claims = ST.LifeCycle(), ST.Claims()
    cycle.init(Handle())
    out = list(cycle.handleInputRows(("a",), iter([pd.DataFrame({"seq": range(n), "ms": [k * ST.FORGET_MS for k in range(n)], "wanted": ["failed"] * n})]), None))[0]
    assert out["accepted"].all() and len(out) == n and Value.asked <= 5
    Value.asked, Value.value = 0, (1, 0)
    claims.init(Handle())
    out = list(claims.handleInputRows(("a",), iter([pd.DataFrame({"seq": range(n), "ms": [k * ST.STALE_MS for k in range(n)], "worker": [1] * n, "kind": ["claim"] * n})]), None))[0]
    assert (out["kind"] == "free").sum() == n - 1 and Value.asked <= 5
