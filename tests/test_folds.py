import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import folds as FO


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_folds(spark, n):
    """A key with nearly all rows, rare ones, null keys, equal order values; against one update after the other."""
    rng = random.Random(n)
    rows = [(None if (k := rng.random()) < 0.02 else "hot" if k < 0.9 else f"k{rng.randint(0, 9)}", rng.randint(0, n), i, round(rng.uniform(0, 1.3), 3), round(rng.uniform(-0.4, 0.4), 3), rng.choice([-FO.BIG, 0.0]), rng.choice([1.0, FO.BIG])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, id int, a double, b double, lo double, hi double").repartition(5)
    numbered = FO.numbered(df, ["k"], ["t", "id"])
    want, seen, place = {}, {}, {}
    for k, t, i, a, b, lo, hi in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want[k] = min(hi, max(lo, a * want.get(k, 0.3) + b))
        place[i] = (seen.get(k, (0, None))[0] + 1, seen.get(k, (0, None))[1])
        seen[k] = (place[i][0], (t, i))
    got = numbered.collect()
    assert {r.id: (r.i, r.before and tuple(r.before)) for r in got} == place and sorted(r.pos for r in got) == list(range(n))
    done = FO.folded(numbered.withColumn("u", FO.update(F.col("a"), F.col("b"), F.col("lo"), F.col("hi"))), ["k"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    result = {r.k: (r.n, r.x) for r in done.select("k", "n", FO.apply(F.col("u"), F.lit(0.3)).alias("x")).collect()}
    assert {k: c for k, (c, _) in result.items()} == {k: c for k, (c, _) in seen.items()}
    assert all(abs(result[k][1] - x) < 1e-9 for k, x in want.items())


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t int")
    assert FO.folded(FO.numbered(df, ["k"], ["t"]).withColumn("u", FO.update(1.0, 0.0)), ["k"]).count() == 0
