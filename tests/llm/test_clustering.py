import hashlib
import random

import numpy as np
import pytest

from memlake.llm.clustering import Search, cells, cluster_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string, cells int"


def brute(rows, clusters, rounds, scale=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), c) for i, c in kept if i is not None) + sorted(("~", c) for i, c in kept if i is None)
    cen = [c for _, c in named[:clusters]]

    def near(c):
        return min((sum((a - b) ** 2 for a, b in zip(c, m)), k) for k, m in enumerate(cen))

    for _ in range(rounds):
        own = {}
        for _, c in kept:
            own.setdefault(near(c)[1], []).append(c)
        cen = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else m for k, m in enumerate(cen)]
    last = [(i, *near(c)) for i, c in kept]
    of = {}
    for _, d, k in last:
        of[k] = of.get(k, 0) + d
    total = sum(of.values())
    return sorted((str(i), k, d, of[k], total, hashlib.sha256(",".join(map(str, cen[k])).encode()).hexdigest()) for i, d, k in last)


def vectors(rng, n):
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for i in range(n)]


def result(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def made(spark, rows):
    return spark.createDataFrame([(i, v, 1, 9, "x", 3) for i, v in rows], SCHEMA)


def test_against_brute_force(spark):
    """Nulls, wrong lengths, values that aren't finite, equal vectors, repeated and null ids, clashing columns."""
    rng = random.Random(4)
    rows = vectors(rng, 300)
    same = rows[0][1]
    rows += [(1000, None), (1001, []), (1002, same[:63]), (1003, [None, *same[1:]]), (1004, [float("nan"), *same[1:]]), (1005, [float("inf"), *same[1:]])]
    rows += [(2000 + k, same) for k in range(120)] + [(7, rows[8][1]), (None, rows[9][1]), (None, same)]
    df = made(spark, rows).repartition(5)
    assert result(cluster_vectors(df)) == brute(rows, 16, 3)
    assert result(cluster_vectors(df, clusters=3, rounds=1)) == brute(rows, 3, 1)


def test_few_and_equal_vectors(spark):
    rng = random.Random(2)
    rows = vectors(rng, 5)
    assert result(cluster_vectors(made(spark, rows))) == brute(rows, 16, 3)
    rows = [(i, rows[0][1]) for i in range(40)]
    got = result(cluster_vectors(made(spark, rows)))
    assert got == brute(rows, 16, 3) and {r[1] for r in got} == {0}
    rows = [(None, v) for _, v in vectors(rng, 20)]
    assert result(cluster_vectors(made(spark, rows))) == brute(rows, 16, 3)


def test_empty_and_too_large(spark):
    assert cluster_vectors(made(spark, [])).count() == 0
    assert cluster_vectors(made(spark, [(1, [3e38] * 64), (2, None)])).count() == 0
    assert cells(made(spark, [(1, [1e9] * 64), (2, [-0.5] * 64)]), "vec_id", "embedding", 64, 64).count() == 1


@pytest.mark.parametrize("step", [1, 8, 64, 100])
def test_search_is_exact_and_abandons(step):
    rng = np.random.default_rng(1)
    middles = rng.integers(-60, 60, (16, 64)) * (np.arange(64) < 16)
    x = middles[rng.integers(0, 16, 3000)] + rng.integers(-4, 5, (3000, 64))
    c = np.concatenate((middles[:12], middles[:4]))  # ties
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    best, distance, work = Search(c, np.argsort(-x.var(0), kind="stable"), step).nearest(x)
    assert (best == whole.argmin(1)).all() and (distance == whole.min(1)).all()
    assert step >= 64 or work < 0.6 * whole.size * 64
