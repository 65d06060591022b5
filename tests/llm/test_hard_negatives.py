import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm.hard_negatives import Cells, best_in_windows, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label string, y int, anchor long, codes string"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    able = [(n, i, l, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for n, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(y) for *_, y in able]
    able = [r for r in able if (lengths.count(len(r[3])), len(r[3])) == max((lengths.count(n), n) for n in lengths)]
    out = []
    for n, i, l, y in able:
        if i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(y, z)), j, m) for k, j, m, z in able if k != n]
        for s, p, _ in sorted(s for s in scores if s[2] == l)[:positives]:
            found = sorted(t for t in scores if t[2] != l and low * -s <= 100 * -t[0] <= high * -s)[:negatives]
            out += [(i, p, k + 1, t[1], -s, -t[0]) for k, t in enumerate(found)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(i, v, l, 5, 6, "x") for i, v, l in rows], SCHEMA)


def result(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(rng, n, width=16):
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    return [(10 * i, [m + rng.gauss(0, 0.5) for m in rng.choice(middles)], f"l{i % 4}" if i % 3 else "hot") for i in range(n)]


@pytest.mark.parametrize("block,stripe", [(2048, 8192), (7, 40), (1, 13)])
def test_against_brute_force(spark, block, stripe):
    """Nulls, wrong lengths, values that aren't finite, equal vectors of one and of many labels, repeated ids, clashing columns."""
    rng = random.Random(6)
    rows = vectors(rng, 260)
    v = rows[0][1]
    rows += [(None, v, "hot"), (300, None, "hot"), (400, v, None), (500, [], "hot"), (600, v[:5], "hot"), (700, [float("nan"), *v[1:]], "l1"), (800, [None, *v[1:]], "l1"), (900, [float("-inf"), *v[1:]], "l1")]
    rows += [(5000 + k, v, "hot" if k % 2 else "l2") for k in range(60)] + [(100, rows[10][1], "hot"), (100, v, "l2"), (9100, v, "alone")]
    got = result(hard_negatives(made(spark, rows).repartition(3), F.expr("vec_id % 100 = 0"), block=block, stripe=stripe))
    assert got == brute(rows)


def test_edges(spark):
    anchors = F.expr("vec_id % 100 = 0")
    assert hard_negatives(made(spark, []), anchors).count() == 0
    v = [0.5, 0.25]
    assert result(hard_negatives(made(spark, [(0, v, "a"), (1, v, "b")]), anchors)) == []  # no positive
    assert result(hard_negatives(made(spark, [(0, v, "a"), (1, v, "a")]), anchors)) == []  # no negative
    assert result(hard_negatives(made(spark, [(5, v, "a"), (1, v, "a"), (2, v, "b")]), anchors)) == []  # no anchor
    assert hard_negatives(made(spark, [(0, [3e38, 1.0], "a"), (1, None, "a")]), anchors).count() == 0
    rows = [(0, [0.0, 0.0], "a"), (1, v, "a"), (2, v, "b"), (3, [-1.0, 0.0], "b"), (4, [-1.0, -1.0], "a"), (100, [1.0, 0.0], "a")]  # scores of 0 and below
    assert result(hard_negatives(made(spark, rows), anchors)) == brute(rows) != []


def test_bounds_hold_and_leave_few():
    rng = np.random.default_rng(5)
    y = (rng.normal(0, 30, (4000, 64)) + rng.normal(0, 30, (10, 64))[rng.integers(0, 10, 4000)]).astype(np.int64)
    y[7] = 10_000_000  # far outside the sample
    cells = Cells.fit(y[400:], y.min(0), y.max(0))
    codes, ids = cells.codes(y), np.arange(4000)
    a = y[:16]
    lower, upper = cells.bounds(a, codes)
    exact = a @ y.T
    assert (lower <= exact).all() and (exact <= upper).all()
    scored = 0
    for k in range(16):
        if k == 7:
            continue
        most = int(np.sort(exact[k][ids != 7])[-50])
        window = [(most * 3 // 10, most * 9 // 10), (most // 2, most)]
        at, score, n = best_in_windows(a[k], y, ids, ids != k, lower[k], upper[k], window, 10)
        want = set()
        for lo, hi in window:
            inside = sorted((-s, i) for i, s in enumerate(exact[k].tolist()) if i != k and lo <= s <= hi)[:10]
            want |= {(i, -s) for s, i in inside}
        assert set(zip(at.tolist(), score.tolist())) == want
        scored += n
    assert scored < 0.1 * 15 * 4000
