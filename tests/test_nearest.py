import random

import numpy as np

from memlake.operators import vector as V
from memlake.plans import docs as P


def test_nearest_of_every_twentieth(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(230)]
    rows += [(i, rows[i - 230][1]) for i in range(230, 240)]  # copies: ties go to the smaller id
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    m = np.array([v for _, v in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for q in range(0, 240, 20):
        near = sorted(range(240), key=lambda i: (-round(float(m[i] @ m[q]), 9), i))[:8]
        want |= {(q, i, k) for k, i in enumerate(near, 1)}
    got = P.QUERIES["k02_oversampled"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.vec_id, r.place) for r in got} == want and len(got) == len(want)
