import random

import pytest

from memlake.operators import reaching as RE


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(12)
    links = {(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(450)}
    want = set()
    for i in range(0, 150, 2):
        seen, here = {f"n{i}"}, {f"n{i}"}
        for d in (1, 2, 3):
            here = {b for a, b in links if a in here} - seen
            seen |= here
            want |= {(f"n{i}", f"name {b[1:]}", d) for b in here if int(b[1:]) % 3}
    edges = spark.createDataFrame([*sorted(links), min(links), (None, "n1"), ("n1", None)], "src_id string, dst_id string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(0, 150, 2)] + [("n0",), ("none",)], "node_id string")
    labels = spark.createDataFrame([(f"n{i}", f"name {i}") for i in range(150) if i % 3], "node_id string, label string")
    return edges, seeds, labels, want


FORMS = [{}, {"FEW_SEEDS": 10}, {"MOST_LINKS": 0}, {"FEW_SEEDS": 10, "MASK_BYTES": 1, "BATCH_ROWS": 1, "LOOKED_AT": 1, "ROW_LINKS": 2}]


@pytest.mark.parametrize("form", range(len(FORMS)))
def test_cells_against_plain_walks(spark, graph, monkeypatch, form):
    """In one cell and many, by joins, and in the smallest steps."""
    for name, value in FORMS[form].items():
        monkeypatch.setattr(RE, name, value)
    edges, seeds, labels, want = graph
    rows = [tuple(r) for r in RE.all_reached(edges, seeds, 3, labels, most_links=RE.MOST_LINKS).collect()]
    assert set(rows) == want and len(rows) == len(want)
    first = {}
    for s, name, d in sorted(want, key=lambda x: (x[0], x[2], x[1])):
        first.setdefault(s, []).append((name, d))
    got = {r.seed: list(zip(r.labels, r.depths, strict=True)) for r in RE.nearest_reached(edges, seeds, 3, labels, 4, most_links=RE.MOST_LINKS).collect()}
    assert got == {s: x[:4] for s, x in first.items()}


def test_pairs_are_not_shuffled_or_sorted(spark):
    """Pairs of seeds and modules leave the cells as they are; they were spread from masks, joined and ranked by a window."""
    import __spark_entry__ as E

    for name in ("q16_dependencies", "q17_impact", "k09_dependency_order"):
        plan = E.queries()[name](spark, E.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString().splitlines()
        above = plan[: next((k for k, x in enumerate(plan) if "FlatMapGroupsInArrow" in x), len(plan))]
        assert len(above) < len(plan) and not any(w in x for x in above for w in ("Exchange", "Window", "Join")), name
