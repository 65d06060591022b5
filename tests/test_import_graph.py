import random

import pytest

from memlake.operators import graph as G
from memlake.plans import graph as P
from memlake.plans import registry
from memlake.sources import fixtures as X


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders of which none has a key divisible by 20, over 60 modules, and what they say."""
    rng = random.Random(8)
    d = str(tmp_path_factory.mktemp("tables"))
    orders = {k: [rng.randint(1, 60) for _ in range(3)] for k in range(1, 60) if k % 20}
    lines = [(k, n, p) for k, parts in orders.items() for n, p in enumerate(parts, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p % 5}", 1 if p % 9 == 0 else 2) for p in range(1, 71)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    links = {(a, b) for parts in orders.values() for a, b in zip(parts, parts[1:], strict=False) if a != b}
    return d, links, {(a, b) for a, b in links if (a + b) % 13}


def test_all_edges(spark, tables):
    d, links, _ = tables
    got = X.code_edges(spark, d).collect()
    assert {(r.src_id, r.dst_id) for r in got} == {(f"P{a}", f"P{b}") for a, b in links} and len(got) == len(links)


def test_never_imported(spark, tables):
    d, _, imports = tables
    used = {b for _, b in imports}
    idle = {p for p in range(1, 71) if p % 9 and p not in used}
    for name, want in (("q18_unused_modules", {p for p in idle if not str(p).startswith("1")}), ("j11_never_imported", idle)):
        assert {r[0] for r in registry.QUERIES[name](spark, d).collect()} == {f"mod.{p}" for p in want}
    both = {f"P{p}" for p in used & {a for a, _ in imports}}
    assert {r[0] for r in P.QUERIES["j12_both_ways"](spark, d).collect()} == both


@pytest.mark.parametrize("names, reverse", [(("q16_dependencies",), False), (("q17_impact",), True)])
def test_reached_from_all_seeds(spark, tables, names, reverse):
    d, _, imports = tables
    steps: dict[int, set[int]] = {}
    for a, b in imports:
        steps.setdefault(b if reverse else a, set()).add(a if reverse else b)
    want, seeds = set(), {a for a, _ in imports}
    assert len(seeds) > 20
    for seed in seeds:
        depth, level = {seed: 0}, {seed}
        for k in range(1, 4):
            level = {b for a in level for b in steps.get(a, ())} - set(depth)
            depth |= dict.fromkeys(level, k)
        want |= {(f"P{seed}", f"mod.{b}", k) for b, k in depth.items() if k}
    for name in names:
        got = P.QUERIES[name](spark, d).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_cycles(spark, tables):
    """The 20 shortest cycles, by name; one for each set of members."""
    d, _, imports = tables
    steps: dict[str, list[str]] = {}
    for a, b in imports:
        if a % 9 and b % 9:
            steps.setdefault(f"P{a}", []).append(f"P{b}")
    found: dict[frozenset, str] = {}

    def walk(path):
        for b in steps.get(path[-1], ()):
            if b == path[0] and len(path) > 1:
                key = frozenset(path)
                found[key] = min(found.get(key, "~"), ">".join(path))
            elif b > path[0] and b not in path and len(path) < 6:
                walk([*path, b])

    for a in sorted(steps):
        walk([a])
    want = sorted((len(k), c) for k, c in found.items())[:20]
    got = [(r.length, r.cycle) for r in P.QUERIES["q19_import_cycles"](spark, d).collect()]
    assert got == want and want


def test_reach_of_many_seeds_by_masks(spark):
    """More seeds than a mask has bits, against a plain walk; with ``enough`` the nearest are all there. A seed was a row a node before."""
    from pathlib import Path

    rng = random.Random(12)
    links = {(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(450)}
    edges = spark.createDataFrame(sorted(links), "src_id string, dst_id string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(150)], "node_id string").coalesce(1)
    want = {}
    for i in range(150):
        seen, here = {f"n{i}"}, {f"n{i}"}
        for d in (1, 2, 3):
            here = {b for a, b in links if a in here} - seen
            seen |= here
            want |= {(f"n{i}", b): d for b in here}
    rows = G.reach(edges, seeds, 3).collect()
    assert {(r.seed, r.node_id): r.depth for r in rows} == want and len(rows) == len(want)
    level = max(Path(spark.conf.get("spark.checkpoint.dir")[7:]).glob("memlake/reach-2-*"), key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(f"file://{level}").count() < sum(d == 2 for d in want.values()) / 2
    labels = spark.createDataFrame([(f"n{i}", f"name {i}") for i in range(0, 150, 2)], "node_id string, name string")
    named = {(s, n): d for (s, n), d in want.items() if int(n[1:]) % 2 == 0}
    got = {(r.seed, r.node_id): r.depth for r in G.reach(edges, seeds, 3, labels=labels, enough=4).collect()}
    assert set(got.items()) <= set(named.items()) and len(got) < len(named)
    for i in range(150):
        nearest = sorted((d, n) for (s, n), d in named.items() if s == f"n{i}")[:4]
        assert sorted((d, n) for (s, n), d in got.items() if s == f"n{i}")[:4] == nearest
