import math
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions import unicode as U
from memlake.operators import resolve as R
from memlake.operators import search as S

NOW = datetime(2024, 2, 1)
TEXTS = {
    "a": "Postgres connections keep failing in the nightly job",
    "b": "The connection pool of the database was enlarged",
    "c": "Café menus are printed on Fridays",
    "d": "連絡先を更新する",
    "e": "failing failing failing builds",
    "f": "an old note on connections",
    "g": "quarantined connections",
    "h": "unconnected words about sails",
}


def porter(words):
    return [U.porter_stem(w) for w in words]


def test_published_stems():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor conflated conflat hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit vietnamization vietnam operator oper decisiveness decis hopefulness hope formality formal sensitivity sensit triplicate triplic electrical electr goodness good revival reviv adjustable adjust replacement replac adoption adopt communism commun activate activ bowdlerize bowdler probate probat rate rate cease ceas controlling control rolling roll".split()
    assert porter(pairs[::2]) == pairs[1::2]
    assert porter(["", "ab", "été", "x1ing"]) == ["", "ab", "été", "x1ing"]


def tokens(text):
    out = []
    for w in __import__("re").findall(r"[^\W_]+", U.folded(text)):
        if any("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in w):
            out += [w, *(w[i : i + 2] for i in range(len(w) - 1))]
        elif len(w) > 1 and w not in T.STOP_WORDS:
            out.append(w)
    return out


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(k, t, "belief" if k != "b" else "event", "archived" if k == "f" else "active", 0.5 + i / 20, NOW - timedelta(days=10 * i), i, "TX" if k == "g" else ("T0" if k == "b" else None)) for i, (k, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "memory_id string, text string, memory_type string, status string, confidence double, updated_at timestamp_ntz, access_count int, doc_tier string")


def test_tokens(spark):
    got = spark.createDataFrame(list(TEXTS.items()), "k string, text string").select("k", U.search_tokens(F.col("text")).alias("t")).collect()
    assert {r.k: r.t for r in got} == {k: tokens(t) for k, t in TEXTS.items()}


def brute(query, k):
    """The rules by hand: stems by prefix, substrings where there are few hits, a scan at last."""
    active = [m for m in TEXTS if m != "f"]
    terms = {m: Counter(porter(tokens(TEXTS[m]))) for m in active}
    mean = sum(sum(c.values()) for c in terms.values()) / len(active)
    groups = [{w} | {x for g in T.SYNONYMS if w in g for x in g} for w in dict.fromkeys(tokens(query))]
    words = {w for g in groups for w in g}
    if not groups:
        return []

    def best(parts):
        score = Counter()
        for rows, average in parts:
            idf = max(1e-6, math.log((len(active) - len(rows) + 0.5) / (len(rows) + 0.5)))
            for m, (tf, dl) in rows.items():
                score[m] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))
        return {m: 1 / (1 + math.exp(-s)) for m, s in score.items()}

    found = []
    for stem in set(porter(sorted(words))):
        rows = {m: (sum(n for t, n in c.items() if t.startswith(stem)), sum(c.values())) for m, c in terms.items()}
        found.append(({m: x for m, x in rows.items() if x[0]}, mean))
    hits = best(found)
    if len(hits) < k or any(ord(c) > 0x3000 for w in words for c in w):
        folded = {m: U.folded(TEXTS[m]) for m in active}
        average = sum(len(t) - 2 for t in folded.values()) / len(folded)
        parts = [({m: (t.count(w), len(t) - 2) for m, t in folded.items() if w in t}, average) for w in words if len(w) >= 3]
        for m, s in best(parts).items():
            hits[m] = max(s, hits.get(m, 0))
    if not hits:
        hits = {m: sum(bool(g & set(tokens(TEXTS[m]))) for g in groups) / len(groups) for m in active}
        hits = {m: s for m, s in hits.items() if s}
    order = list(TEXTS)
    most = max((order.index(m) for m in hits), default=0)
    scored = []
    for m, s in hits.items():
        i = order.index(m)
        if m == "g":
            continue
        used = math.log1p(i) / math.log1p(most) if most else 0
        scored.append((-(0.65 * s + 0.2 * (0.5 + i / 20) + 0.1 * math.exp(-0.1 * i) + 0.05 * used) * (1.2 if m == "b" else 1), m))
    return [m for _, m in sorted(scored)][:k]


def test_search(spark, notes):
    index = S.build_index(notes, "memory_id", F.col("text"))
    asked = {1: "connections of pg", 2: "cafe", 3: "更新する", 4: "nnect", 5: "zzz", 6: "the", 7: "fail job"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    now = F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")
    for k in (2, 4):
        got = {}
        for r in sorted(S.search(notes, index, queries, k, now).collect(), key=lambda r: (r.query_id, r.place)):
            got.setdefault(r.query_id, []).append(r.memory_id)
        assert got == {q: want for q, text in asked.items() if (want := brute(text, k))}
    assert S.search(notes, index, queries, -1, now).count() == 0 and S.search(notes, index, queries, 3, now, types=[]).count() == 0
    assert {r.memory_id for r in S.search(notes, index, queries, 8, now, types=["event"]).collect()} == {"b"}


def test_resolution(spark):
    nodes = spark.createDataFrame([("n1", "postgresql", "PostgreSQL", "tool", 3, "active", None), ("n2", "kubernetes", "Kubernetes", "tool", 1, "active", None), ("n3", "old name", "Old Name", "tool", 1, "merged", "n2"), ("n4", "user", "user", "user", 9, "active", None), ("n5", "fabricators", "Fabricators", "team", 1, "active", None), ("n6", "fabricator", "Fabricator", "team", 1, "active", None)], "node_id string, canonical string, display_name string, entity_type string, mention_count int, status string, merged_into string")
    aliases = spark.createDataFrame([("big pg", "n1"), ("older", "n3")], "alias string, node_id string")
    names = spark.createDataFrame([("PG", None), ("Postgresq", None), ("big-pg", None), ("Older", None), ("user", None), ("fabricatorz", None), ("qqq", "tool"), (" ", None)], "name string, entity_type string")
    got = {r.name: (r.node_id, r.how, r.possible) for r in R.resolve(names, nodes, aliases).collect()}
    assert got == {"PG": ("n1", "exact", None), "Postgresq": ("n1", "similar", None), "big-pg": ("n1", "alias", None), "Older": ("n2", "alias", None), "user": ("n4", "singleton", None), "fabricatorz": (None, "possible", "n5,n6"), "qqq": (None, "new", None)}
