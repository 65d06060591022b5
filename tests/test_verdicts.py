import pytest

from memlake.operators import verdicts as VD
from memlake.sources.versions import Conflict

ROWS = [("d1", "a.md", "h1", "plan", "T2", "active", "heuristic", None, None), ("d2", "b.md", "h2", "guide", "T1", "active", "user", None, None), ("d3", "c.md", None, "guide", "T3", "draft", "heuristic", None, None)]


def ask(spark, *rows):
    return spark.createDataFrame([(n, v, p, *more, *[None] * (5 - len(more))) for n, v, p, *more in rows], VD.REQUESTS)


def acted(store, requests):
    return {r.seq: r.action for r in store.commit(requests).collect()}


@pytest.fixture
def store(spark):
    out = VD.Registry(spark)
    out.start(spark.createDataFrame(ROWS, VD.REGISTRY))
    return out


def standing(store, **k):
    return {r.doc_id: (r.rel_path, r.doc_type, r.tier, r.lifecycle) for r in store.registry(**k).collect()}


def test_five_verdicts(spark, store):
    got = acted(store, ask(spark, (1, "classify", "a.md", "adr", "T0"), (2, "archive", "b.md"), (3, "archive", "c.md"), (4, "fulfill", "c.md", None, None, None, ["x"], "#1"), (5, "supersede", "a.md", None, None, "no.md"), (6, "classify", "zz.md", "adr"), (7, "classify", "b.md", "a\nb"), (8, "burn", "b.md"), (9, None, None)))
    assert got == {1: "classified", 2: "refused", 3: "archived", 4: "later", 5: "missing", 6: "missing", 7: "invalid", 8: "invalid", 9: "invalid"}
    assert standing(store) == {"d1": ("a.md", "adr", "T0", "active"), "d2": ("b.md", "guide", "T1", "active"), "d3": ("docs/archive/c.md", "guide", "T3", "archived")}
    store.tables.pin("before")
    got = acted(store, ask(spark, (10, "classify", "a.md", "adr", "T0"), (11, "restore", "docs/archive/c.md"), (12, "supersede", "b.md", None, None, "a.md")))
    assert got == {10: "unchanged", 11: "restored", 12: "superseded"}
    assert standing(store)["d3"] == ("c.md", "guide", "T3", "draft") and standing(store, pin="before")["d3"][0] == "docs/archive/c.md"
    got = acted(store, ask(spark, (20, "fulfill", "a.md", None, None, None, ["one", "two"], "#7"), (21, "fulfill", "c.md", None, None, None, []), (22, "restore", "b.md")))
    assert got == {20: "fulfilled", 21: "invalid", 22: "missing"}
    assert {(r.doc_id, r.doc_tier, r.text) for r in store.memories().collect()} == {("d1", "T0", "one"), ("d1", "T0", "two")}
    done = store.registry().where("doc_id = 'd1'").first()
    assert done.lifecycle == "fulfilled" and '"evidence":"#7"' in done.fulfilled_by and "d1-20-2" in done.fulfilled_by
    assert store.memories(pin="before").count() == 0 and store.registry().where("superseded_by = 'd1'").first().doc_id == "d2"
    assert [r.verdict for r in store.attestations().orderBy("seq").collect()] == ["classify:adr:T0", "archived", "restored", "superseded", "fulfilled"]


def test_torn_and_rival_commits(spark, store, monkeypatch):
    """What dies before it publishes changes nothing, neither registry nor memories; of two commits on one base the second is told."""
    request = ask(spark, (1, "fulfill", "a.md", None, None, None, ["x"], "#1"))
    publish = store.tables.publish

    def dies(*args):
        raise RuntimeError("dies")

    monkeypatch.setattr(store.tables, "publish", dies)
    with pytest.raises(RuntimeError):
        store.commit(request)
    assert standing(store)["d1"][3] == "active" and store.memories().count() == 0 and store.attestations().count() == 0

    def rival(parts, base, *rest):
        publish(store.tables.manifest(base)["parts"], base)
        return publish(parts, base, *rest)

    monkeypatch.setattr(store.tables, "publish", rival)
    with pytest.raises(Conflict):
        store.commit(request)
    monkeypatch.setattr(store.tables, "publish", publish)
    assert standing(store)["d1"][3] == "active" and acted(store, request) == {1: "fulfilled"} and store.memories().count() == 1


def test_nothing_asked(spark, store):
    assert acted(store, ask(spark).limit(0)) == {} and len(standing(store)) == 3
