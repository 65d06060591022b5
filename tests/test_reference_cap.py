from memlake.plans import docs as P
from memlake.sources import fixtures as X


def test_fifty_new_references(spark, monkeypatch):
    """A page's first 50 new references are added, as in the reference."""
    rows = [(3, f"/{k:02d}".ljust(5 if k % 2 else 7, "x")) for k in range(60)]
    monkeypatch.setattr(X, "doc_refs", lambda s, d: s.createDataFrame(rows, "page_id long, ref_value string"))
    want = sorted(v for _, v in rows)[:50]
    for name in ("u05_reference_changes", "l27_document_edges"):
        got = P.QUERIES[name](spark, "").collect()
        assert sorted(r.ref_value for r in got if r.change == "add") == want and len(got) == 50
