from memlake.operators import docledger as DL
from memlake.sources.versions import Tables


def made(spark, rows):
    return spark.createDataFrame(list(rows.items()), "path string, text string")


def state(ledger):
    return {r.path: (r.checked, r.total, r.dead_files, r.dead_symbols) for r in ledger.signals().collect()}


def test_scans(spark):
    ledger = DL.DocLedger(spark)
    first = {"a.md": "[x](b.md) src/m.py::run src/m.py::gone `src/n.py`\n- [x] t\n", "b.md": "-[ ] u\n", "c.md": "no refs", "src/m.py": "def run(): rerun", "src/n.py": ""}
    assert ledger.scan(made(spark, first)) == {"new": 5, "changed": 0, "gone": 0, "same": 0, "judged": 3}
    assert state(ledger) == {"a.md": (1, 1, 0, 1), "b.md": (0, 1, 0, 0), "c.md": (None, None, 0, 0)}
    assert ledger.scan(made(spark, first)) == {"new": 0, "changed": 0, "gone": 0, "same": 5, "judged": 0}
    # the word goes: only the document that refers to the file is judged
    assert ledger.scan(made(spark, {"src/m.py": "def rerun(): pass", "c.md": "no refs"})) == {"new": 0, "changed": 1, "gone": 0, "same": 1, "judged": 1}
    assert state(ledger)["a.md"] == (1, 1, 0, 2)
    # a file that it refers to goes, and a document
    assert ledger.scan(made(spark, {"src/m.py": None, "b.md": None, "never.md": None}))["judged"] == 1
    assert state(ledger) == {"a.md": (1, 1, 2, 2), "c.md": (None, None, 0, 0)}
    # one comes back, and a document no longer refers to the other
    ledger.scan(made(spark, {"b.md": "back", "a.md": "[x](b.md) b.md::back"}))
    assert state(ledger) == {"a.md": (None, None, 0, 0), "b.md": (None, None, 0, 0), "c.md": (None, None, 0, 0)}
    assert ledger.scan(made(spark, {"src/m.py": "x"}))["judged"] == 0
    assert {r.value: r.docs for r in ledger.references_by_value().collect()} == {"b.md": 1, "b.md::back": 1}
    assert {r.path for r in ledger.signals(1).collect()} == {"a.md", "b.md", "c.md"}


def test_first_symbols_count(spark):
    ledger = DL.DocLedger(spark)
    ledger.scan(made(spark, {"a.md": " ".join(f"m.py::f{k}" for k in range(12)), "m.py": "f0 f1 f11"}))
    assert state(ledger) == {"a.md": (None, None, 0, DL.PROBES - 2)}


def test_a_folder_is_written_by_several_tasks(spark):
    """Rows of one key, as of a file that all documents refer to, aren't one task's."""
    tables, schema = Tables(spark), "target string, path string"
    new = spark.range(4000).selectExpr("'m.py' as target", "concat('d', id, '.md') as path")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = tables.change([], "targets", "target", schema, new.limit(0), new)
        rows = tables.rows(parts, "targets", schema)
        assert rows.count() == 4000 and len(rows.inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
