import json

from pyspark.sql import functions as F

from memlake.functions import rules as R
from memlake.operators import graph as G
from memlake.operators import ledger as L
from memlake.operators import modules as M
from memlake.operators import nested as N
from memlake.sources import synthetic as S
from memlake.streaming import service as V


def test_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("pkg/__init__.py", "pkg/a.py", "pkg/b.py", "web/lib/x/index.tsx", "web/y.js", "src/z.mjs")], "path string")
    rows = [("pkg/__init__.py", "", 1, ["a"]), ("pkg/__init__.py", "b", 1, ["f"]), ("pkg/a.py", "os", 0, []), ("pkg/a.py", "pkg.b", 0, []), ("pkg/a.py", "pkg", 0, ["missing"]), ("pkg/b.py", None, None, None)]
    python = spark.createDataFrame(rows, "path string, module string, level int, names array<string>")
    got = {(r.path, r.target, r.target_path) for r in M.resolved_python(python, files).collect()}
    assert got == {("pkg/__init__.py", "pkg.a", "pkg/a.py"), ("pkg/__init__.py", "pkg.b", "pkg/b.py"), ("pkg/a.py", "os", None), ("pkg/a.py", "pkg.b", "pkg/b.py"), ("pkg/a.py", "pkg", "pkg/__init__.py")}
    scripts = spark.createDataFrame([("web/app.ts", x) for x in ("./lib/x", "../web/y", "@/z", "react")], "path string, specifier string")
    found = {r.specifier: r.target_path for r in M.resolved_scripts(scripts, files, {"@/*": ["web/*", "src/*"]}).collect()}
    assert found == {"./lib/x": "web/lib/x/index.tsx", "../web/y": "web/y.js", "@/z": "src/z.mjs", "react": None}


REFS = [
    ("[a](b/c.md) [d](<x y>) [e]() f](g.md) [h](https://i.org/j) [k](l.py#m) [n](mailto:o@p.md)", {("doc", "b/c.md"), ("url", "https://i.org/j"), ("file", "l.py")}),
    ("`a/b` ``c.TOML`` `d e.py` `f::g` `no end h/i", {("file", "a/b"), ("file", "c.TOML")}),
    ("x `a.md\nb.md` `c.md`", set()),
    ("see src/a.py::run, .\\w\\b.ts::T() c::d e.toolong_x::f", {("symbol", "src/a.py::run"), ("file", "src/a.py"), ("symbol", "w/b.ts::T"), ("file", "w/b.ts")}),
    ("#1 (#22) [#3](x) a#4 #5x #1234567 \n#6, #6", {("issue", "1"), ("issue", "22"), ("issue", "6")}),
    ("~~~\n[a](b.md)\n~~~\n[c](d.md)\n```py\n#9 [e](f.md)", {("doc", "d.md")}),
    ("[`src/x.go`](./docs//y.md)", {("file", "src/x.go"), ("doc", "docs/y.md")}),
    ("", set()),
]


def test_refs(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(REFS)], "k int, t string").select("k", L.extract_refs(F.col("t")).alias("r")).collect()
    assert {r.k: {tuple(x) for x in r.r} for r in rows} == {k: want for k, (_, want) in enumerate(REFS)}


BOXES = [("-[x] a", (1, 1)), ("*[ ] a\n  - [X] b\n-   [x] c", (2, 3)), ("+ [x] a", None), ("1. [x] a", None), ("-[y] a\n- [ ]", (0, 1)), ("text - [x]", None)]


def test_boxes(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(BOXES)], "k int, t string").select("k", L.checkboxes(F.col("t")).alias("b")).collect()
    assert {r.k: r.b and (r.b.checked, r.b.total) for r in rows} == {k: want for k, (_, want) in enumerate(BOXES)}


def walked(value, path="$", top=None):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walked(v, f"{path}.{k}", top or (k if path == "$" else None))
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from walked(v, f"{path}[{k}]", top)
    else:
        yield path, top, None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def test_json_leaves(spark):
    texts = ['{"a": {"b": [1, "x.js", {"c": null, "d": true}]}, "k.js": {}}', "[]", "7", '[[["deep"]]]', "{broken", None, '{"x": "é\\n\\"q\\""}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = {(r.id, r.path, r.top, r.value) for r in N.leaves(df, "id", "j").collect()}
    assert got == {(k, *x) for k, t in enumerate(texts) if t and t != "{broken" for x in walked(json.loads(t))}
    assert N.leaves(df.limit(0), "id", "j").count() == 0


def test_script_entries(spark):
    manifests = [("", '{"main": "./a.js", "name": "b.js", "exports": {"./feature.js": "./dist/feature.js", ".": [{"x": ["../c.mjs"]}]}}'), ("w", '{"bin": {"r": "bin/run.cjs"}, "scripts": {"s": "tsx server/i.ts && y.py", "n.js": 1}, "scripts2": "z.js"}'), ("v", "[]")]
    df = spark.createDataFrame(manifests, "folder string, json string")
    assert {r.path for r in N.script_entries(df).collect()} == {"a.js", "dist/feature.js", "c.mjs", "w/bin/run.cjs", "w/server/i.ts"}


def test_refs_and_frontmatter(spark):
    text = "---\nstatus: 'Done'\ntype: plan # c\nother: 1\n---\n[a](./x/y.md#z) [b](https://q.org/p) `src/m.py` and lib/n.ts::go (#12) `not a path`\n```\n[c](no.md)\n```\n#7 [d](mailto:x)\n- [x] a\n  * [ ] b\n"
    r = spark.createDataFrame([(text,), ("plain",), (None,)], "t string").select(L.extract_refs(F.col("t")).alias("r"), L.frontmatter(F.col("t")).alias("f"), L.checkboxes(F.col("t")).alias("b")).collect()
    assert {tuple(x) for x in r[0].r} == {("url", "https://q.org/p"), ("doc", "x/y.md"), ("symbol", "lib/n.ts::go"), ("file", "lib/n.ts"), ("file", "src/m.py"), ("issue", "12"), ("issue", "7")}
    assert r[0].f == {"status": "Done", "type": "plan"} and tuple(r[0].b) == (1, 2, 0.5) and r[1].r == [] and r[1].f is None and r[2].b is None


def test_entry_files(spark):
    paths = {"a/x.test.ts": True, "e2e/y.ts": True, "vite.config.js": True, ".eslintrc.cjs": True, "app/page.tsx": True, "lib/page.tsx": False, "pages/q.ts": True, "x.ts": False}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", R.is_entry_file(F.col("p")).alias("e")).collect()
    assert {r.p: r.e for r in rows} == paths


def test_cycles(spark):
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "b"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "d"), ("x", "x")]
    edges = spark.createDataFrame(links, "src_id string, dst_id string")
    got = {(r.cycle, r.length) for r in G.import_cycles(edges).collect()}
    assert got == {("a>b", 2), ("a>c", 2), ("b>c", 2), ("a>b>c", 3), ("d>e>f>g", 4)}
    assert [r.cycle for r in G.import_cycles(edges, 6, 2).collect()] == ["a>b", "a>c"]


def test_writer(spark):
    calls, lost = [], []

    def write(batch, number):
        calls.append(number)
        if number:
            raise RuntimeError("no")

    run = V.retrying(write, lambda batch, number, error: lost.append((batch.count(), error)), most=2)
    run(spark.range(5), 0), run(spark.range(5), 1)
    assert calls == [0, 1, 1] and lost == [(2, "no")]


def test_daily_jobs(spark):
    rows = spark.sql("select * from values ('decay', timestamp'2024-01-10 01:00:00'), ('reflection', timestamp'2024-01-10 03:00:00'), ('prune', timestamp'2024-01-07 02:00:00'), ('decay2', cast(null as timestamp)) as t(job, ran_at)")
    due = {r.job: r.due for r in V.daily_jobs(rows, F.lit("2024-01-10 04:00:00").cast("timestamp")).collect()}
    assert due["decay"] and not due["reflection"] and due["prune"]


def test_synthetic_store(spark):
    rows = S.synthetic_store(spark, 4000, 3)
    share = {r.memory_type: r["count"] / 4000 for r in rows.groupBy("memory_type").count().collect()}
    assert abs(share["belief"] - 0.55) < 0.03 and abs(share["world_model"] - 0.08) < 0.02
    assert rows.where("age_days < 0 or age_days > 730 or size(tags) > 2").count() == 0 and rows.collect() == S.synthetic_store(spark, 4000, 3).collect()


REMOTES = {"https://User@Host.org:8443/Org/r.git/": "host.org/org/r", "git@host.org:Org/R.git": "host.org/org/r", "host.org:r": "host.org/r", "C:\\work\\x": "c:\\work\\x", "C:/work/x": "c:/work/x", "/srv/x.git": "srv/x", "http://h.org/a?x#y": "h.org/a", "ssh://h": "h", "a/b:c": "a/b:c", "": "", None: None}


def test_git_place(spark):
    rows = spark.createDataFrame([(k,) for k in REMOTES], "r string")
    assert {r.r: r.p for r in rows.select("r", R.git_place(F.col("r")).alias("p")).collect()} == REMOTES
