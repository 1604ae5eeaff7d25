"""Whole projects: scan, tags, graph, drift and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from linkweave import cli, config, guard
from linkweave.operators import boundary, coverage
from linkweave.operators.graph import TraceGraph, merge, normalise
from linkweave.plans import adapters, render, snapshot, tools
from linkweave.sources import graph_json, mapping, project, projfiles, python_ast, tags

LOGIN = '''"""Login. # @impl 9.9 is no tag here"""
from src.reports import charts


@decorate
def login_user(name):  # @impl 1.1, 1.2，1.3
    return check_password(name)


def check_password(name):
    return render_chart(name)
'''


@pytest.fixture
def tree(tmp_path):
    files = {
        "docs/auth.md": "# Authentication\n<!-- @spec 1.1 -->\n## Login user\nCheck the password of a user.\n_Boundary:_ src/auth/\n### Deep\n## Logout\n",
        "docs/index.md": "# Not a spec\n",
        "docs/more.yaml": "specs:\n  - id: 2\n    title: Reports\n    tags: [a, b]\n  - id: 2.1\n    title: Charts\n    parent: '2'\n    description: Render charts\n  - title: nameless\n",
        "docs/broken.yaml": "specs: [",
        "src/auth/login.py": LOGIN,
        "src/auth/__init__.py": "",
        "src/reports/charts.py": "def render_chart(x):\n    return x\n\n\nclass Chart:\n    pass\n",
        "src/.hidden.py": "x = 1\n",
        "src/node_modules/dep.js": "function no() {}\n",
        "src/app.ts": "import { a } from './reports/charts'\n// @verifies 1.1\nexport function start(x) { return a(x) }\n",
        "tests/test_login.py": "# @verifies 1.1\n",
        ".trace/mapping.yaml": "mappings:\n  - id: '1.1'\n    spec: docs/auth.md\n    description: Login\n    tags: ['@spec']\n    code: {files: [src/auth/login.py], symbols: [login_user]}\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, "utf-8")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe\x00")
    return tmp_path


def test_scan_order_and_exclusions(spark, tree):
    rows = projfiles.project_files(spark, str(tree), ["src"], projfiles.source_endings()).orderBy("ord").collect()
    assert [r["path"] for r in rows] == ["src/app.ts", "src/auth/__init__.py", "src/auth/login.py", "src/reports/charts.py"]


def test_spec_candidates(spark, tree):
    rows = {r["auto_id"]: r for r in project.spec_candidates(spark, str(tree), spec_files=["docs/index.md", "docs/auth.md"]).collect()}
    assert set(rows) == {"docs.auth.1", "docs.auth.1.1", "docs.auth.1.1.1", "docs.auth.1.2", "docs.index.1", "docs.more.2", "docs.more.2.1"}
    assert rows["docs.auth.1.1.1"]["parent_chain"] == ["Authentication", "Login user"]
    assert rows["docs.more.2.1"]["parent_chain"] == ["Reports"] and rows["docs.more.2.1"]["heading_depth"] == 2
    assert rows["docs.more.2"]["body_text"] == "Tags: a, b"
    with pytest.warns(UserWarning, match="no such file"):
        project.spec_candidates(spark, str(tree), spec_files=["docs/none.md"])


def test_depth_jumps_share_an_id(spark):
    from linkweave.operators import parse

    files = spark.createDataFrame([("docs/a.md", "# A\n### B\n## C\r\n", 0)], "path string, text string, ord long")
    assert [r["auto_id"] for r in parse.spec_rows(files).orderBy("line").collect()] == ["docs.a.1", "docs.a.1.1", "docs.a.1.1"]


def test_code_candidates(spark, tree):
    rows = {r["file"]: r for r in project.code_candidates(spark, str(tree)).collect()}
    login = rows["src/auth/login.py"]
    assert login["symbols"] == ["check_password", "login_user"] and login["imports"] == ["src.reports"] and login["module"] == "auth"
    assert [(f["name"], f["kind"], f["line"]) for f in rows["src/reports/charts.py"]["functions"]] == [("render_chart", "function", 1), ("Chart", "class", 5)]
    assert rows["src/auth/__init__.py"]["functions"] == [] and rows["src/app.ts"]["language"] == "TypeScript"


def test_tags(spark, tree):
    rows = tags.extract_tags(tags.tagged_files(spark, str(tree))).orderBy("file", "ord").collect()
    got = [(r["file"], r["kind"], r["value"], r["line"]) for r in rows]
    assert ("docs/auth.md", "spec", "1.1", 2) in got and ("docs/auth.md", "boundary", "src/auth/", 5) in got
    assert [g for g in got if g[0] == "src/auth/login.py"] == [("src/auth/login.py", "impl", "1.1, 1.2", 6)]
    assert tags.python_tags("x = '# @impl 1'\n# @impl 2\n(") == [("impl", "2", 2)]
    assert tags.tags_of(".md", "<!--\n@spec\n a b -->") == [("spec", "a b", 1)]
    assert tags.tags_of(".txt", "# @impl 1") == []


def test_tag_graph_dangles_until_resolved(spark, tree):
    g, marks = tags.tag_graph(tags.extract_tags(tags.tagged_files(spark, str(tree))))
    ids = {r["id"] for r in g.nodes.collect()}
    assert {"1.1::src/auth/login.py", "test-1.1::src/app.ts", "spec::1.1"} <= ids
    assert coverage.summary(g).first()["covered"] == 0
    assert coverage.summary(tags.resolve_bare(g)).first()["covered"] == 1
    bad = {r["code_file"] for r in boundary.violations(g, marks).collect()}
    assert bad == {"src/app.ts", "tests/test_login.py"}


def test_mapping(spark, tree, tmp_path):
    g = mapping.read_mapping(spark, str(tree))
    assert {(r["id"], r["confidence"]) for r in g.nodes.collect()} == {("1.1", 0.9), ("1.1::src/auth/login.py", 0.9)}
    (tree / ".trace/mapping.yaml").write_text("")
    assert mapping.read_mapping(spark, str(tree)).nodes.isEmpty()


def test_adapters(spark, tree):
    assert [(round(s, 2), a.name) for s, a in adapters.detected(str(tree))] == [(0.95, "tags"), (0.8, "heuristic")]
    g = adapters.HeuristicAdapter(functions=True).analyze(spark, str(tree))
    ids = {r["id"] for r in g.nodes.collect()}
    assert "src/auth/login.py::login_user" in ids and "docs.auth.1.1" in ids
    pairs = {(r["src_id"], r["dst_id"]) for r in g.edges.collect()}
    assert ("src/auth/login.py", "docs.auth.1.1") in pairs
    merged = adapters.merged(spark, str(tree))
    assert "spec::1.1" not in {r["id"] for r in merged.nodes.collect()}
    assert "0/" not in render.graph_text(merged)


def test_merge_is_idempotent_on_nodes(spark):
    n = spark.createDataFrame([("a", "spec", "x", 0.5, 0), ("b", "code", "y", 0.9, 1)], "id string, type string, title string, confidence double, ord long")
    e = spark.createDataFrame([("b", "a", "implements", "weak", 0)], "src_id string, dst_id string, relation string, strength string, ord long")
    g = merge(TraceGraph(n, e), TraceGraph(n, e))
    assert g.nodes.count() == 2 and g.edges.count() == 2
    assert normalise(g).nodes.count() == 2


def test_graph_json_and_ast(spark, tree):
    path = tree / "graph.json"
    path.write_text(json.dumps({"nodes": [{"id": "a", "source_file": "a.py", "source_location": "L7"}, {"label": "f", "source_file": "b.py"}, {"id": "p", "type": "package"}], "links": [{"source": "a", "target": "b.py::f", "relation": "imports", "confidence": "EXTRACTED"}, {"source": "a", "target": "p", "relation": "calls"}]}))
    nodes, edges = graph_json.read(spark, str(path))
    assert {(r["id"], r["line"]) for r in nodes.collect()} == {("a", 7), ("b.py::f", None)}
    assert [(r["dst_id"], r["relation"], r["strength"]) for r in edges.collect()] == [("b.py::f", "depends", "explicit")]
    assert [b[:3] for b in python_ast.blocks(LOGIN)] == [("login_user", "function", 5), ("login_user", "function", 6), ("check_password", "function", 10)]


def test_call_json(spark, tmp_path):
    path = tmp_path / "calls.json"
    path.write_text(json.dumps({"symbols": [{"symbol": "f", "file": "a.py", "callees": ["g"]}, {"name": "g", "filepath": "b.py", "calls": ["f"]}]}))
    assert {tuple(r) for r in mapping.read_calls(spark, str(path)).collect()} == {("b.py::g", "a.py::f")}
    path.write_text("{")
    assert mapping.read_calls(spark, str(path)).isEmpty()
    assert mapping.read_calls(spark, str(tmp_path / "none.json")).isEmpty()


def test_drift(spark, tree):
    root = str(tree)
    path = snapshot.save(snapshot.current(spark, root), root)
    same = snapshot.compare(snapshot.read(spark, path), snapshot.current(spark, root))
    assert not same.has_drift and same.text() == "No drift."
    (tree / "docs/auth.md").write_text("# Authentication\n<!-- @spec 1.1 -->\n## Login user\nAnother text.\n_Boundary:_ src/auth/\n### Deep\n", "utf-8")
    (tree / "src/reports/charts.py").write_text("def render_chart(x):\n    return 2 * x\n\n\nclass Chart:\n    pass\n")
    (tree / "src/new.py").write_text("def fresh(): pass\n")
    got = snapshot.compare(snapshot.read(spark, path), snapshot.current(spark, root)).counts()
    assert got["specs_body_changed"] == 2 and got["specs_removed"] == 1 and got["code_added"] == 1 and got["code_funcs_changed"] == 1
    assert snapshot.read(spark, str(tree / "none.json")) is None
    report = snapshot.compare(snapshot.read(spark, path), snapshot.current(spark, root))
    text = report.text()
    assert "  src/new.py  (Python)  fresh" in text and "docs.auth.1.2: Logout  (docs/auth.md)" in text and "coverage: " in text
    assert "src/reports/charts.py::render_chart  (function 1)" in text


def test_snapshot_difference(spark, tree):
    """A function that moved counts by its name; an orphan list is compared whole; details are the first few."""
    root = str(tree)
    one = snapshot.save(snapshot.current(spark, root), root, str(tree / ".linkweave/one.json"))
    (tree / "src/reports/charts.py").write_text("import os\n\n\ndef render_chart(x):\n    return 2 * x\n\n\nclass Chart:\n    pass\n")
    (tree / "docs/auth.md").write_text("# Authentication\n<!-- @spec 1.1 -->\n## Sign in\nCheck the password of a user.\n_Boundary:_ src/auth/\n### Deep\n" + "".join(f"## Zqx{i} unrelated\nbody {i}\n" for i in range(8)), "utf-8")
    two = snapshot.save(snapshot.current(spark, root), root, str(tree / ".linkweave/two.json"))
    got = snapshot.difference(snapshot.read(spark, one), snapshot.read(spark, two))
    assert got["funcs_changed"] == 1 and snapshot.compare(snapshot.read(spark, one), snapshot.read(spark, two)).functions.isEmpty()
    assert got["specs_changed"] == 2 and {d["new_title"] for d in got["changed_specs_detail"]} == {"Sign in", "Zqx0 unrelated"}
    assert got["specs_added"] == 7 and len(got["added_specs_detail"]) == 5 and got["added_specs_detail"][0]["title"] == "Zqx1 unrelated"
    assert got["orphans_after"] - got["orphans_before"] == got["new_orphans"] - got["resolved_orphans"] and got["new_orphans"] >= 7
    assert got["code_added"] == got["code_removed"] == got["specs_removed"] == 0 and set(got["coverage_before"]) == set(got["coverage_after"])
    assert tools.diff(spark, one, two) == got and tools.diff(spark, one, str(tree / "none.json")) is None


def test_nothing_is_cut(spark, capsys):
    """More rows than any list, page or document used to hold."""
    n = 2_500
    nodes = spark.range(n).selectExpr("concat('s', id) as id", "'spec' as type", "concat('Title ', id) as title", "'a.md' as file", "id as ord").unionByName(spark.createDataFrame([("c", "code", "c", "c.py", n)], "id string, type string, title string, file string, ord long"))
    edges = spark.range(4 * n + 10).selectExpr("'c' as src_id", "concat('s', id) as dst_id", "'implements' as relation", "'weak' as strength", "id as ord")
    g = TraceGraph(nodes, edges)
    doc = json.loads(render.graph_json(g))
    assert len(doc["nodes"]) == n + 1 and len(doc["edges"]) == 4 * n + 10
    page = json.loads(render.graph_html(g).split("id='graph'>")[1].split("</script>")[0])
    assert len(page["nodes"]) == n + 1 and len(page["links"]) == 4 * n + 10
    assert render.coverage_html(g).count("<tr class=") == n and f"... and {n - 3} more" in render.graph_text(g, 3)
    cli._print(edges.select("dst_id"), cli.argparse.Namespace(top=None, json=False))
    assert len(capsys.readouterr().out.splitlines()) == 4 * n + 10
    cli._print(edges.select("dst_id"), cli.argparse.Namespace(top=7, json=True))
    said = capsys.readouterr()
    assert len(said.out.splitlines()) == 7 and "only the first 7" in said.err
    assert len(tools._rows(edges, None)) == 4 * n + 10


def test_plugins_are_loaded(spark, tree, monkeypatch):
    """Entry points bring adapters; one that fails to load is left out."""
    from linkweave.examples.csv_adapter import CsvLinks

    class Point:
        def __init__(self, what):
            self.load = lambda: what() if what is broken else what

    def broken():
        raise RuntimeError("no such plugin")

    monkeypatch.setattr(adapters, "_LOADED", False)
    monkeypatch.setattr(adapters, "_REGISTRY", dict(adapters._REGISTRY))
    monkeypatch.setattr(adapters.importlib.metadata, "entry_points", lambda group: [Point(broken), Point(CsvLinks), Point(str)])
    assert "csv-links" in adapters.adapters()
    assert "csv-links" not in {a.name for _, a in adapters.detected(str(tree))}
    (tree / "links.csv").write_text("spec,file\n7.7,src/app.ts\n7.7,src/app.ts\n7.8,src/auth/login.py\n")
    assert "csv-links" in {a.name for _, a in adapters.detected(str(tree))}
    g = adapters.merged(spark, str(tree))
    assert {(r["src_id"], r["dst_id"]) for r in g.edges.filter("src_id in ('src/app.ts', 'src/auth/login.py') and dst_id like '7.%'").collect()} == {("src/app.ts", "7.7"), ("src/auth/login.py", "7.8")}


def test_broken_snapshots(spark, tmp_path):
    for text in ("", "{", "[1, 2"):
        (tmp_path / "s.json").write_text(text)
        assert snapshot.read(spark, str(tmp_path / "s.json")) is None


def test_git_failures_are_told(spark, tree):
    from linkweave.sources import git

    with pytest.raises(git.GitError):
        git.changed_files(spark, str(tree), "HEAD")
    assert cli.main(["drift", str(tree), "--git", "HEAD"], spark) == 2


def test_row_local_blocks(spark):
    from linkweave.operators import parse

    files = spark.createDataFrame([("a.md", "above\n# A\n## B\ntext\n\n# C"), ("b.md", "none"), ("c.md", ""), ("d.md", None)], "path string, text string")
    assert [tuple(r) for r in parse.sections(files).orderBy("path", "line").collect()] == [("a.md", 2, 1, "A", "# A"), ("a.md", 3, 2, "B", "## B\ntext\n"), ("a.md", 6, 1, "C", "# C")]
    assert "Exchange" not in parse.sections(files)._jdf.queryExecution().executedPlan().toString()


def test_long_files_split_in_one_pass(spark):
    import time

    from linkweave.operators import parse

    text = "= a\n+ b\n" + "".join(f"# {i}\n=x\n+y\n\n" for i in range(30_000)) + "## end\n"
    files = spark.createDataFrame([("a.md", text, 3)], "path string, text string, ord long")
    parse.sections(files.limit(0)).collect()
    began = time.time()
    rows = parse.sections(files, "ord").orderBy("line").collect()
    assert time.time() - began < 15 and len(rows) == 30_001
    assert tuple(rows[7]) == ("a.md", 3, 31, 1, "7", "# 7\n=x\n+y\n") and rows[-1]["body"] == "## end\n"


def test_numbers_need_one_sort(spark):
    from linkweave.operators import parse

    rows = [("a", 1, 1, "A"), ("a", 2, 3, "B"), ("a", 3, 2, "C"), ("a", 4, 2, None), ("a", 5, 3, "D"), ("a", 6, 1, "E"), ("a", 6, 2, "F"), ("a", 7, 2, "G"), ("b", 1, 2, "H")]
    out = parse.numbered(spark.createDataFrame(rows, "path string, line int, depth int, heading string"))
    assert [tuple(r) for r in out.select("path", "line", "number", F.array_join("parent_chain", ">")).orderBy("path", "line", "depth").collect()] == [
        ("a", 1, "1", ""), ("a", 2, "1.1", "A"), ("a", 3, "1.1", "A"), ("a", 4, "1.2", "A"), ("a", 5, "1.2.1", "A>C"), ("a", 6, "2", ""), ("a", 6, "2.1", "E"), ("a", 7, "2.2", "E"), ("b", 1, "1", "")
    ]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window ") <= 3 and out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


@pytest.mark.parametrize("query, work", [("func_blocks", "RLIKE"), ("title_clean", "RLIKE"), ("ast_blocks", "MapInPandas"), ("func_drift_by_line", "RLIKE")])
def test_parsing_follows_the_exchange(spark, query, work):
    from linkweave.plans.queries import QUERIES

    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = plan.split("Exchange hashpartitioning(path")
    assert len(dealt) > 1 and work in dealt[0]
    assert all(work not in below.split("Exchange")[0] for below in dealt[1:])


def test_folded_nodes_count_one_by_one(spark):
    n = [("docs.a.1.2", "x", 0.5, 0), ("spec::1.2", "y", 0.9, 1), ("spec::1.2", "z", 0.7, 2)]
    nodes = spark.createDataFrame(n, "id string, title string, confidence double, ord long").withColumn("type", F.lit("spec"))
    edges = spark.createDataFrame([], "src_id string, dst_id string, relation string, strength string, ord long")
    row = normalise(TraceGraph(nodes, edges)).nodes.collect()
    assert [r["aliases"] for r in row] == [["spec::1.2", "spec::1.2"]]
    again = normalise(TraceGraph(nodes.withColumn("aliases", F.array(F.lit("spec::1.2"))), edges)).nodes.collect()
    assert [r["aliases"] for r in again] == [["spec::1.2"]]


def test_hot_tokens_are_dealt(spark, monkeypatch):
    from linkweave.operators import infer

    s = spark.createDataFrame([(i, f"d{i % 2}/a.md", "a", ["shared", f"t{i}"]) for i in range(5)], "spec_id long, file string, stem string, tokens array<string>")
    c = spark.createDataFrame([(i, "d0/b.py", "b", ["shared", f"t{i}"], ["b"]) for i in range(40)], "code_id long, file string, stem string, tokens array<string>, stem_tokens array<string>")
    rows = lambda: sorted(tuple(r) for r in infer.score(infer.candidates(s, c), s, c).collect())
    whole = rows()
    monkeypatch.setattr(infer, "HOT", 3)
    assert rows() == whole and len(whole) == 200


def test_few_spec_tokens_meet_codes_where_they_are(spark, monkeypatch):
    from linkweave.operators import infer

    s = spark.createDataFrame([(i, f"d{i % 2}/a.md", "a", ["shared", f"t{i}", "b"]) for i in range(5)], "spec_id long, file string, stem string, tokens array<string>")
    c = spark.createDataFrame([(i, "d0/b.py", "b", ["shared", f"t{i}"], ["b", "shared"]) for i in range(40)], "code_id long, file string, stem string, tokens array<string>, stem_tokens array<string>")
    rows = lambda: sorted(tuple(r) for r in infer.token_pairs(s, c).collect())
    whole, plan = rows(), infer.token_pairs(s, c)._jdf.queryExecution().executedPlan().toString()
    assert len(whole) == 200 and (0, 0, 2, 2, ["shared", "t0"], ["b", "shared"]) in whole
    assert plan.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(code_id" in plan  # neither tokens nor pairs are sent
    for n in ("SMALL", "HOT"):
        monkeypatch.setattr(infer, n, 3)
        assert rows() == whole


def test_suggest_counts_and_ranks_pairs_where_codes_are(spark, monkeypatch):
    import re

    from linkweave.operators import infer

    s = spark.createDataFrame([(i, f"d{i % 2}/a.md", f"s{i}", ["shared", f"t{i}"]) for i in range(5)] + [(5, "a.md", "s1", [])], "spec_id long, file string, stem string, tokens array<string>")
    codes = [(i, f"d{i % 3}x/b.py" if i % 4 else "b.py", f"s{i % 8}", ["shared"] * (i % 2) + [f"t{i}"], ["b"] * (i % 2), -i) for i in range(40)]
    codes += [(40, "d1/c.py", None, ["shared"], None, 1), (41, None, "s4", None, [], 2)]
    c = spark.createDataFrame(codes, "code_id long, file string, stem string, tokens array<string>, stem_tokens array<string>, ord long")
    rows = lambda: sorted(tuple(r) for r in infer.suggest(s, c).collect())
    every = infer.score(s.select("spec_id").crossJoin(c.select("code_id")).join(infer.token_pairs(s, c), ["spec_id", "code_id"], "left").fillna(0), s, c).join(c.select("code_id", "ord"), "code_id").collect()
    best = {i: sorted((-r["confidence"], r["ord"], r["code_id"]) for r in every if r["spec_id"] == i and r["confidence"] >= 0.1)[:3] for i in range(6)}
    whole = sorted((i, code, round(-x, 3), n) for i, top in best.items() for n, (x, _, code) in enumerate(top, 1))
    assert rows() == whole and len(whole) == 18
    monkeypatch.setattr(infer, "PAIRS", 20)
    plan = infer.suggest(s, c)._jdf.queryExecution().executedPlan().toString()
    sent = {re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)}
    assert rows() == whole
    assert sent == {"code_id, 13", "spec_id, 2"}  # 6 * 42 pairs, 20 a task; what each task has left
    assert "SortMergeJoin" not in plan
    monkeypatch.setattr(infer, "SMALL", 3)
    monkeypatch.setattr(infer, "HOT", 3)
    assert rows() == whole


@pytest.mark.parametrize("query, table, most", [("impact_seeds", "lineitem", 0), ("snapshot_diff_full", "documents", 0), ("snapshot_diff_full", "lineitem", 0)])
def test_large_tables_are_read_before_the_last_plan(spark, query, table, most):
    from linkweave.plans.queries import QUERIES

    df = QUERIES[query](spark, "/root/testdata/sf0.001")
    assert sum(f"{table}.parquet" in f for f in df.inputFiles()) <= most


def test_guard(tmp_path):
    assert guard.allowed(tmp_path / ".linkweave/a/b.json", tmp_path)
    for bad in ("docs/x", "src/x", "x", "../x", ".linkweave/../src/x"):
        with pytest.raises(PermissionError):
            guard.allowed(tmp_path / bad, tmp_path)


def test_config(tmp_path):
    (tmp_path / "pyproject.toml").write_text("[tool.linkweave]\nmin_coverage = 70\nspec_dirs = ['a']\n")
    (tmp_path / ".linkweave.yaml").write_text("min_coverage: many\nsource_dirs: [b]\nunknown: 1\n")
    cfg = config.load(str(tmp_path))
    assert cfg.min_coverage == 70.0 and cfg.spec_dirs == ["a"] and cfg.source_dirs == ["b"]
    assert len(cfg.problems(str(tmp_path))) == 2
    (tmp_path / "broken.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        config.load(str(tmp_path), str(tmp_path / "broken.yaml"))
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path), str(tmp_path / "none.yaml"))


@pytest.mark.parametrize("args", [["analyze", "--merge", "--deps"], ["coverage", "--json"], ["impact", "--spec", "Login", "--calls"], ["impact", "--file", "login.py"], ["call-graph"], ["status"], ["suggest"], ["plugins"], ["validate-boundary"], ["session-check"], ["watch", "--rounds", "1"]])
def test_cli(spark, tree, capsys, args):
    assert cli.main([args[0], str(tree), *args[1:]], spark) in (0, 1, 2)
    assert capsys.readouterr().out or args[0] == "suggest"


def test_tools(spark, tree):
    assert tools.coverage(spark, str(tree))["total"] > 0 and tools.gate(spark, str(tree), 100.0)["passed"] is False
    assert tools.impact(spark, str(tree), spec="Login user") and tools.config(str(tree))["min_coverage"] == 50.0
    assert tools.validate_boundary(spark, str(tree)) and tools.drift(spark, str(tree)) is None


def test_pages(spark, tree):
    g = adapters.HeuristicAdapter().analyze(spark, str(tree))
    assert "type='application/json'" in render.graph_html(g) and "class='orphan'" in render.coverage_html(g)
    assert json.loads(render.graph_json(g))["nodes"]


def test_boundary_patterns(spark):
    from linkweave.functions.text import glob_regex

    cases = [("src/*.py", "src/a/b.py", True), ("src/a", "src/ab.py", True), ("src/[ab]?.py", "src/ax.py", True), ("src/[!a]x", "src/ax", False), ("a.b*", "axb", False), ("x[", "x[", True), ("x[*", "x[y", True), ("a(b", "a(bc", True)]
    rows = spark.createDataFrame(cases, "pattern string, path string, fits boolean").withColumn("regex", glob_regex(F.col("pattern")))
    assert rows.filter("(path rlike regex) <> fits").collect() == []
