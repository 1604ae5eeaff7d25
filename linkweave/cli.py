"""``python -m linkweave.cli COMMAND PROJECT``: the engine's queries over a project, printed."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, guard
from .operators import boundary, coverage, graph, infer, parse, structure
from .plans import adapters, render, snapshot
from .scratch import store
from .sources import git, tags
from .sources.projfiles import walk
from .sources.project import code_candidates, source_texts, spec_candidates


def _print(rows: DataFrame, a: argparse.Namespace, line=lambda r: "  ".join(map(str, r))) -> None:
    """All rows, or the first ``--top`` and on stderr that there are more."""
    for n, r in enumerate((rows if a.top is None else rows.limit(a.top + 1)).toLocalIterator()):
        if n == a.top:
            print(f"only the first {n} are shown", file=sys.stderr)
            break
        print(json.dumps(r.asDict(True), ensure_ascii=False) if a.json else line(r))


def _reasons(r) -> str:
    """A row with the first two of its pieces of evidence."""
    shown = "  ".join(str(r[c]) for c in r.__fields__ if c != "evidence")
    return "\n".join([shown, *[f"    {e['kind']}: {e['value']}" for e in (r["evidence"] or [] if "evidence" in r.__fields__ else [])[:2]]])


def _write(path: str, root: str, parts) -> None:
    with open(guard.allowed(path, root), "w", encoding="utf-8") as f:
        f.writelines(parts)


def _graph(spark: SparkSession, a: argparse.Namespace) -> graph.TraceGraph:
    if a.merge:
        return adapters.merged(spark, a.project)
    one = adapters.best(a.project)
    return one.analyze(spark, a.project) if one else adapters.empty(spark)


def analyze(spark, a) -> int:
    g = _graph(spark, a)
    if a.deps:
        files = g.nodes.filter(F.col("type").isin("code", "test") & ~F.contains("id", F.lit("::")) & F.col("imports").isNotNull()).select("file", "imports", "ord")
        more = structure.import_edges(files, g.edges)
        g = graph.TraceGraph(g.nodes, g.edges.unionByName(more.withColumn("ord", F.lit(1 << 60)), allowMissingColumns=True))
    if a.html:
        _write(a.html, a.project, render.html_parts(g))
    if a.json:
        sys.stdout.writelines([*render.json_parts(g), "\n"])
    else:
        print(render.graph_text(g, 20 if a.top is None else a.top))
    return 0


def show_coverage(spark, a) -> int:
    g = _graph(spark, a)
    if a.html:
        _write(a.html, a.project, render.coverage_parts(g))
    row = coverage.gate(g, config.load(a.project).min_coverage if a.min is None else a.min).first()
    row = row.asDict() if row else {"total": 0, "covered": 0, "coverage_pct": 0.0, "passed": False}
    print(json.dumps(row) if a.json else render.coverage_line(row["coverage_pct"], row["covered"], row["total"]))
    return 0 if row["passed"] or not a.gate else 1


def impact(spark, a) -> int:
    g = _graph(spark, a)
    if a.file:
        _print(graph.reverse_impact(g, a.file).orderBy("spec_id"), a)
        return 0
    _print(graph.forward_impact(g, a.spec, evidence="evidence" in g.edges.columns).orderBy("spec_id", "strength", "src_id"), a, _reasons)
    if a.calls:
        calls, functions = _calls(spark, a.project)
        seeds = structure.impact_seeds(g, functions, a.spec)
        _print(structure.transitive_impact(seeds, calls, functions, a.depth).orderBy("depth", "file"), a)
        _print(structure.traversed(structure.reach(seeds, calls, a.depth), calls).orderBy("caller", "callee"), a)
    return 0


def _calls(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """Call edges of a project's sources and its functions (file, name, ord, key)."""
    cfg = config.load(root)
    texts = source_texts(spark, root, cfg.source_dirs, cfg.source_files, frozenset(cfg.exclude_dirs))
    functions = parse.function_blocks(texts).join(texts.select("path", "ord"), "path").select(F.col("path").alias("file"), "name", (F.col("ord") * (1 << 24) + F.col("line")).alias("ord"), F.concat("path", F.lit("::"), "name").alias("key"))
    called = texts.select(F.col("path").alias("file"), F.explode(parse.calls(F.col("text"))).alias("name"))
    return structure.call_edges(called, functions), functions


def call_graph(spark, a) -> int:
    """All calls, or with ``--file`` (``file::name``) the functions that one calls and is called by."""
    calls, _ = _calls(spark, a.project)
    _print(structure.neighbours(calls, a.file).orderBy("direction", "key") if a.file else calls.orderBy("caller", "callee"), a)
    return 0


def take_snapshot(spark, a) -> int:
    print(snapshot.save(snapshot.current(spark, a.project), a.project, a.path, a.reason))
    return 0


def show_drift(spark, a) -> int:
    if a.git:
        try:
            changed = git.changed_files(spark, a.project, a.git)
        except git.GitError as e:
            print(e, file=sys.stderr)
            return 2
        _print(graph.git_drift(_graph(spark, a), changed).orderBy("file"), a)
        return 0
    before = snapshot.read(spark, a.path or os.path.join(a.project, guard.OWN_DIR, "snapshot.json"))
    if before is None:
        print("no snapshot", file=sys.stderr)
        return 2
    report = snapshot.compare(before, snapshot.current(spark, a.project))
    if a.json:
        print(json.dumps(report.counts()))
        _print(report.details().orderBy("category", "key", "line"), a)
    else:
        for line in report.lines():
            print(line)
    return 1 if a.gate and report.has_drift else 0


def diff(spark, a) -> int:
    one, two = snapshot.read(spark, a.path), snapshot.read(spark, a.other)
    if one is None or two is None:
        print("no snapshot", file=sys.stderr)
        return 2
    found = snapshot.difference(one, two)
    print(json.dumps(found, ensure_ascii=False) if a.json else "\n".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in found.items()))
    return 0


def validate_boundary(spark, a) -> int:
    found, marks = tags.tag_graph(store(tags.extract_tags(tags.tagged_files(spark, a.project))))
    bad = boundary.violations(found, marks).orderBy("spec_id", "code_file")
    _print(bad, a)
    return int(not bad.isEmpty())


def suggest(spark, a) -> int:
    cfg = config.load(a.project)
    specs, codes = store(spec_candidates(spark, a.project, cfg.spec_dirs, cfg.spec_files)), store(code_candidates(spark, a.project, cfg.source_dirs, cfg.source_files))
    alone = coverage.orphan_specs(adapters.heuristic_graph(specs, codes)).select(F.col("id").alias("auto_id"))
    s, c = (store(x) for x in adapters.match_inputs(specs.join(alone, "auto_id", "left_semi"), codes))
    rows = infer.suggest(s, c, 3 if a.top is None else a.top).join(s.select("spec_id", "auto_id"), "spec_id").select("auto_id", "code_id", "score", "rank")
    _print(rows.orderBy("auto_id", "rank"), argparse.Namespace(top=None, json=a.json))
    return 0


def _dirty(root: str) -> bool:
    """Whether git lists uncommitted files; a project that git can't answer for counts as dirty where it has a repository."""
    try:
        return git.dirty_count(root) > 0
    except git.GitError:
        return os.path.exists(os.path.join(root, ".git"))


def session_check(spark, a) -> int:
    """2 on a blocker (coverage below the gate), 1 on a warning (drift, orphans, uncommitted files), else 0."""
    g, cfg = _graph(spark, a), config.load(a.project)
    row = coverage.gate(g, cfg.min_coverage).first()
    before = snapshot.read(spark, os.path.join(a.project, guard.OWN_DIR, "snapshot.json"))
    warnings = [n for n, bad in (("orphan code", not coverage.orphan_code(g).isEmpty()), ("uncommitted files", _dirty(a.project)), ("drift", before is not None and snapshot.compare(before, snapshot.current(spark, a.project)).has_drift)) if bad]
    blockers = [] if row is None or row["passed"] else [row["message"]]
    print(json.dumps({"blockers": blockers, "warnings": warnings}))
    return 2 if blockers else 1 if warnings else 0


def _summary(g: graph.TraceGraph) -> dict:
    row = coverage.summary(g).first()
    return row.asDict() if row else {}


def status(spark, a) -> int:
    g = _graph(spark, a)
    row = coverage.summary(g).first()
    own = {x.name: {"score": s, "coverage": _summary(x.analyze(spark, a.project))} for s, x in adapters.detected(a.project)}
    print(json.dumps({"adapters": own, "types": {r["type"]: r["n"] for r in coverage.type_counts(g).collect()}, "coverage": row.asDict() if row else {}}))
    return 0


def show_config(spark, a) -> int:
    cfg = config.load(a.project, a.path)
    print(cfg.dump())
    problems = cfg.problems(a.project)
    print("\n".join(problems), file=sys.stderr)
    return int(bool(problems))


def init(spark, a) -> int:
    """Write the settings in force as the project's settings file, unless it has one."""
    path = os.path.join(a.project, config.FILE)
    if os.path.exists(path):
        print(f"{path} is there already", file=sys.stderr)
        return 1
    with open(path, "w", encoding="utf-8") as f:
        f.write(config.load(a.project).dump())
    return 0


def watch(spark, a) -> int:
    """Print the merged graph whenever files change, at most every ``--interval`` seconds; ``--rounds`` looks, 0 for ever."""
    seen, last, looks = None, None, 0
    while not a.rounds or looks < a.rounds:
        now = {p: os.stat(p).st_mtime_ns for p in walk(a.project)}
        if now != seen and (last is None or time.monotonic() - last >= a.interval):
            seen, last = now, time.monotonic()
            print(render.graph_text(adapters.merged(spark, a.project), 20 if a.top is None else a.top), flush=True)
        looks += 1
        if not a.rounds or looks < a.rounds:
            time.sleep(min(1.0, a.interval))
    return 0


def plugins(spark, a) -> int:
    print("\n".join(sorted(adapters.adapters())))
    return 0


COMMANDS = {
    "analyze": analyze, "call-graph": call_graph, "config": show_config, "coverage": show_coverage, "diff": diff, "drift": show_drift, "impact": impact, "init": init,
    "plugins": plugins, "session-check": session_check, "snapshot": take_snapshot, "status": status, "suggest": suggest, "validate-boundary": validate_boundary, "watch": watch,
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="linkweave", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("project", nargs="?", default=".")
    for flag in ("merge", "json", "deps", "gate", "calls"):
        p.add_argument(f"--{flag}", action="store_true")
    for name in ("spec", "file", "path", "other", "git", "html"):
        p.add_argument(f"--{name}")
    p.add_argument("--reason", default="")
    p.add_argument("--min", type=float)
    p.add_argument("--top", type=int)
    p.add_argument("--depth", type=int, default=3)
    p.add_argument("--interval", type=float, default=2.0)
    p.add_argument("--rounds", type=int, default=0)
    a = p.parse_args(args)
    if a.command == "impact" and bool(a.spec) == bool(a.file):
        p.error("impact needs either --spec or --file")
    return COMMANDS[a.command](spark or SparkSession.builder.appName("linkweave").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
