"""Text, JSON and HTML of a graph.

Documents are generators of text: rows come from the executors a partition at a time and
are written as they come, so none is cut and none is held whole.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage
from ..operators.graph import TraceGraph, display_rows


def coverage_line(pct: float, covered: int, total: int) -> str:
    light = "🟢" if pct >= 80 else "🟡" if pct >= 50 else "🔴"
    return f"{light} {pct:.1f} % ({covered}/{total} specs)"


def graph_text(graph: TraceGraph, top: int = 20) -> str:
    """Counts, then the first ``top`` specs and code files in order of insertion, by id; what is left out is counted."""
    s = coverage.summary(graph).first()
    files = graph.nodes.filter(F.col("type").isin("code", "test") & ~F.contains("id", F.lit("::")))
    refs = coverage.spec_refs(graph).orderBy("ord").limit(top).orderBy("id").collect()
    code = files.orderBy("ord").limit(top).orderBy("id").collect()
    out = [coverage_line(*((s["coverage_pct"], s["covered"], s["total"]) if s else (0.0, 0, 0))), "", "Specs:"]
    out += [f"  {r['id']}  {r['title']}  " + (f"{r['refs']} refs" if r["refs"] else "(unlinked)") for r in refs]
    out += _more((s["total"] if s else 0) - len(refs))
    out += ["", "Code:", *[f"  {r['id']}  ({r['type']})" for r in code]]
    return "\n".join([*out, *(_more(files.count() - len(code)) if len(code) == top else [])])


def _more(n: int) -> list[str]:
    return [f"  ... and {n} more"] if n > 0 else []


def graph_rows(graph: TraceGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as one JSON text a row, to be written by executors."""
    return graph.nodes.select(F.to_json(F.struct("*")).alias("json")), graph.edges.select(F.to_json(F.struct("*")).alias("json"))


def _list(items: Iterable[str]) -> Iterator[str]:
    for n, x in enumerate(items):
        yield f", {x}" if n else x


def json_parts(graph: TraceGraph) -> Iterator[str]:
    """One JSON document of all nodes and edges; for graphs beyond a file's reach there is ``graph_rows``."""
    nodes, edges = graph_rows(graph)
    yield '{"version": 1, "nodes": ['
    yield from _list(r[0] for r in nodes.toLocalIterator())
    yield '], "edges": ['
    yield from _list(r[0] for r in edges.toLocalIterator())
    yield "]}"


def graph_json(graph: TraceGraph) -> str:
    return "".join(json_parts(graph))


_DRAW = """
const g = JSON.parse(document.getElementById('graph').textContent), at = {}, rows = {}, ns = 'http://www.w3.org/2000/svg';
const kinds = [...new Set(g.nodes.map(n => n.type))], svg = document.getElementById('drawing');
const add = (name, attributes, text) => { const e = document.createElementNS(ns, name); for (const k in attributes) e.setAttribute(k, attributes[k]); if (text) e.textContent = text; svg.appendChild(e); };
for (const n of g.nodes) { const y = rows[n.type] = (rows[n.type] || 0) + 1; at[n.id] = [40 + 460 * kinds.indexOf(n.type), 24 * y]; }
svg.setAttribute('width', 460 * kinds.length + 80); svg.setAttribute('height', 24 * Math.max(1, ...Object.values(rows)) + 40);
for (const [a, b, relation] of g.links) if (at[a] && at[b]) add('line', {x1: at[a][0], y1: at[a][1], x2: at[b][0], y2: at[b][1], class: relation});
for (const n of g.nodes) { const [x, y] = at[n.id]; add('circle', {cx: x, cy: y, r: 5, class: n.type}); add('text', {x: x + 9, y: y + 4}, n.label); }
"""
_STYLE = "line{stroke:#bbb}line.implements{stroke:#4a8}line.verifies{stroke:#48c}text{font:11px sans-serif}circle{fill:#888}circle.spec{fill:#c63}circle.code{fill:#4a8}circle.test{fill:#48c}"


def html_parts(graph: TraceGraph) -> Iterator[str]:
    """A page that draws all nodes, a column a type, with a line for each edge; it holds the drawing's data and needs nothing else."""
    safe = lambda x: json.dumps(x, ensure_ascii=False).replace("</", "<\\/")
    yield f"<!doctype html><meta charset='utf-8'><title>Trace graph</title><style>{_STYLE}</style><svg id='drawing'></svg><script type='application/json' id='graph'>"
    yield '{"nodes": ['
    yield from _list(safe(r.asDict()) for r in display_rows(graph.nodes).toLocalIterator())
    yield '], "links": ['
    yield from _list(safe([r["src_id"], r["dst_id"], r["relation"]]) for r in graph.edges.select("src_id", "dst_id", "relation").toLocalIterator())
    yield f"]}}</script><script>{_DRAW}</script>"


def graph_html(graph: TraceGraph) -> str:
    return "".join(html_parts(graph))


def coverage_parts(graph: TraceGraph) -> Iterator[str]:
    """A table of all specs with their state as the row's class."""
    yield "<!doctype html><meta charset='utf-8'><title>Coverage</title><table><tr><th>id<th>title<th>refs<th>state"
    for r in coverage.spec_refs(graph).orderBy("id").toLocalIterator():
        yield f"<tr class='{r['status']}'><td>{html.escape(r['id'])}<td>{html.escape(r['title'] or '')}<td>{r['refs']}<td>{r['status']}"
    yield "</table>"


def coverage_html(graph: TraceGraph) -> str:
    return "".join(coverage_parts(graph))
