"""Graphs from a mapping file (ids to spec and code files) and from imported call graphs."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import TraceGraph, first_edges, last_wins
from ..operators.structure import resolve_symbols
from ..schema import CODE, EDGES, EXPLICIT, IMPLEMENTS, SPEC

#: Default place of the mapping file; settings may name another.
MAPPING = ".trace/mapping.yaml"
_NODES = "id string, type string, title string, file string, line int, framework_origin string, confidence double, ord long"
_CALLS = "symbol string, name string, file string, filepath string, callees array<string>, calls array<string>, callers array<string>, called_by array<string>"


def read_mapping(spark: SparkSession, root: str, file: str = MAPPING) -> TraceGraph:
    """Specs, code and explicit edges of a project's mapping file; none, if it is missing or broken."""
    try:
        data = yaml.safe_load(Path(root, file).read_text("utf-8"))
    except (OSError, ValueError, yaml.YAMLError):
        data = None
    entries = data.get("mappings") if isinstance(data, dict) else None
    nodes, edges = [], []
    for e in entries if isinstance(entries, list) else []:
        key = str(e.get("id") or "") if isinstance(e, dict) else ""
        if not key:
            continue
        if e.get("spec"):
            sure = 0.9 if "@spec" in (e.get("tags") or []) else 0.7
            nodes.append((key, SPEC, str(e.get("description", key)), str(e["spec"]), None, "tags", sure, len(nodes)))
        code = e.get("code") or {}
        for f in code.get("files") or []:
            nodes.append((f"{key}::{f}", CODE, " ".join(code.get("symbols") or []) or f, f, None, "tags", 0.9, len(nodes)))
            edges.append((f"{key}::{f}", key, IMPLEMENTS, EXPLICIT, [("mapping", f"{file} id={key}", file, None)], len(edges)))
    return TraceGraph(last_wins(spark.createDataFrame(nodes, _NODES)), first_edges(spark.createDataFrame(edges, EDGES)))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """(caller, callee) of a call-graph JSON: a list of symbols, or one below ``symbols`` or ``results``; none from a broken file."""
    text = spark.read.text(path, wholetext=True) if Path(path).is_file() else spark.createDataFrame([], "value string")
    kind = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in _CALLS.split(', '))}>>"
    wrapped = F.from_json("value", f"struct<symbols:{kind},results:{kind}>")
    rows = text.select(F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", kind)).otherwise(F.coalesce(wrapped["symbols"], wrapped["results"])).alias("rows")).select(F.posexplode("rows").alias("ord", "r"))
    rows = rows.select(F.col("ord").cast("long").alias("ord"), F.coalesce("r.symbol", "r.name").alias("symbol"), F.coalesce("r.file", "r.filepath").alias("file"), F.coalesce("r.callees", "r.calls").alias("callees"), F.coalesce("r.callers", "r.called_by").alias("callers")).filter("symbol is not null")
    down = resolve_symbols(rows.select("ord", "symbol", F.coalesce("file", F.lit("")).alias("file"), "callees"))
    up = resolve_symbols(rows.select("ord", "symbol", F.coalesce("file", F.lit("")).alias("file"), F.col("callers").alias("callees")))
    return down.union(up.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))).distinct()
