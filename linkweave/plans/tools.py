"""The engine as plain functions from a project to small results, for tool servers and scripts.

All but ``snapshot`` and ``drift`` look at the merged graph.  Lists are whole unless ``top`` says how many rows are wanted.
"""

from __future__ import annotations

import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from .. import config as settings
from ..guard import OWN_DIR
from ..operators import boundary as bounds
from ..operators import coverage as cover
from ..operators import graph as graphs
from ..scratch import store
from ..sources import tags
from . import adapters, render
from . import snapshot as snapshots


def _rows(df: DataFrame, top: int | None) -> list[dict]:
    return [r.asDict(True) for r in (df if top is None else df.limit(top)).toLocalIterator()]


def analyze(spark: SparkSession, root: str, top: int = 20) -> str:
    return render.graph_text(adapters.merged(spark, root), top)


def impact(spark: SparkSession, root: str, spec: str | None = None, file: str | None = None, top: int | None = None) -> list[dict]:
    g = adapters.merged(spark, root)
    return _rows(graphs.reverse_impact(g, file) if file else graphs.forward_impact(g, spec or "", evidence=True), top)


def coverage(spark: SparkSession, root: str) -> dict:
    return next(iter(_rows(cover.summary(adapters.merged(spark, root)), 1)), {"total": 0, "covered": 0})


def gate(spark: SparkSession, root: str, least: float | None = None) -> dict:
    least = settings.load(root).min_coverage if least is None else least
    return next(iter(_rows(cover.gate(adapters.merged(spark, root), least), 1)), {"passed": False, "min_pct": least})


def snapshot(spark: SparkSession, root: str, reason: str = "") -> str:
    return snapshots.save(snapshots.current(spark, root), root, reason=reason)


def diff(spark: SparkSession, one: str, other: str) -> dict | None:
    """Two snapshot files compared, None if one is missing or broken."""
    before, after = snapshots.read(spark, one), snapshots.read(spark, other)
    return None if before is None or after is None else snapshots.difference(before, after)


def drift(spark: SparkSession, root: str) -> dict | None:
    """Changes by category since the project's snapshot, None without one."""
    before = snapshots.read(spark, os.path.join(root, OWN_DIR, "snapshot.json"))
    return None if before is None else snapshots.compare(before, snapshots.current(spark, root)).counts()


def validate_boundary(spark: SparkSession, root: str, top: int | None = None) -> list[dict]:
    found, marks = tags.tag_graph(store(tags.extract_tags(tags.tagged_files(spark, root))))
    return _rows(bounds.violations(found, marks), top)


def config(root: str) -> dict:
    return asdict(settings.load(root))


def status(spark: SparkSession, root: str) -> dict:
    g = adapters.merged(spark, root)
    return {"adapters": {a.name: s for s, a in adapters.detected(root)}, "types": {r["type"]: r["n"] for r in cover.type_counts(g).collect()}}
