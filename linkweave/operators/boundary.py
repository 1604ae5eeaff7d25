"""Boundaries: which paths a spec's code may lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..schema import BOUND, SPEC
from .graph import TraceGraph


def attach(tags: DataFrame, scope: str = "last") -> DataFrame:
    """(spec_id, path, file, line) of boundary tags of a file.

    ``last``: all of a file's boundaries belong to its last spec tag; ``preceding``:
    each to the nearest spec tag above it.
    """
    specs = tags.filter(F.col("kind") == "spec")
    marks = tags.filter(F.col("kind") == "boundary").select("file", F.col("value").alias("path"), "line")
    if scope == "last":
        owner = specs.groupBy("file").agg(F.max_by("value", F.struct("line", "ord")).alias("spec"))
        return marks.join(owner, "file").select(F.concat(F.lit("spec::"), "spec").alias("spec_id"), "path", "file", "line")
    w = Window.partitionBy("file").orderBy("line", F.col("kind") != "spec").rowsBetween(Window.unboundedPreceding, 0)
    rows = tags.filter(F.col("kind").isin("spec", "boundary")).withColumn("spec", F.last(F.when(F.col("kind") == "spec", F.col("value")), True).over(w))
    return rows.filter("kind = 'boundary' and spec is not null").select(F.concat(F.lit("spec::"), "spec").alias("spec_id"), F.col("value").alias("path"), "file", "line")


def violations(graph: TraceGraph, boundaries: DataFrame) -> DataFrame:
    """(spec_id, src_id, code_file) of implementing or verifying code outside all boundaries of its spec.

    ``boundaries`` has (spec_id, path).  A ``spec::N`` without such edges is judged by
    the edges of the bare N.
    """
    edges = graph.edges.filter(F.col("relation").isin(*BOUND)).select("src_id", "dst_id")
    bound = boundaries.select("spec_id").distinct().join(graph.nodes.filter(F.col("type") == SPEC).select(F.col("id").alias("spec_id")), "spec_id")
    own = bound.join(edges, F.col("spec_id") == F.col("dst_id")).select("spec_id", "src_id")
    bare = bound.join(own, "spec_id", "left_anti").filter(F.startswith("spec_id", F.lit("spec::"))).withColumn("bare", F.substring("spec_id", 7, 1 << 30))
    used = own.union(bare.join(edges, F.col("bare") == F.col("dst_id")).select("spec_id", "src_id"))
    files = used.join(graph.nodes.select(F.col("id").alias("src_id"), F.col("file").alias("code_file")), "src_id").filter("code_file <> ''")
    rules = boundaries.select("spec_id", glob_regex(F.col("path")).alias("regex")).distinct()
    return files.join(rules, (files["spec_id"] == rules["spec_id"]) & F.expr("code_file rlike regex"), "left_anti").select("spec_id", "src_id", "code_file")
