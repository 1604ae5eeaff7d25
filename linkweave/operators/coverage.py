"""Coverage: which specs are covered, which code belongs to none, and the aggregates of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CODE, SPEC, TEST, VERIFIES
from .graph import TraceGraph, covering


def orphan_specs(graph: TraceGraph) -> DataFrame:
    """Specs that no covering edge reaches."""
    hit = covering(graph.edges).select(F.col("dst_id").alias("id"))
    return graph.nodes.filter(F.col("type") == SPEC).join(hit, "id", "left_anti")


def orphan_code(graph: TraceGraph) -> DataFrame:
    """Code and tests that no covering edge reaches and that no edge leaves."""
    hit = covering(graph.edges).select(F.col("dst_id").alias("id")).union(graph.edges.select("src_id"))
    return graph.nodes.filter(F.col("type").isin(CODE, TEST)).join(hit, "id", "left_anti")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * part / whole, 1))


def spec_refs(graph: TraceGraph) -> DataFrame:
    """Each spec with its covering in-edges (refs), those that verify (verified), and its status: covered, partial or orphan."""
    counts = covering(graph.edges).groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("refs"), F.count_if(F.col("relation") == VERIFIES).alias("verified"))
    rows = graph.nodes.filter(F.col("type") == SPEC).join(counts, "id", "left").fillna(0, ["refs", "verified"])
    return rows.withColumn("status", F.when(F.col("verified") > 0, "covered").when(F.col("refs") > 0, "partial").otherwise("orphan"))


def summary(graph: TraceGraph, *by: str) -> DataFrame:
    """total, covered, orphan and coverage_pct of the specs, over all or by columns of the nodes."""
    rows = spec_refs(graph)
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("refs") > 0).alias("covered"))
    return out.withColumn("orphan", F.col("total") - F.col("covered")).withColumn("coverage_pct", percent(F.col("covered"), F.col("total")))


def gate(graph: TraceGraph, least: float = 50.0) -> DataFrame:
    """summary with passed, min_pct and a message."""
    out = summary(graph).withColumn("passed", F.col("coverage_pct") >= least).withColumn("min_pct", F.lit(float(least)))
    verdict = F.when(F.col("passed"), "passed").otherwise("failed")
    return out.withColumn("message", F.concat(F.lit("coverage "), verdict, F.lit(": "), F.col("covered").cast("string"), F.lit("/"), F.col("total").cast("string")))


def type_counts(graph: TraceGraph) -> DataFrame:
    return graph.nodes.groupBy("type").agg(F.count("*").alias("n"))


def origin_histogram(graph: TraceGraph) -> DataFrame:
    """By origin: nodes, specs and orphan specs."""
    orphans = orphan_specs(graph).select("id", F.lit(1).alias("alone"))
    rows = graph.nodes.join(orphans, "id", "left")
    return rows.groupBy("framework_origin").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("type") == SPEC).alias("n_specs"), F.count("alone").alias("n_orphans"))


def delta(before: float, after: float) -> float:
    return round(after - before, 1)
