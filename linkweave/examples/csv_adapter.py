"""An adapter as a plugin would bring it: a graph from a CSV file of links.

A package offers it under the entry point group ``linkweave.adapters``:

    [project.entry-points."linkweave.adapters"]
    csv-links = "linkweave.examples.csv_adapter:CsvLinks"
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.graph import TraceGraph, first_edges, last_wins
from ..plans.adapters import Adapter
from ..schema import CODE, EXPLICIT, IMPLEMENTS, SPEC

FILE = "links.csv"


class CsvLinks(Adapter):
    """Lines of ``spec,file`` below a header: the file implements the spec."""

    name = "csv-links"

    def detect(self, root: str) -> float:
        return 0.6 if os.path.isfile(os.path.join(root, FILE)) else 0.0

    def analyze(self, spark: SparkSession, root: str) -> TraceGraph:
        rows = spark.read.schema("spec string, file string").csv(os.path.join(root, FILE), header=True).filter("spec is not null and file is not null")
        rows = rows.withColumn("ord", F.monotonically_increasing_id())
        node = lambda key, kind: rows.select(F.col(key).alias("id"), F.lit(kind).alias("type"), F.col(key).alias("title"), "file", F.lit(self.name).alias("framework_origin"), F.lit(0.9).alias("confidence"), "ord")
        why = F.array(F.struct(F.lit("csv").alias("kind"), F.col("spec").alias("value"), F.lit(FILE).alias("file"), F.lit(None).cast("int").alias("line")))
        edges = rows.select(F.col("file").alias("src_id"), F.col("spec").alias("dst_id"), F.lit(IMPLEMENTS).alias("relation"), F.lit(EXPLICIT).alias("strength"), why.alias("evidence"), "ord")
        return TraceGraph(last_wins(node("spec", SPEC).union(node("file", CODE))), first_edges(edges))
