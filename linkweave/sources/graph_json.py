"""Graphs from an AST tool's JSON: {nodes: [...], links: [...]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEPENDS, EXPLICIT, IMPLEMENTS, INFERRED, REFERENCES

SCHEMA = (
    "nodes array<struct<id:string,label:string,type:string,source_file:string,source_location:string>>,"
    " links array<struct<source:string,target:string,relation:string,confidence:string>>"
)
RELATIONS = {"implements": IMPLEMENTS, "imports": DEPENDS, "imports_from": DEPENDS}


def edge_rows(links: DataFrame) -> DataFrame:
    """Edges of links (source, target, relation, confidence); links without an end are dropped."""
    table = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    rows = links.filter("source <> '' and target <> ''")
    return rows.select(
        F.col("source").alias("src_id"), F.col("target").alias("dst_id"), F.coalesce(table[F.col("relation")], F.lit(REFERENCES)).alias("relation"),
        F.when(F.col("confidence") == "EXTRACTED", EXPLICIT).otherwise(INFERRED).alias("strength"),
    )


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nodes but packages; an id, or file and label where there is none."""
    rows = nodes.filter(F.coalesce("type", F.lit("")) != "package")
    key = F.when(F.coalesce("id", F.lit("")) != "", F.col("id")).otherwise(F.concat(F.coalesce("source_file", F.lit("")), F.lit("::"), F.coalesce("label", F.lit(""))))
    line = F.nullif(F.regexp_extract("source_location", r"(\d+)", 1), F.lit("")).cast("int")
    return rows.select(key.alias("id"), F.lit("code").alias("type"), F.coalesce("label", key).alias("title"), F.col("source_file").alias("file"), line.alias("line"), F.lit("ast").alias("framework_origin"), F.lit(0.9).alias("confidence"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file; edges to unknown nodes are dropped."""
    doc = spark.read.schema(SCHEMA).json(path, multiLine=True)
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("n.*", F.col("ord").cast("long").alias("ord"))
    rows = node_rows(nodes.drop("ord")).withColumn("ord", F.monotonically_increasing_id())
    edges = edge_rows(doc.select(F.explode("links").alias("l")).select("l.*")).withColumn("ord", F.monotonically_increasing_id())
    known = rows.select("id").distinct()
    return rows, edges.join(known.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(known.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")


def communities(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, community) of an analysis file {communities: {name: [ids]}}."""
    doc = spark.read.schema("communities map<string,array<string>>").json(path, multiLine=True)
    return doc.select(F.explode("communities").alias("community", "ids")).select(F.explode("ids").alias("node_id"), "community")
