"""Spec and code candidates of a project: scan, then parse."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import parse
from ..schema import SPECS
from .projfiles import NOT_SPECS, SOURCE_DIRS, SPEC_DIRS, project_files, source_endings

_ITEMS = "path string, ford long, idx int, id string, title string, description string, parent string, tags string, tag_list string"


def _yaml_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of ``specs:`` lists; a file that isn't such YAML has none, nor an entry without an id."""
    import yaml

    for batch in batches:
        rows = []
        for path, text, ford in zip(batch["path"], batch["text"], batch["ord"]):
            try:
                data = yaml.safe_load(text)
            except yaml.YAMLError:
                continue
            entries = data.get("specs") if isinstance(data, dict) else None
            for i, e in enumerate(entries if isinstance(entries, list) else []):
                if not isinstance(e, dict) or e.get("id") in (None, ""):
                    continue
                key, tags = str(e["id"]), e.get("tags") or []
                said = "" if e.get("description") is None else str(e["description"])
                joined = ", ".join(map(str, tags)) if isinstance(tags, list) else str(tags)
                rows.append((path, ford, i, key, str(e.get("title", key)), said, e["parent"] if isinstance(e.get("parent"), str) else "", joined, str(tags) if tags else ""))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ITEMS.split(", ")])


def yaml_specs(files: DataFrame) -> DataFrame:
    """Spec candidates of YAML files (path, text, ord)."""
    items = files.select("path", "text", "ord").mapInPandas(_yaml_items, _ITEMS)
    one = items.groupBy("path", "id").agg(F.max_by("title", "idx").alias("title"), F.max_by("parent", "idx").alias("parent"))
    tree = parse.hierarchy(one.withColumnRenamed("path", "file")).select(F.col("file").alias("path"), "id", "depth", "parent_chain")
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    body = F.concat_ws("\n", part("Description: ", "description"), part("Tags: ", "tags"), part("Parent: ", "parent"))
    content = F.concat_ws("\n", F.concat(F.lit("id: "), "id"), F.concat(F.lit("title: "), "title"), part("description: ", "description"), part("parent: ", "parent"), part("tags: ", "tag_list"))
    rows = items.join(tree, ["path", "id"]).withColumns({"body": body, "content": content})
    return rows.select(
        (F.col("ford") * F.lit(1 << 24) + F.col("idx")).alias("ord"), F.col("path").alias("file"), F.col("depth").alias("heading_depth"), F.col("title").alias("heading_text"),
        F.concat(parse.id_prefix(F.col("path")), "id").alias("auto_id"), "title", (F.col("idx") + 2).cast("int").alias("line"), "parent_chain", F.col("body").alias("body_text"),
        X.hash16(F.col("body")).alias("body_hash"), X.hash16(F.col("content")).alias("body_hash_content"),
        F.when(F.col("body") == "", 0).otherwise(X.line_breaks(F.col("body")) + 1).cast("int").alias("body_line_count"),
        F.substring(F.when(F.col("description") != "", F.col("description")).otherwise(F.col("title")), 1, 80).alias("body_preview"),
    )


def _named(spark: SparkSession, root: str, names: list[str], after: int) -> DataFrame:
    """Files given by name, in that order; missing ones are left out with a warning."""
    import warnings

    there = []
    for n in names:
        if os.path.isfile(os.path.join(root, n)):
            there.append(n)
        else:
            warnings.warn(f"no such file: {n}", stacklevel=3)
    frame = None
    for i, n in enumerate(there):
        folder, base = os.path.split(n)
        one = project_files(spark, root, [folder or "."], (os.path.splitext(base)[1],), skipped=frozenset()).filter(F.col("path") == n).withColumn("ord", F.lit(after + i).cast("long"))
        frame = one if frame is None else frame.unionByName(one)
    return frame if frame is not None else spark.createDataFrame([], "path string, ext string, text string, mtime long, hash string, ord long")


def spec_candidates(spark: SparkSession, root: str, spec_dirs=SPEC_DIRS, spec_files=(), skipped=None) -> DataFrame:
    """Specs of Markdown and YAML files below ``spec_dirs``, and of ``spec_files`` not seen there."""
    files = project_files(spark, root, spec_dirs, (".md", ".yaml", ".yml"), skipped).filter(~X.name(F.col("path")).isin(*NOT_SPECS))
    if spec_files:
        files = files.unionByName(_named(spark, root, list(spec_files), 1 << 30).join(files.select("path"), "path", "left_anti"))
    columns = [c.split()[0] for c in SPECS.split(", ")]
    md = parse.spec_rows(files.filter("ext = '.md'")).select(*columns)
    return md.unionByName(yaml_specs(files.filter("ext in ('.yaml', '.yml')")).select(*columns))


def code_candidates(spark: SparkSession, root: str, source_dirs=SOURCE_DIRS, source_files=(), skipped=None) -> DataFrame:
    """Sources below ``source_dirs``, and ``source_files`` with a known ending, even if seen."""
    return parse.code_rows(source_texts(spark, root, source_dirs, source_files, skipped))


def source_texts(spark: SparkSession, root: str, source_dirs=SOURCE_DIRS, source_files=(), skipped=None) -> DataFrame:
    files = project_files(spark, root, source_dirs, source_endings(), skipped)
    if source_files:
        known = [f for f in source_files if os.path.splitext(f)[1] in source_endings()]
        files = files.unionByName(_named(spark, root, known, 1 << 30))
    return files
