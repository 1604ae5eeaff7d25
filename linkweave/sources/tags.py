"""Trace tags in comments and documents, and the graph they make.

Python sources are read with ``tokenize``, so a tag inside a string is none; other
sources and Markdown by patterns over the whole text.  These need Python's own
tokenizer and its notion of white space, so they run in ``mapInPandas`` batches.
"""

from __future__ import annotations

import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.graph import TraceGraph, first_edges, last_wins
from ..schema import CODE, DESIGN, EXPLICIT, IMPLEMENTS, SATISFIES, SPEC, TAGS, TEST, VERIFIES
from .projfiles import project_files, source_endings

_ID = r"[-/.0-9A-Z_a-z]+"
_MANY, _ONE = rf"{_ID}(?:\s*,\s*{_ID})*", r"[-/.,0-9A-Z_a-z]+"
SOURCE_TAGS = [(kind, re.compile(rf"(?://|#)\s*@{kind}\s+({value})")) for kind, value in (("impl", _MANY), ("module", _ONE), ("feature", _ONE), ("verifies", _MANY))]
DOC_TAGS = [(kind, re.compile(rf"<!--\s*@{kind}\s+(.+?)\s*-->")) for kind in ("spec", "design", "satisfies")]
DOC_TAGS.append(("boundary", re.compile(r"^_(?:Boundary):_\s+(.*\S.*)$", re.M)))
DOC_ENDINGS = (".md", ".mdx", ".rst")
DATA_ENDINGS = (".yaml", ".yml", ".toml")


def python_tags(text: str) -> list[tuple[str, str, int]]:
    """At most one tag of each comment; after a syntax error what was read stays."""
    out = []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.COMMENT:
                for kind, pattern in SOURCE_TAGS:
                    if m := pattern.search(token.line):
                        out.append((kind, m[1].strip(), token.start[0]))
                        break
    except (tokenize.TokenError, SyntaxError):
        pass
    return out


def pattern_tags(text: str, patterns: list) -> list[tuple[str, str, int]]:
    """All matches, kind by kind."""
    return [(kind, m[1].strip(), text.count("\n", 0, m.start()) + 1) for kind, pattern in patterns for m in pattern.finditer(text)]


def tags_of(ext: str, text: str) -> list[tuple[str, str, int]]:
    if ext in DOC_ENDINGS:
        return pattern_tags(text, DOC_TAGS)
    if ext == ".py":
        return python_tags(text)
    return pattern_tags(text, SOURCE_TAGS) if ext in source_endings() or ext in DATA_ENDINGS else []


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(path, *t, i) for path, ext, text in zip(batch["path"], batch["ext"], batch["text"]) for i, t in enumerate(tags_of(ext, text))]
        yield pd.DataFrame(rows, columns=["file", "kind", "value", "line", "ord"])


def extract_tags(files: DataFrame) -> DataFrame:
    """(file, kind, value, line, ord) of files (path, ext, text)."""
    return files.select("path", "ext", "text").mapInPandas(_extract, TAGS)


def tagged_files(spark: SparkSession, root: str) -> DataFrame:
    """Files whose tags count: any below the root but in hidden, ``__`` or build directories, or so named."""
    ends = tuple(sorted({*source_endings(), *DATA_ENDINGS, *DOC_ENDINGS}))
    files = project_files(spark, root, ["."], ends, skipped=frozenset("build dist node_modules __pycache__".split()))
    return files.filter(~F.exists(F.split("path", "/"), lambda p: F.startswith(p, F.lit("__"))))


def tag_graph(tags: DataFrame, scope: str = "last") -> tuple[TraceGraph, DataFrame]:
    """The graph of tags, and its boundaries (spec_id, path, file, line).

    impl and verifies tags give code and test nodes with edges to bare ids, satisfies
    tags design nodes with edges to ``spec::`` ids, spec tags spec nodes.  A repeated
    tag keeps its node's last line and its edge's first.
    """
    from ..operators.boundary import attach

    place = F.struct("file", "ord")
    of = lambda kind, wide=False: tags.filter(F.col("kind") == kind).select("*", F.posexplode(X.split_values(F.col("value"), wide)).alias("part", "one"))
    node = lambda rows, key, kind, title, sure: rows.select(key.alias("id"), F.lit(kind).alias("type"), title.alias("title"), "file", "line", F.lit("tags").alias("framework_origin"), F.lit(sure).alias("confidence"), place.alias("at"))
    edge = lambda rows, src, dst, relation, kind: rows.select(src.alias("src_id"), dst.alias("dst_id"), F.lit(relation).alias("relation"), F.lit(EXPLICIT).alias("strength"), F.array(F.struct(F.lit(kind).alias("kind"), F.col("one").alias("value"), F.col("file").alias("file"), F.col("line").alias("line"))).alias("evidence"), place.alias("at"))
    impl, tests, sat, specs = of("impl", True), of("verifies"), of("satisfies"), tags.filter("kind = 'spec'")
    file, one, value = F.col("file"), F.col("one"), F.col("value")
    at = F.lit("::")
    iid, tid, did = F.concat(one, at, file), F.concat(F.lit("test-"), one, at, file), F.concat(F.lit("design::"), value, at, file)
    nodes = node(impl, iid, CODE, file, 0.9).union(node(tests, tid, TEST, file, 0.85)).union(node(sat, did, DESIGN, F.concat(F.lit("Design @"), value), 0.8))
    nodes = nodes.union(node(specs, F.concat(F.lit("spec::"), value), SPEC, F.concat(F.lit("Spec "), value), 0.95))
    edges = edge(impl, iid, one, IMPLEMENTS, "tag:impl").union(edge(tests, tid, one, VERIFIES, "tag:verifies")).union(edge(sat, did, F.concat(F.lit("spec::"), one), SATISFIES, "tag:satisfies"))
    ordered = lambda df: df.withColumn("ord", F.col("at")).drop("at")
    flat = F.xxhash64("ord.file").bitwiseAND(F.lit((1 << 40) - 1)) * F.lit(1 << 20) + F.col("ord.ord")
    g = TraceGraph(last_wins(ordered(nodes)).withColumn("ord", flat), first_edges(ordered(edges)).withColumn("ord", flat))
    return g, attach(tags, scope)


def resolve_bare(graph: TraceGraph) -> TraceGraph:
    """Edges to bare ids that only exist with ``spec::`` in front point there."""
    named = graph.nodes.select(F.col("id").alias("known"))
    full = F.concat(F.lit("spec::"), "dst_id")
    rows = graph.edges.join(named, F.col("dst_id") == F.col("known"), "left").withColumnRenamed("known", "own").withColumn("full", full)
    rows = rows.join(named, F.col("full") == F.col("known"), "left").withColumn("dst_id", F.when(F.col("own").isNull() & F.col("known").isNotNull(), F.col("full")).otherwise(F.col("dst_id")))
    return TraceGraph(graph.nodes, rows.select(*graph.edges.columns))
