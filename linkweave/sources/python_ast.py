"""Function and class blocks of Python sources from the syntax tree; other languages fall back to lines.

A decorated definition counts twice, with and without its decorators, as the wrapper
and the definition inside are nodes of their own.  Without a parser for a language
here, its blocks come from ``operators.parse.function_blocks``.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.parse import function_blocks

SCHEMA = "path string, name string, kind string, line int, body_hash string, body_lines int, body_preview string"


def blocks(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = text.split("\n"), []

    def add(node, first: int, kind: str) -> None:
        body = "\n".join(lines[first - 1 : node.end_lineno])
        body = body[(node.col_offset if first == node.lineno else len(lines[first - 1]) - len(lines[first - 1].lstrip())) :]
        out.append((node.name, kind, first, hashlib.sha256(body.encode()).hexdigest()[:16], body.count("\n") + 1, body.strip()[:80].replace("\n", " ")))

    def visit(node, depth: int) -> None:
        if depth > 200:
            return
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                if child.decorator_list:
                    add(child, child.decorator_list[0].lineno, "function")
                add(child, child.lineno, "class" if isinstance(child, ast.ClassDef) else "function")
            visit(child, depth + 1)

    visit(tree, 0)
    return out


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(p, *b) for p, t in zip(batch["path"], batch["text"]) for b in blocks(t)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def ast_blocks(files: DataFrame) -> DataFrame:
    """Blocks of files (path, text)."""
    python = F.endswith("path", F.lit(".py"))
    own = files.filter(python).select("path", "text").mapInPandas(_run, SCHEMA)
    rest = function_blocks(files.filter(~python))
    return own.unionByName(rest.select("path", "name", "kind", "line", X.hash16(F.col("body")).alias("body_hash"), (X.line_breaks(F.col("body")) + 1).cast("int").alias("body_lines"), X.preview(F.col("body")).alias("body_preview")))
