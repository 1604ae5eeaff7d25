"""Project trees as a Spark data source, ``projfiles``.

Spark's own file sources hide names that begin with ``_`` or ``.`` and drop empty
files, which a project has many of.  Here the driver lists the tree, batches of files
become partitions, and executors read and decode them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import LANGUAGES

SKIPPED_DIRS = frozenset(
    "__pycache__ node_modules site-packages build dist coverage htmlcov env venv .venv .tox .git .egg-info .mypy_cache .ruff_cache .pytest_cache .trace .linkweave".split()
)
SPEC_DIRS, SOURCE_DIRS = ("docs", "spec", "specs"), ("src", "lib", "app")
NOT_SPECS = frozenset(f"{n}.md" for n in ("_navbar", "_sidebar", "index", "CHANGELOG", "CONTRIBUTING", "LICENSE", "README"))
SCHEMA = "path string, ext string, text string, mtime long, hash string, ord long"
BATCH_BYTES = 16 << 20


def walk(root: str, endings: tuple[str, ...] = (), skipped: frozenset[str] = SKIPPED_DIRS, hidden_files: bool = False) -> Iterator[str]:
    """Files below ``root`` in order: those of a directory by name, then its directories by name.

    Directories that begin with a dot or are ``skipped``, links to directories, and
    what can't be read are left out; endings are compared with case.
    """
    stack = [root]
    while stack:
        at = stack.pop()
        try:
            with os.scandir(at) as entries:
                found = sorted(entries, key=lambda e: e.name)
        except OSError:
            continue
        dirs = []
        for e in found:
            try:
                if e.is_dir(follow_symlinks=False):
                    if not e.name.startswith(".") and e.name not in skipped:
                        dirs.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    if (hidden_files or not e.name.startswith(".")) and (not endings or os.path.splitext(e.name)[1] in endings):
                        yield e.path
            except OSError:
                continue
        stack += reversed(dirs)


class _Batch(InputPartition):
    def __init__(self, files: list[tuple[int, str, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["path"])
        self.dirs = [d for d in options.get("dirs", "").split(",") if d]
        self.endings = tuple(e for e in options.get("endings", "").split(",") if e)
        self.skipped = frozenset(x for x in options["skipped"].split(",") if x) if "skipped" in options else SKIPPED_DIRS

    def partitions(self) -> list[InputPartition]:
        out, batch, held, n = [], [], 0, 0
        for d in self.dirs or ["."]:
            for path in walk(os.path.normpath(os.path.join(self.root, d)), self.endings, self.skipped):
                batch.append((n, os.path.relpath(path, self.root).replace(os.sep, "/"), path))
                n += 1
                try:
                    held += os.path.getsize(path)
                except OSError:
                    pass
                if held > BATCH_BYTES:
                    out.append(_Batch(batch))
                    batch, held = [], 0
        return out + [_Batch(batch)]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        import hashlib

        for n, rel, path in partition.files:
            try:
                with open(path, "rb") as f:
                    raw = f.read()
                mtime = int(os.stat(path).st_mtime)
                text = raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
            except (OSError, UnicodeDecodeError):
                continue
            yield (rel, os.path.splitext(rel)[1], text, mtime, hashlib.sha256(raw).hexdigest(), n)


class ProjectFiles(DataSource):
    """Options: path (the root), dirs and endings (comma-separated), skipped (directory names)."""

    @classmethod
    def name(cls) -> str:
        return "projfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def project_files(spark: SparkSession, root: str, dirs: tuple[str, ...] | list[str], endings: tuple[str, ...], skipped=None) -> DataFrame:
    """(path, ext, text, mtime, hash, ord) of a project's files below ``dirs``; undecodable files are left out."""
    spark.dataSource.register(ProjectFiles)
    reader = spark.read.format("projfiles").option("path", root).option("dirs", ",".join(dirs)).option("endings", ",".join(endings))
    if skipped is not None:
        reader = reader.option("skipped", ",".join(sorted(skipped)))
    return reader.load()


def source_endings() -> tuple[str, ...]:
    return tuple(sorted(LANGUAGES))
