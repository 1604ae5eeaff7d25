"""What git says about a project's files."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


class GitError(RuntimeError):
    """git is missing, too slow, or refused."""


def _lines(root: str, *args: str) -> list[str]:
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise GitError(f"git {args[0]}: {e}") from e
    if run.returncode:
        raise GitError(f"git {args[0]}: {run.stderr.strip()}")
    return run.stdout.splitlines()


def changed_files(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    """(file) that differ from ``base``; a failure of git is a GitError, not an empty list."""
    return spark.createDataFrame([(f,) for f in _lines(root, "diff", "--name-only", base) if f], "file string")


def dirty_count(root: str) -> int:
    return len(_lines(root, "status", "--porcelain"))
