"""Project settings: defaults, then ``[tool.linkweave]`` of pyproject.toml, then ``.linkweave.yaml``."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

import yaml

from .sources.projfiles import SKIPPED_DIRS, SOURCE_DIRS, SPEC_DIRS

FILE = ".linkweave.yaml"


def _names(of: Iterable[str] = ()) -> list[str]:
    return field(default_factory=lambda: sorted(of) if isinstance(of, frozenset) else [*of])


@dataclass(frozen=True)
class Config:
    min_coverage: float = 50.0
    min_confidence: float = 0.15
    max_output_nodes: int = 20
    source_dirs: list[str] = _names(SOURCE_DIRS)
    source_files: list[str] = _names()
    spec_dirs: list[str] = _names(SPEC_DIRS)
    spec_files: list[str] = _names()
    exclude_dirs: list[str] = _names(SKIPPED_DIRS)
    mapping_file: str = ".trace/mapping.yaml"
    graph_file: str = "ast-graph/graph.json"
    session_check: dict = field(default_factory=lambda: {"hooks": []})

    def updated(self, values: dict) -> Config:
        """With known keys replaced; a number that can't be read keeps its old value."""
        new = {}
        for f in fields(self):
            if f.name in values:
                old, value = getattr(self, f.name), values[f.name]
                if isinstance(old, (int, float)):
                    try:
                        value = type(old)(value)
                    except (TypeError, ValueError):
                        value = old
                new[f.name] = value
        return replace(self, **new)

    def problems(self, root: str) -> list[str]:
        """What is odd: missing directories and numbers out of range."""
        out = [f"no such directory: {d}" for d in [*self.spec_dirs, *self.source_dirs] if not (Path(root) / d).is_dir()]
        if not 0 <= self.min_confidence <= 1:
            out.append("min_confidence isn't between 0 and 1")
        if not 0 <= self.min_coverage <= 100:
            out.append("min_coverage isn't between 0 and 100")
        return out

    def dump(self) -> str:
        return yaml.safe_dump(asdict(self), sort_keys=False, allow_unicode=True)


def _pyproject(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text("utf-8")).get("tool", {}).get("linkweave", {})
    except (OSError, ValueError):
        return {}


def _yaml(path: Path) -> dict:
    try:
        data = yaml.safe_load(path.read_text("utf-8"))
    except (OSError, ValueError, yaml.YAMLError):
        return {}
    return data if isinstance(data, dict) else {}


def load(root: str, only: str | None = None) -> Config:
    """Settings of a project; with ``only``, defaults and that YAML file, which must be readable."""
    if only is not None:
        data = yaml.safe_load(Path(only).read_text("utf-8"))
        if not isinstance(data, dict):
            raise ValueError(f"{only} holds no settings")
        return Config().updated(data)
    return Config().updated(_pyproject(Path(root, "pyproject.toml"))).updated(_yaml(Path(root, FILE)))
