"""Where the tool may write: its own directory of a project, nothing else."""

from __future__ import annotations

from pathlib import Path

OWN_DIR = ".linkweave"
PROTECTED = ("docs", "spec", "specs", "src", "lib", "app", "tests")


def allowed(target: str | Path, root: str | Path) -> Path:
    """The resolved path, if it lies in the project's own output directory; PermissionError else."""
    base, path = Path(root).resolve(), Path(target).resolve()
    if path.is_relative_to(base / OWN_DIR):
        return path
    if not path.is_relative_to(base):
        raise PermissionError(f"{path} lies outside the project {base}")
    for name in PROTECTED:
        if path.is_relative_to(base / name):
            raise PermissionError(f"{path} lies in {name}/, which holds specs or sources")
    raise PermissionError(f"{path} isn't in {base / OWN_DIR}")
