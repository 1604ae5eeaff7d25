"""Intermediate tables, as in the rest of the library."""

from ..scratch import drop, shared_dir, store, temporary

__all__ = ["drop", "shared_dir", "store", "temporary"]
