"""Plugins to copy from."""
