"""Readers and writers."""

from taxoflow.sources.tables import table

__all__ = ["table"]
