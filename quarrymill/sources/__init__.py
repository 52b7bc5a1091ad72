"""Readers and writers. Every reader takes a schema or reads one from Parquet; nothing is inferred from JSON."""

from quarrymill.sources.tables import importable, read_table

__all__ = ["importable", "read_table"]
