"""Who may see a chunk."""

from __future__ import annotations

from pyspark.sql import Column


def visible(level: Column, access_level: Column) -> Column:
    """Only restricted chunks are hidden, and only from callers who name another level than restricted."""
    return level.isNull() | (level == "") | (level == "restricted") | (access_level != "restricted")


def in_department(wanted: Column, department: Column) -> Column:
    return wanted.isNull() | (wanted == "") | (wanted == department)
