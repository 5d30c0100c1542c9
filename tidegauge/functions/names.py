"""Key cleaning, one rule for both sides of every lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(name: Column) -> Column:
    """Series name as used in prompt keys: ``/`` to ``-``, ``**`` and ``%`` to ``_``."""
    return F.regexp_replace(F.replace(name, F.lit("/"), F.lit("-")), r"\*\*|%", "_")


def clean_path(path: Column) -> Column:
    """Folder name without the characters file systems refuse."""
    return F.regexp_replace(path, r'[<>:"\\|?* ]', "")


def file_stem(path: Column) -> Column:
    """Base name of a path up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)(\.[^/]*)?$", 1)


def file_label(path: Column) -> Column:
    """Parent folder and base name, for files picked by a pattern."""
    return F.regexp_extract(path, r"([^/]*/[^/.]*)(\.[^/]*)?$", 1)


def dataset_of(requested: list[str], path: Column) -> Column:
    """Dataset name of a file: its stem, or folder and stem where a pattern may meet equal stems."""
    pattern = any(c in p for p in requested for c in "*?[{")
    return file_label(path) if pattern else file_stem(path)
