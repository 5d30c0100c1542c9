"""Names of columns that an operator adds beside those of its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores behind it as keep it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``own`` under names that no operator uses, and the columns that bring their names back."""
    names = {c: c if c in own else f"column {k}" for k, c in enumerate(docs.columns)}
    return (docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]),
            [F.col(f"`{n}`").alias(c) for c, n in names.items()])
