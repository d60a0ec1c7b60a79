"""Column names that an input does not use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with underscores put before it until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
