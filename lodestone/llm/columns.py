"""Plain column names, so that no operator's own names clash with those of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on: names with dots, blanks or an operator's prefix do no harm."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """The plain name of a column."""
    return f"c{df.columns.index(name)}"


def named(found: DataFrame, df: DataFrame) -> DataFrame:
    """The plain columns of ``found`` under their names in ``df``; other columns go."""
    return found.select(*(f"c{k}" for k in range(len(df.columns)))).toDF(*df.columns)
