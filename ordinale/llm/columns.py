"""Carrying a table's own columns past an operator's working columns, whatever they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The named columns as c0, c1 and so on, and what each is called there."""
    inner = {n: f"c{i}" for i, n in enumerate(names)}
    return df.select(*(F.col(f"`{n}`").alias(c) for n, c in inner.items())), inner


def unmasked(df: DataFrame, inner: dict[str, str], *more: str) -> DataFrame:
    """The named columns under their own names, and then those in `more`."""
    return df.select(*(F.col(c).alias(n) for n, c in inner.items()), *more)
