"""Tables from files as positioned frames, and sinks for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import numbered
from ..operators.values import POS, Frame, Value, Vec

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, format: str | None = None, **options: str) -> DataFrame:
    """A table; the format is that of the path's suffix unless it is named."""
    kind = format or path.rstrip("/").rpartition(".")[2]
    if kind not in FORMATS:
        raise ValueError(f"{path}: name one of {', '.join(FORMATS)} as its format")
    if kind == "csv":
        options = {"header": "true"} | options
    return spark.read.format(kind).options(**options).load(path)


def frame(df: DataFrame, pos: str | None = None, order: list[str | Column] | None = None) -> Frame:
    """A frame over a table.

    `pos` names a column that is unique and runs from 0 without gaps: nothing is computed.
    Otherwise rows are numbered by `order`, which must be a total order; they are counted
    first, as small tables are numbered in another way than large ones.
    """
    if pos is not None:
        return Frame(df.withColumn(POS, F.col(pos).cast("bigint")))
    if not order:
        raise ValueError("name a position column or a total order")
    rows = df.count()
    return Frame(numbered(df, [F.col(c) if isinstance(c, str) else c for c in order], rows), rows)


def write(value: Value, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Write a vector, dictionary or table; rows carry their positions."""
    if not hasattr(value, "to_df") or not isinstance(value, Vec) and not hasattr(value, "source") and not hasattr(value, "keys"):
        raise TypeError("only vectors, dictionaries and tables are written")
    value.to_df().write.format(format).mode(mode).save(path)
