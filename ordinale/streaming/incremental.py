"""Running aggregates over streams: an extension, not part of the language.

A stream has no positions to the end of which one could scan; what carries over are the
aggregate (sum so far, exact and wrapping as for batches) and event-time windows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import exact


def read(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files: int | None = None) -> DataFrame:
    """A folder whose new files are the stream; at most `files` of them a batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).format(format).load(path)


def _total(df: DataFrame, column: str) -> Column:
    integer = isinstance(df.schema[column].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    return exact.sum_i64(F.col(column).cast("bigint")) if integer else exact.sum_f64(exact.to_f64(F.col(column)))


def running_total(df: DataFrame, column: str) -> DataFrame:
    """(n, total) of all rows so far; write it in complete or update mode."""
    return df.agg(F.count(F.lit(1)).alias("n"), _total(df, column).alias("total"))


def windowed_total(df: DataFrame, time: str, column: str, window: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, end, n, total) by event-time window; rows later than `late` behind the newest are left out."""
    grouped = df.withWatermark(time, late).groupBy(F.window(time, window, slide) if slide else F.window(time, window))
    return grouped.agg(F.count(F.lit(1)).alias("n"), _total(df, column).alias("total")).select("window.start", "window.end", "n", "total")


def write(df: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Append a stream to files, each batch exactly once; stops when the source is used up."""
    return df.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
