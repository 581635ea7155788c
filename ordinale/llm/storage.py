"""Cutting lineage through the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_places: dict[int, tuple[DataFrame, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where none is named (local tests) one is made here."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{context.getCheckpointDir()}/tables"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` computed once, written as Parquet to the shared folder and read from there.

    A lost executor loses none of the files, and readers take only the columns they need.
    The files stay until discard() or clear().
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[id(out)] = out, path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of tables that cut() made and nothing reads any more."""
    for df in frames:
        held = _places.pop(id(df), None)
        if held is not None:
            _delete(df.sparkSession, held[1])


def clear(spark: SparkSession) -> None:
    """Remove all that this application has cut; results that were not written or collected yet are lost."""
    _places.clear()
    _delete(spark, shared_folder(spark))


written = cut
