"""Fitting small models on the driver, from a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE_ROWS = 20_000


def held_out(key: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame, label: str, key: str = "doc_id", rows: int = SAMPLE_ROWS) -> dict:
    """Key and label of at most `rows` labelled rows, chosen by hash and none of them held out. Of a repeated key the largest label counts; nulls are left out."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
    picked = usable.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k", F.desc("y")).limit(rows).collect()
    out: dict = {}
    for k, y in picked:
        out[k] = max(y, out.get(k, 0))
    return out


def with_label(docs: DataFrame, sample: dict, key: str = "doc_id", name: str = "_label") -> DataFrame:
    """The sampled documents, with their labels; the sample is bounded, so it is broadcast."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(name, T.IntegerType())])
    rows: list | pa.Table = list(sample.items())
    if isinstance(kind, T.IntegralType) or kind == T.StringType():  # rows of a list would go through Python workers of their own kind, which stay
        rows = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((list(sample), list(sample.values())), to_arrow_schema(schema), strict=True)], [key, name])
    held = docs.sparkSession.createDataFrame(rows, schema)
    return docs.join(F.broadcast(held), key)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps; the last is the intercept, which the ridge leaves alone."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
