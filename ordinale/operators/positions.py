"""Positions at scale: numbering rows and running sums without a window over all of them.

A window without partitions runs in one task. Where rows have integer positions, they are
cut into buckets of BUCKET positions; ranks or sums are taken within the buckets, and the
buckets' totals, one row each, are summed up and joined back. Small frames take the plain
window, which is faster for them. Running sums of a large frame whose partitions hold
ranges of positions, as scans of ranges and of files in order do, shuffle nothing: one job
sums the partitions, and each then adds up its own rows from the sum of those before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..kinds import wrap
from .values import POS, fresh

#: Positions in a bucket.
BUCKET = 1 << 20
#: Frames of up to this many rows take one window.
SMALL = 1 << 20


def _before():
    """The buckets before each; one row a bucket, so few that one task may hold them."""
    return Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def _bucket(bucket: int) -> Column:
    return F.floor(F.col(POS) / F.lit(bucket)).cast("bigint")


def renumbered(df: DataFrame, rows: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """`df` (whose ``pos`` is unique but has gaps) with ``pos`` as 0, 1, 2 and so on in the same order."""
    old = fresh("pos")
    others = [c for c in df.columns if c != POS]
    if rows is not None and rows <= SMALL:
        return df.withColumnRenamed(POS, old).select((F.row_number().over(Window.orderBy(old)) - 1).cast("bigint").alias(POS), *others)
    cut = df.withColumn("_b", _bucket(bucket))
    totals = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select(F.col("_b").alias("_ob"), F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_o"))
    ranked = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(POS)))
    return ranked.join(offsets, F.col("_b") == F.col("_ob")).select((F.col("_r") - 1 + F.col("_o")).cast("bigint").alias(POS), *others)


def numbered(df: DataFrame, order: list[Column], rows: int | None = None, split: Column | None = None) -> DataFrame:
    """`df` with ``pos`` by the given total order; where rows may be equal in it, in any order of theirs.

    With `split`, rows that are equal in the order are dealt to partitions by it, so that
    very many of them are no single task's.

    Large frames are range-partitioned and sorted; each partition's rows are counted and
    numbered from the sum of those before. Both uses must see the same partitions: they are
    written to the session's checkpoint folder, where a lost executor loses none of them,
    and only where none is set (as in local sessions) persisted.
    """
    others = [c for c in df.columns if c != POS]
    if rows is not None and rows <= SMALL:
        return df.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint").alias(POS), *others)
    ordered = df.repartitionByRange(*order, *([] if split is None else [split])).sortWithinPartitions(*order)
    held = ordered.select(*others, F.monotonically_increasing_id().alias("_i"))
    held = held.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else held.persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("_i", 33)
    totals = held.groupBy(part.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select("_b", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_o"))
    return held.withColumn("_b", part).join(F.broadcast(offsets), "_b").select((F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o")).cast("bigint").alias(POS), *others)


def running_sum(df: DataFrame, column: Column, integer: bool, name: str, rows: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(pos, name): the sum of all values up to each position. Null integers count as 0; sums wrap."""
    if integer:
        parts = dict(zip(("_h", "_l"), exact.halves(F.coalesce(column, F.lit(0).cast("bigint"))), strict=True))
    else:
        parts = {"_f": column}
    cut = df.select(POS, *(c.alias(n) for n, c in parts.items()))

    def finish(sums: list[Column]) -> Column:
        return exact.joined_halves(*sums) if integer else sums[0]

    if rows is not None and rows <= SMALL:
        upto = Window.orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
        summed = cut.select(POS, *(F.sum(n).over(upto).alias(n) for n in parts))
        return summed.select(POS, finish([F.col(n) for n in parts]).alias(name))
    if rows is not None and (starts := _partition_sums(cut, finish([F.sum(n) for n in parts]))) is not None:
        return _summed_in_place(df.select(POS, column.alias(name)), name, integer, starts, _from_range(_plan(df)))
    cut = cut.withColumn("_b", _bucket(bucket))
    totals = cut.groupBy("_b").agg(finish([F.sum(n) for n in parts]).alias("_t"))
    if integer:  # totals are wrapped already; limbs add up any number of them
        offset = exact.joined(*(F.sum(c).over(_before()) for c in exact.limbs(F.col("_t"))))
    else:
        offset = F.coalesce(F.sum("_t").over(_before()), F.lit(0.0))
    offsets = totals.select(F.col("_b").alias("_ob"), offset.alias("_o"))
    upto = Window.partitionBy("_b").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select(POS, "_b", *(F.sum(n).over(upto).alias(n) for n in parts))
    inner = finish([F.col(n) for n in parts])
    both = summed.join(offsets, F.col("_b") == F.col("_ob"))
    return both.select(POS, (exact.add_i64(inner, F.col("_o")) if integer else inner + F.col("_o")).alias(name))


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _from_range(plan: str) -> bool:
    """Whether a plan is a generated range with projections and filters only, whose rows come in order."""
    return all(re.match(r"[\s:+\-*()\d]*(Project|Filter|Range|ColumnarToRow|WholeStageCodegen)\b", line) for line in plan.splitlines() if line.strip())


def _partition_sums(cut: DataFrame, total: Column) -> dict[int, tuple[int, int, object]] | None:
    """By partition: its first position, its rows and the sum of all before it. None unless each partition holds a range of positions, and the same in every job."""
    plan = _plan(cut)
    if "Exchange" in plan or "Scan ExistingRDD" in plan:  # only scans of ranges and files deal rows out alike each time
        return None
    rows = cut.groupBy(F.spark_partition_id()).agg(F.min(POS).cast("bigint"), F.max(POS).cast("bigint"), F.count(F.lit(1)), total).collect()  # a row a partition
    rows.sort(key=lambda r: r[1])
    if any(last - first + 1 != n for _, first, last, n, _ in rows) or any(b[1] != a[2] + 1 for a, b in zip(rows, rows[1:], strict=False)) or rows and rows[0][1] != 0:
        return None
    out, before = {}, 0
    for part, first, _, n, own in rows:
        out[part] = first, n, before
        before = wrap(before + own) if isinstance(own, int) else before + own
    return out


def _summed_in_place(df: DataFrame, name: str, integer: bool, starts: dict[int, tuple[int, int, object]], in_order: bool) -> DataFrame:
    """Running sums of a frame whose partitions were summed, partition by partition; `in_order`: their rows are in the order of positions already."""
    kind = np.int64 if integer else np.float64
    shared = df.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, left, held = shared.value.get(part, (0, 0, 0))
        held = np.array([held], kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, values = batch.column(0).to_numpy(), batch.column(1)
            if pos[0] != at or pos[-1] != at + len(pos) - 1 or len(pos) > left:
                raise RuntimeError("the partitions are not those that were summed")
            values = (values.fill_null(0) if values.null_count else values).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                sums = np.cumsum(np.concatenate((held, values.astype(kind, copy=False))))[1:]
            held, at, left = sums[-1:], at + len(pos), left - len(pos)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums)], [POS, name])

    ordered = df.select(F.col(POS).cast("bigint").alias(POS), F.col(name).cast("bigint" if integer else "double").alias(name))
    return (ordered if in_order else ordered.sortWithinPartitions(POS)).mapInArrow(run, f"{POS} long, {name} {'long' if integer else 'double'}")


def previous(df: DataFrame, column: Column, name: str, before: str, rows: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(pos, name, before): each value and the one before it, null at the first position."""
    cut = df.select(POS, column.alias(name))
    if rows is not None and rows <= SMALL:
        return cut.select(POS, name, F.lag(name).over(Window.orderBy(POS)).alias(before))
    cut = cut.withColumn("_b", _bucket(bucket))
    last = cut.groupBy((F.col("_b") + 1).alias("_ob")).agg(F.max_by(name, POS).alias("_last"))
    own = cut.select(POS, name, "_b", F.lag(name).over(Window.partitionBy("_b").orderBy(POS)).alias("_own"))
    start = F.col(POS) == F.col("_b") * bucket
    return own.join(last, F.col("_b") == F.col("_ob"), "left").select(POS, name, F.when(start, F.col("_last")).otherwise(F.col("_own")).alias(before))
