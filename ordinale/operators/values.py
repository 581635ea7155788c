"""Values: atoms, vectors over positioned frames, dictionaries, tables, lists and lambdas.

A frame is a DataFrame with a unique, contiguous column ``pos`` from 0 on; a vector is a
typed column over a frame, so verbs on vectors of one frame are projections. An atom is
folded on the driver when its inputs are literals; an aggregate is a scalar subquery and
stays lazy until a concrete value is asked for.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ShapeError
from ..kinds import Kind, kind_of, spark_type

POS = "pos"
_names = itertools.count()


def fresh(prefix: str = "v") -> str:
    """A column name that no other frame has, so joined frames can't be confused."""
    return f"_{prefix}{next(_names)}"


class Frame:
    """Rows in order. `length` is their number if it is known without a job."""

    def __init__(self, df: DataFrame, length: int | None = None):
        self.df, self.length = df, length

    @cached_property
    def _counted(self) -> int:
        return self.df.count()

    def size(self) -> int:
        """The number of rows; counts them if it isn't known (a footer read for plain Parquet)."""
        if self.length is None:
            self.length = self._counted
        return self.length

    def vector(self, column: str | Column, kind: Kind | None = None) -> Vec:
        """A column of this frame; integers narrower than 64 bits are widened, so the verbs cover them."""
        c = F.col(column) if isinstance(column, str) else column
        data_type = self.df.select(c).schema[0].dataType
        found = kind or kind_of(data_type)
        if kind is None and found in (Kind.I16, Kind.I32):
            return Vec(Kind.I64, self, c.cast("bigint"))
        if kind is None and found is Kind.F32 or isinstance(data_type, T.DecimalType):
            return Vec(Kind.F64, self, c.cast("double"))
        return Vec(found, self, c)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession


@dataclass
class Atom:
    """A scalar: a Python value if folded, else a column without free names (a literal or scalar subquery)."""

    kind: Kind
    value: object = None
    lazy: Column | None = None

    @property
    def folded(self) -> bool:
        return self.lazy is None

    def column(self) -> Column:
        return literal(self.kind, self.value) if self.lazy is None else self.lazy

    def get(self, spark: SparkSession) -> object:
        """The concrete value; runs a job if it isn't folded."""
        if self.lazy is not None:
            self.value, self.lazy = spark.range(1).select(self.lazy).first()[0], None
            if self.kind is Kind.F64 and self.value is None:
                self.value = math.nan
        return self.value

    def to_df(self, spark: SparkSession, name: str = "val") -> DataFrame:
        return spark.range(1).select(self.column().alias(name))


@dataclass
class Vec:
    """`bound`: no value's magnitude is larger, where that is known without a job."""

    kind: Kind
    frame: Frame
    column: Column
    bound: int | None = None

    def size(self) -> int:
        return self.frame.size()

    def to_df(self, name: str = "val") -> DataFrame:
        return self.frame.df.select(F.col(POS).cast("bigint").alias(POS), self.column.alias(name))


@dataclass
class Dict:
    """Keys and values, both over one frame; keys may repeat."""

    keys: Vec
    values: Vec

    def to_df(self) -> DataFrame:
        return self.keys.frame.df.select(F.col(POS).cast("bigint").alias(POS), self.keys.column.alias("key"), self.values.column.alias("val"))


@dataclass
class Table:
    """A flipped dictionary. `columns` are named vectors over one frame if the keys are names of vectors."""

    source: Dict | None = None
    columns: dict[str, Vec] = field(default_factory=dict)

    def to_df(self) -> DataFrame:
        if self.source is not None:
            return self.source.to_df()
        frame = next(iter(self.columns.values())).frame
        return frame.df.select(F.col(POS).cast("bigint").alias(POS), *(v.column.alias(n) for n, v in self.columns.items()))


@dataclass
class List:
    items: tuple

    def __len__(self) -> int:
        return len(self.items)


@dataclass
class Lambda:
    params: tuple[str, ...]
    body: object


Value = Atom | Vec | Dict | Table | List | Lambda


def literal(kind: Kind, value: object) -> Column:
    if kind is Kind.F64:
        return F.lit(math.nan if value is None else float(value))
    return F.lit(value).cast(spark_type(kind))


def _sql(kind: Kind, value: object) -> str:
    if value is None:
        return f"CAST(NULL AS {spark_type(kind).simpleString()})"
    if kind is Kind.F64:
        return f"CAST('{value!r}' AS DOUBLE)"
    if kind in (Kind.CHAR, Kind.SYM):
        return "'" + "".join(f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in value) + "'"
    if kind is Kind.BOOL:
        return str(bool(value)).lower()
    return f"CAST('{value}' AS BIGINT)"


def vector(spark: SparkSession, kind: Kind, values: list) -> Vec:
    """A vector of literals: a local relation, which the optimizer can fold into what uses it."""
    name = fresh()
    if kind is Kind.F64:
        values = [math.nan if v is None else v for v in values]
    if not values:
        df = spark.range(0).select(F.col("id").alias(POS), F.lit(None).cast(spark_type(kind)).alias(name))
    else:
        rows = ",".join(f"({i}L,{_sql(kind, v)})" for i, v in enumerate(values))
        df = spark.sql(f"SELECT * FROM VALUES {rows} AS t({POS}, {name})")
    return Vec(kind, Frame(df, len(values)), F.col(name))


def gathered(vec: Vec) -> Vec:
    """The same vector over a frame of its own with one value column."""
    name = fresh()
    return Vec(vec.kind, Frame(vec.frame.df.select(POS, vec.column.alias(name)), vec.frame.length), F.col(name))


def check(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Rows for which `ok` holds; any other fails the query. A filter, so that column pruning can't lose it."""
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def aligned(x: Vec, y: Vec, one: bool = False) -> tuple[Frame, Column, Column]:
    """Both vectors over one frame. Lengths that are known must agree now; others fail the query that runs into it.

    With `one`, a vector that turns out to have a single element stands for as many as the other has.
    """
    if x.frame is y.frame:
        return x.frame, x.column, y.column
    a, b, left, right = fresh(), fresh(), fresh("l"), fresh("r")
    lengths = x.frame.length, y.frame.length
    if None not in lengths:
        if lengths[0] != lengths[1]:
            raise ShapeError(f"lengths {lengths[0]} and {lengths[1]}")
        df = x.frame.df.select(POS, x.column.alias(a)).join(y.frame.df.select(POS, y.column.alias(b)), POS)
        return Frame(df, lengths[0]), F.col(a), F.col(b)
    sides = []
    for vec, value, here, other in ((x, a, left, y), (y, b, right, x)):
        side = vec.frame.df.select(F.col(POS).cast("bigint").alias(POS), vec.column.alias(value), F.lit(True).alias(here))
        if one and vec.frame.length is None and other.frame.length != 1:
            side = _spread(side, vec, other)
        sides.append(side)
    both = check(sides[0].join(sides[1], POS, "full_outer"), F.col(left).isNotNull() & F.col(right).isNotNull(), "shape: vectors of different lengths")
    known = None if one else next((n for n in lengths if n is not None), None)
    return Frame(both.select(POS, a, b), known), F.col(a), F.col(b)


def _spread(side: DataFrame, vec: Vec, other: Vec) -> DataFrame:
    """`side`, its row copied to all positions of `other` if it is the only one.

    How many rows `vec` has is a scalar subquery over its first two rows, so a long vector
    is not counted.
    """
    few = vec.frame.df.limit(2).agg(F.count(F.lit(1))).scalar()
    value = side.limit(1).select(F.struct(*(F.col(c) for c in side.columns if c != POS))).scalar()
    copies = other.frame.df.where(few == 1).select(F.col(POS).cast("bigint").alias(POS), value.alias("_s")).select(POS, *(F.col(f"_s.{c}").alias(c) for c in side.columns if c != POS))
    return side.where(few != 1).union(copies)
