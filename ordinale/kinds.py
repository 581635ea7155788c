"""Scalar kinds: letters, Spark types, nulls and infinities."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

MAX_I64 = 2**63 - 1
MIN_I64 = -(2**63)


class Kind(Enum):
    """Kinds by name; see LETTERS for how the type verb shows them."""

    BOOL = "bool"
    U8 = "u8"
    I16 = "i16"
    I32 = "i32"
    I64 = "i64"
    F32 = "f32"
    F64 = "f64"
    CHAR = "char"
    SYM = "sym"
    DATE = "date"
    TIME_S = "time_s"
    TIME_MS = "time_ms"
    TIME_US = "time_us"
    TIME_NS = "time_ns"
    DT_S = "dt_s"
    DT_MS = "dt_ms"
    DT_US = "dt_us"
    DT_NS = "dt_ns"
    LAMBDA = "lambda"
    LIST = "list"
    TABLE = "table"
    DICT = "dict"


#: The letters of an atom and of a vector of each kind.
LETTERS = {
    Kind.BOOL: "bB", Kind.U8: "gG", Kind.I16: "hH", Kind.I32: "iI", Kind.I64: "jJ", Kind.F32: "eE", Kind.F64: "fF", Kind.CHAR: "cC", Kind.SYM: "nN",
    Kind.DATE: "dD", Kind.TIME_S: "ss", Kind.TIME_MS: "tt", Kind.TIME_US: "uu", Kind.TIME_NS: "vv", Kind.DT_S: "SS", Kind.DT_MS: "TT", Kind.DT_US: "UU", Kind.DT_NS: "VV",
    Kind.LAMBDA: "FF", Kind.LIST: "LL", Kind.TABLE: "++", Kind.DICT: "!!",
}

NUMERIC = (Kind.I64, Kind.F64)
#: Kinds that have a null, so that a position out of range has a value.
NULLABLE = (Kind.I64, Kind.F64, Kind.SYM)

_SPARK = {
    Kind.BOOL: T.BooleanType(), Kind.U8: T.ShortType(), Kind.I16: T.ShortType(), Kind.I32: T.IntegerType(), Kind.I64: T.LongType(), Kind.F32: T.FloatType(), Kind.F64: T.DoubleType(),
    Kind.CHAR: T.StringType(), Kind.SYM: T.StringType(), Kind.DATE: T.DateType(), Kind.TIME_S: T.IntegerType(), Kind.TIME_MS: T.IntegerType(), Kind.TIME_US: T.LongType(), Kind.TIME_NS: T.LongType(),
    Kind.DT_S: T.TimestampNTZType(), Kind.DT_MS: T.TimestampNTZType(), Kind.DT_US: T.TimestampNTZType(), Kind.DT_NS: T.LongType(),
}


def letter(kind: Kind, vector: bool) -> str:
    return LETTERS[kind][int(vector)]


def spark_type(kind: Kind) -> T.DataType:
    return _SPARK[kind]


def kind_of(data_type: T.DataType) -> Kind:
    """The kind that a column of a Spark type is read as."""
    for kinds, found in (
        ((T.BooleanType,), Kind.BOOL), ((T.ByteType, T.ShortType), Kind.I16), ((T.IntegerType,), Kind.I32), ((T.LongType,), Kind.I64), ((T.FloatType,), Kind.F32),
        ((T.DoubleType, T.DecimalType), Kind.F64), ((T.StringType,), Kind.SYM), ((T.DateType,), Kind.DATE), ((T.TimestampType, T.TimestampNTZType), Kind.DT_US),
    ):
        if isinstance(data_type, kinds):
            return found
    raise TypeError(f"no kind for {data_type.simpleString()}")


def symbol(text: str) -> str:
    """A valid symbol: ASCII, eight characters at most."""
    if not text.isascii():
        raise ValueError(f"symbol {text!r} is not ASCII")
    if len(text) > 8:
        raise ValueError(f"symbol {text!r} is longer than eight characters")
    return text


def wrap(n: int) -> int:
    """A Python integer as a 64-bit one."""
    return (n + 2**63) % 2**64 - 2**63
