"""Verbs that change length or order, count, look up or convert; new frames are numbered from 0 again."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import KindError, ShapeError
from ..kinds import NULLABLE, NUMERIC, Kind, letter
from .positions import numbered, renumbered
from .values import POS, Atom, Dict, Frame, Lambda, List, Table, Value, Vec, aligned, fresh, gathered, vector

COMPOSITE = (List, Dict, Table, Lambda)


def til(spark: SparkSession, n: Value) -> Vec:
    """0 to n - 1; nothing is materialised."""
    if not isinstance(n, Atom) or n.kind is not Kind.I64:
        raise KindError("! needs an integer atom or a dictionary")
    count = n.get(spark)
    if count is None or count < 0:
        raise ShapeError("! needs a length of 0 or more")
    return Vec(Kind.I64, Frame(spark.range(count).withColumnRenamed("id", POS), count), F.col(POS), bound=count)


def as_vector(spark: SparkSession, x: Value) -> Vec:
    """A vector as it is; an atom as a vector of one element."""
    if isinstance(x, Vec):
        return x
    if isinstance(x, Atom):
        if x.folded:
            return vector(spark, x.kind, [x.value])
        name = fresh()
        return Vec(x.kind, Frame(spark.range(1).select(F.col("id").alias(POS), x.column().alias(name)), 1), F.col(name))
    raise KindError("a composite is no vector")


def _plain(x: Value, verb: str) -> None:
    if isinstance(x, COMPOSITE):
        raise KindError(f"{verb} has no form for a composite")


def concat(spark: SparkSession, x: Value, y: Value) -> Vec:
    """All of x, then all of y; both of one kind."""
    if isinstance(x, COMPOSITE) or isinstance(y, COMPOSITE) or x.kind is not y.kind:
        raise KindError(", needs vectors or atoms of one kind")
    a, b = as_vector(spark, x), as_vector(spark, y)
    name, left = fresh(), a.size()
    one = a.frame.df.select(F.col(POS).cast("bigint").alias(POS), a.column.alias(name))
    two = b.frame.df.select((F.col(POS) + left).cast("bigint").alias(POS), b.column.alias(name))
    right = b.frame.length
    return Vec(a.kind, Frame(one.union(two), None if right is None else left + right), F.col(name))


def _length(spark: SparkSession, n: Value, verb: str) -> int:
    if not isinstance(n, Atom) or n.kind is not Kind.I64:
        raise KindError(f"{verb} needs an integer atom on its left")
    value = n.get(spark)
    if value is None:
        raise ShapeError(f"{verb} needs a length")
    return value


def take(spark: SparkSession, n: Value, y: Value) -> Vec:
    """The first n elements, beginning anew as often as needed."""
    count = _length(spark, n, "#")
    if count < 0:
        raise KindError("# needs a length of 0 or more")
    _plain(y, "#")
    v = gathered(as_vector(spark, y))
    if not count:
        return Vec(v.kind, Frame(v.frame.df.filter(F.lit(False)), 0), v.column)
    size = v.size()
    if not size:
        raise ShapeError("# of nothing")
    if count <= size:
        return Vec(v.kind, Frame(v.frame.df.filter(F.col(POS) < count), count), v.column)
    at, name = fresh("at"), fresh()
    places = spark.range(count).select(F.col("id").alias(POS), (F.col("id") % size).alias(at))
    source = v.frame.df.select(F.col(POS).alias(at), v.column.alias(name))
    return Vec(v.kind, Frame(places.join(source, at).select(POS, name), count), F.col(name))


def drop(spark: SparkSession, n: Value, y: Value) -> Vec:
    """Without the first n elements, or without the last -n."""
    count = _length(spark, n, "_")
    _plain(y, "_")
    v = gathered(as_vector(spark, y))
    known = v.frame.length
    if count >= 0:
        df = v.frame.df.filter(F.col(POS) >= count).withColumn(POS, F.col(POS) - count)
    else:
        known = v.size()
        df = v.frame.df.filter(F.col(POS) < known + count)
    return Vec(v.kind, Frame(df, None if known is None else max(0, known - abs(count))), v.column)


def index(spark: SparkSession, x: Vec, i: Value) -> Atom:
    """The element at a position; out of range, the kind's null if it has one."""
    if not isinstance(i, Atom) or i.kind is not Kind.I64:
        raise KindError("@ needs an integer atom")
    at = i.column()
    if x.kind not in NULLABLE:
        place = i.get(spark)
        if place is None or not 0 <= place < x.size():
            raise ShapeError(f"position {place} is out of range")
    found = x.frame.df.filter(F.col(POS) == at).select(x.column).scalar()
    if x.kind is Kind.F64:
        found = F.coalesce(found, F.lit(math.nan))
    if x.kind is Kind.SYM:
        found = F.coalesce(found, F.lit(""))
    return Atom(x.kind, lazy=found)


def enlist(spark: SparkSession, x: Value) -> Value:
    """An atom as a vector of one, anything else as a list of one."""
    if isinstance(x, Lambda):
        raise KindError(", has no form for a lambda")
    return as_vector(spark, x) if isinstance(x, Atom) else List((x,))


def type_of(x: Value) -> Atom:
    if isinstance(x, Atom | Vec):
        return Atom(Kind.SYM, letter(x.kind, isinstance(x, Vec)))
    return Atom(Kind.SYM, letter({List: Kind.LIST, Dict: Kind.DICT, Table: Kind.TABLE, Lambda: Kind.LAMBDA}[type(x)], False))


def count(x: Value) -> Atom:
    """Elements of a vector, entries of a dictionary, rows of a table, items of a list; 1 for an atom."""
    if isinstance(x, List):
        return Atom(Kind.I64, len(x))
    if isinstance(x, Dict):
        return count(x.keys)
    if isinstance(x, Table):
        return count(x.source) if x.source is not None else count(next(iter(x.columns.values())))
    if isinstance(x, Vec):
        if x.frame.length is not None:
            return Atom(Kind.I64, x.frame.length)
        return Atom(Kind.I64, lazy=x.frame.df.agg(F.count(F.lit(1))).scalar())
    return Atom(Kind.I64, 1)


def text(value: object, kind: Kind) -> str:
    """An atom as text, by the string verb's rules."""
    if kind is Kind.BOOL:
        return f"{int(value)}b"
    if kind is Kind.I64:
        return "0N" if value is None else str(value)
    if kind is Kind.F64:
        if math.isnan(value):
            return "0n"
        if math.isinf(value):
            return "0w" if value > 0 else "-0w"
        short = format(value, ".0f") if value == int(value) else repr(value)
        if "e" in short:
            from decimal import Decimal

            short = format(Decimal(short), "f")
        return "-0" if value == 0 and math.copysign(1, value) < 0 else short
    return value


def string(spark: SparkSession, x: Value) -> Vec:
    """An atom as a vector of characters."""
    if not isinstance(x, Atom) or x.kind not in (Kind.BOOL, Kind.I64, Kind.F64, Kind.SYM, Kind.CHAR):
        raise KindError("$ needs an atom")
    return vector(spark, Kind.CHAR, list(text(x.get(spark), x.kind)))


def _numeric(x: Value, verb: str) -> None:
    if not isinstance(x, Atom | Vec) or x.kind not in NUMERIC:
        raise KindError(f"{verb} needs numbers")


def sort(x: Value) -> Value:
    """Ascending: null integers first, NaN last, -0.0 before 0.0. A value that very many elements have is dealt to several tasks."""
    _numeric(x, "^")
    if isinstance(x, Atom):
        return x
    v = gathered(x)
    order = [F.asc_nulls_first(v.column)] if v.kind is Kind.I64 else [v.column.asc(), F.when(v.column == 0, F.atan2(v.column, F.lit(-1.0))).asc()]  # the sign decides only between zeros
    return Vec(v.kind, Frame(numbered(v.frame.df, order, v.frame.length, split=F.col(POS)), v.frame.length), v.column)


def unique(spark: SparkSession, x: Value) -> Vec:
    """Distinct elements in the order in which they are first seen; floats by their bits."""
    _numeric(x, "?")
    if isinstance(x, Atom):
        return as_vector(spark, x)
    v = gathered(x)
    name = fresh()
    if v.kind is Kind.F64:
        firsts = v.frame.df.groupBy(v.column.cast("string").alias("_s")).agg(F.min(POS).alias(POS), F.first(v.column).alias(name)).drop("_s")
    else:
        firsts = v.frame.df.groupBy(v.column.alias(name)).agg(F.min(POS).alias(POS))
    return Vec(v.kind, Frame(renumbered(firsts, v.frame.length)), F.col(name))


def reverse(x: Value) -> Value:
    _plain(x, "|")
    if isinstance(x, Atom):
        return x
    v = gathered(x)
    size = v.size()
    return Vec(v.kind, Frame(v.frame.df.withColumn(POS, F.lit(size - 1) - F.col(POS)), size), v.column)


def where(x: Value) -> Vec:
    """The positions of true or non-zero elements; null is not zero."""
    if not isinstance(x, Vec) or x.kind not in (Kind.BOOL, Kind.I64):
        raise KindError("& needs a vector of booleans or integers")
    name = fresh()
    kept = x.frame.df.filter(x.column if x.kind is Kind.BOOL else ~x.column.eqNullSafe(F.lit(0).cast("bigint")))
    return Vec(Kind.I64, Frame(renumbered(kept.select(POS, F.col(POS).cast("bigint").alias(name)), x.frame.length)), F.col(name))


def make_dict(keys: Value, values: Value) -> Dict | Table:
    """A dictionary of two vectors of one length. With a list of vectors as values, names become columns when flipped."""
    if isinstance(keys, Atom) or isinstance(values, Atom):
        raise KindError("! needs two vectors")
    if isinstance(keys, Vec) and isinstance(values, Vec):
        if keys.frame is values.frame:
            return Dict(keys, values)
        frame, a, b = aligned(keys, values)
        return Dict(Vec(keys.kind, frame, a), Vec(values.kind, frame, b))
    if isinstance(keys, Vec) and keys.kind is Kind.SYM and isinstance(values, List):
        if keys.size() != len(values):
            raise ShapeError("as many names as vectors are needed")
        return Dict(keys, values)
    raise KindError("! needs two vectors, or names and a list of vectors")


def lookup(spark: SparkSession, d: Dict, key: Value) -> Value:
    """The value of the first entry with the key, or the value kind's null."""
    if not isinstance(key, Atom) or key.kind is not d.keys.kind or key.kind not in NULLABLE:
        raise KindError("@ needs an atom of the keys' kind")
    if isinstance(d.values, List):
        names = [r[0] for r in d.keys.frame.df.orderBy(POS).select(d.keys.column).collect()]
        wanted = key.get(spark)
        if wanted not in names:
            raise ShapeError(f"no entry {wanted!r}")
        return d.values.items[names.index(wanted)]
    same = d.keys.column.cast("string").eqNullSafe(key.column().cast("string")) if key.kind is Kind.F64 else d.keys.column.eqNullSafe(key.column())
    found = d.keys.frame.df.filter(same).agg(F.min_by(d.values.column, F.col(POS))).scalar()
    if d.values.kind is Kind.F64:
        found = F.coalesce(found, F.lit(math.nan))
    elif d.values.kind is Kind.SYM:
        found = F.coalesce(found, F.lit(""))
    elif d.values.kind is not Kind.I64:
        found = F.coalesce(found, F.raise_error(F.lit("shape: no such key")))
    return Atom(d.values.kind, lazy=found)


def lookup_all(d: Dict, keys: Vec) -> Vec:
    """The lookup for each element of a vector, misses alike: an equality join with the first entry of each key."""
    if keys.kind is not d.keys.kind:
        raise KindError("keys of another kind")
    k, v, own = fresh("k"), fresh(), fresh("k")

    def same(c):  # floats by their bits, as for one key
        return c.cast("string") if keys.kind is Kind.F64 else c

    firsts = d.keys.frame.df.groupBy(same(d.keys.column).alias(k)).agg(F.min_by(d.values.column, F.col(POS)).alias(v))
    rows = keys.frame.df.select(F.col(POS).cast("bigint").alias(POS), same(keys.column).alias(own))
    joined = rows.join(firsts, F.col(own).eqNullSafe(F.col(k)), "left")
    found = F.col(v)
    if d.values.kind is Kind.F64:
        found = F.coalesce(found, F.lit(math.nan))
    elif d.values.kind is Kind.SYM:
        found = F.coalesce(found, F.lit(""))
    elif d.values.kind is not Kind.I64:
        found = F.coalesce(found, F.raise_error(F.lit("shape: no such key")))
    return Vec(d.values.kind, Frame(joined.select(POS, found.alias(v)), keys.frame.length), F.col(v))


def flip(spark: SparkSession, d: Dict) -> Table:
    """A dictionary as a table: named vectors of one length become its columns."""
    if not isinstance(d.values, List):
        return Table(source=d)
    names = [r[0] for r in d.keys.frame.df.orderBy(POS).select(d.keys.column).collect()]
    vectors = [as_vector(spark, v) for v in d.values.items]
    if len({v.size() for v in vectors}) > 1:
        raise ShapeError("columns of different lengths")
    frame, held = None, {}
    for n, v in zip(names, vectors, strict=True):
        g = gathered(v)
        joined = g.frame.df if frame is None else frame.join(g.frame.df, POS)
        frame = joined
        held[n] = (g.kind, g.column)
    whole = Frame(frame, vectors[0].size())
    return Table(columns={n: Vec(k, whole, c) for n, (k, c) in held.items()})


__all__ = ["as_vector", "concat", "count", "drop", "enlist", "flip", "index", "lookup", "lookup_all", "make_dict", "reverse", "sort", "string", "take", "text", "til", "type_of", "unique", "where"]
