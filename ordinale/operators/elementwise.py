"""Verbs that work element by element: projections on one frame, a join on positions between two."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import KindError
from ..functions import exact
from ..kinds import NUMERIC, Kind, wrap
from .values import POS, Atom, Dict, Lambda, List, Table, Value, Vec, aligned


def _null(v: object) -> bool:
    return v is None


def _f(v: object) -> float:
    return math.nan if v is None else float(v)


def _divide(a: float, b: float) -> float:
    if b:
        return a / b
    return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)


@dataclass(frozen=True)
class Form:
    """One kind's form of a dyadic verb: the result's kind, the driver's arithmetic and the column's."""

    kind: Kind
    fold: Callable
    column: Callable[[Column, Column], Column]


def _wrapping(op: Callable[[int, int], int]) -> Callable:
    return lambda a, b: None if _null(a) or _null(b) else wrap(op(a, b))


def _less(a: int | None, b: int | None) -> bool:
    return (a is None and b is not None) or (a is not None and b is not None and a < b)


def _min_f(a: float, b: float) -> float:
    return b if math.isnan(a) else a if math.isnan(b) else min(a, b)


def _max_f(a: float, b: float) -> float:
    return b if math.isnan(a) else a if math.isnan(b) else max(a, b)


def _add_f(a: float, b: float) -> float:
    return a + b


def _times_f(a: float, b: float) -> float:
    return a * b


B, J, FL = Kind.BOOL, Kind.I64, Kind.F64
#: (form on integers, form on floats); None: integers are promoted.
FORMS: dict[str, tuple[Form | None, Form]] = {
    "+": (Form(J, _wrapping(lambda a, b: a + b), exact.add_i64), Form(FL, _add_f, lambda x, y: x + y)),
    "-": (Form(J, _wrapping(lambda a, b: a - b), exact.subtract_i64), Form(FL, lambda a, b: a - b, lambda x, y: x - y)),
    "*": (Form(J, _wrapping(lambda a, b: a * b), exact.multiply_i64), Form(FL, _times_f, lambda x, y: x * y)),
    "%": (None, Form(FL, _divide, exact.divide)),
    "=": (Form(B, lambda a, b: a == b, exact.equal_i64), Form(B, lambda a, b: a == b, exact.equal_f64)),
    "<": (Form(B, _less, exact.less_i64), Form(B, lambda a, b: a < b, exact.less_f64)),
    ">": (Form(B, lambda a, b: _less(b, a), lambda x, y: exact.less_i64(y, x)), Form(B, lambda a, b: a > b, lambda x, y: exact.less_f64(y, x))),
    "&": (Form(J, lambda a, b: None if _null(a) or _null(b) else min(a, b), exact.min_i64), Form(FL, _min_f, exact.min_f64)),
    "|": (Form(J, lambda a, b: b if _null(a) else a if _null(b) else max(a, b), exact.max_i64), Form(FL, _max_f, exact.max_f64)),
}
#: Verbs for which a vector of one element stands for as many as needed.
BROADCAST_ONE = frozenset("=<>&|")


def _one(vec: Vec) -> bool:
    return vec.frame.length == 1


def dyad(verb: str, x: Value, y: Value) -> Value:
    """x verb y for arithmetic, comparison, minimum and maximum. Integers become floats beside a float and under division."""
    if not (isinstance(x, Atom | Vec) and isinstance(y, Atom | Vec)) or x.kind not in NUMERIC or y.kind not in NUMERIC:
        raise KindError(f"{verb} has no form for these kinds")
    whole, real = FORMS[verb]
    form = whole if whole is not None and x.kind is y.kind is Kind.I64 else real
    promote = form is real
    if isinstance(x, Atom) and isinstance(y, Atom) and x.folded and y.folded:
        return Atom(form.kind, form.fold(_f(x.value), _f(y.value)) if promote else form.fold(x.value, y.value))

    def cast(c: Column) -> Column:
        return exact.to_f64(c) if promote else c

    if isinstance(x, Atom) and isinstance(y, Atom):
        return Atom(form.kind, lazy=form.column(cast(x.column()), cast(y.column())))
    if isinstance(x, Vec) and isinstance(y, Vec):
        if verb in BROADCAST_ONE and x.frame is not y.frame and _one(x) != _one(y):
            if _one(x):
                return Vec(form.kind, y.frame, form.column(cast(_scalar(x)), cast(y.column)))
            return Vec(form.kind, x.frame, form.column(cast(x.column), cast(_scalar(y))))
        frame, a, b = aligned(x, y, one=verb in BROADCAST_ONE)
        return Vec(form.kind, frame, form.column(cast(a), cast(b)))
    frame = x.frame if isinstance(x, Vec) else y.frame
    a, b = (v.column if isinstance(v, Vec) else v.column() for v in (x, y))
    return Vec(form.kind, frame, form.column(cast(a), cast(b)))


def _scalar(vec: Vec) -> Column:
    return vec.frame.df.select(vec.column).scalar()


def _fold_floor(v: float) -> int:
    if math.isnan(v):
        return 0
    return int(min(max(math.floor(v) if math.isfinite(v) else math.copysign(2**63, v), -(2**63)), 2**63 - 1))


def _mapped(x: Value, kind: Kind, fold: Callable, column: Callable[[Column], Column]) -> Value:
    if isinstance(x, Atom):
        return Atom(kind, fold(x.value)) if x.folded else Atom(kind, lazy=column(x.column()))
    return Vec(kind, x.frame, column(x.column))


def negate(x: Value) -> Value:
    return dyad("-", Atom(Kind.I64, 0), x)


def invert(x: Value) -> Value:
    """Not: of a boolean, or whether a number is zero."""
    if isinstance(x, Atom | Vec) and x.kind is Kind.BOOL:
        return _mapped(x, Kind.BOOL, lambda v: not v, lambda c: ~c)
    if isinstance(x, Atom | Vec) and x.kind is Kind.I64:
        return _mapped(x, Kind.BOOL, lambda v: v == 0, exact.is_zero)
    if isinstance(x, Atom | Vec) and x.kind is Kind.F64:
        return _mapped(x, Kind.BOOL, lambda v: v == 0, lambda c: exact.to_f64(c) == 0)
    raise KindError("~ needs a boolean or a number")


def floor(x: Value) -> Value:
    if isinstance(x, Atom | Vec) and x.kind is Kind.I64:
        return x
    if isinstance(x, Atom | Vec) and x.kind is Kind.F64:
        return _mapped(x, Kind.I64, _fold_floor, exact.floor_f64)
    raise KindError("_ needs a number")


def square_root(x: Value) -> Value:
    if isinstance(x, Atom | Vec) and x.kind in NUMERIC:
        return _mapped(x, Kind.F64, lambda v: math.sqrt(_f(v)) if _f(v) >= 0 else math.nan, exact.square_root)
    raise KindError("% needs a number")


def match(x: Value, y: Value) -> Atom:
    """Whether both have one kind, one length and equal elements; floats are compared by their bits, composites in depth."""
    if type(x) is not type(y):
        return Atom(Kind.BOOL, False)
    if isinstance(x, Atom):
        if x.kind is not y.kind:
            return Atom(Kind.BOOL, False)
        if x.folded and y.folded:
            same = repr(_f(x.value)) == repr(_f(y.value)) if x.kind is Kind.F64 else x.value == y.value
            return Atom(Kind.BOOL, same)
        return Atom(Kind.BOOL, lazy=_same(x.kind)(x.column(), y.column()))
    if isinstance(x, Vec):
        if x.kind is not y.kind or None not in (x.frame.length, y.frame.length) and x.frame.length != y.frame.length:
            return Atom(Kind.BOOL, False)
        if x.frame is y.frame:
            return Atom(Kind.BOOL, lazy=x.frame.df.agg(F.coalesce(F.every(_same(x.kind)(x.column, y.column)), F.lit(True))).scalar())
        one = x.frame.df.select(POS, F.struct(x.column.alias("v")).alias("_x"))
        two = y.frame.df.select(POS, F.struct(y.column.alias("v")).alias("_y"))
        equal = F.col("_x").isNotNull() & F.col("_y").isNotNull() & _same(x.kind)(F.col("_x.v"), F.col("_y.v"))
        return Atom(Kind.BOOL, lazy=one.join(two, POS, "full_outer").agg(F.coalesce(F.every(equal), F.lit(True))).scalar())
    if isinstance(x, List):
        return _all([match(a, b) for a, b in zip(x.items, y.items, strict=True)]) if len(x) == len(y) else Atom(Kind.BOOL, False)
    if isinstance(x, Dict):
        return _all([match(x.keys, y.keys), match(x.values, y.values)])
    if isinstance(x, Table) and x.source is not None and y.source is not None:
        return match(x.source, y.source)
    if isinstance(x, Table) and list(x.columns) == list(y.columns):
        return _all([match(x.columns[n], y.columns[n]) for n in x.columns])
    return Atom(Kind.BOOL, isinstance(x, Lambda) and (x.params, x.body) == (y.params, y.body))


def _same(kind: Kind) -> Callable[[Column, Column], Column]:
    return exact.identical_f64 if kind is Kind.F64 else lambda a, b: a.eqNullSafe(b)


def _all(parts: list[Atom]) -> Atom:
    if all(p.folded for p in parts):
        return Atom(Kind.BOOL, all(p.value for p in parts))
    out = F.lit(True)
    for p in parts:
        out = out & p.column()
    return Atom(Kind.BOOL, lazy=out)


def choose(condition: Vec, then: Value, other: Value) -> Vec:
    """A conditional for each element of a boolean or numeric vector; null and NaN count as true, as they are not zero."""
    frame = condition.frame
    true = ~invert(condition).column if condition.kind is not Kind.BOOL else condition.column
    columns = []
    kinds = {then.kind, other.kind}
    kind = then.kind if len(kinds) == 1 else Kind.F64 if kinds <= set(NUMERIC) else None
    if kind is None:
        raise KindError("both branches need one kind")
    for v in (then, other):
        if isinstance(v, Vec) and v.frame is not frame:
            raise KindError("branches are atoms or vectors of the condition's frame")
        c = v.column if isinstance(v, Vec) else v.column()
        columns.append(exact.to_f64(c) if kind is Kind.F64 else c)
    return Vec(kind, frame, F.when(true, columns[0]).otherwise(columns[1]))


__all__ = ["BROADCAST_ONE", "FORMS", "choose", "dyad", "floor", "invert", "match", "negate", "square_root"]
