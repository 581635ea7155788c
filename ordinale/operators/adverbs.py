"""Adverbs: over, scan, each and eachprior."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..errors import KindError
from ..functions import exact
from ..kinds import NUMERIC, Kind
from .positions import previous, running_sum
from .values import POS, Atom, Frame, Value, Vec, fresh


def over(verb: str, x: Value) -> Atom:
    """The sum of a vector: partial sums by task, then their sum. Null integers are skipped; NaN is not."""
    if verb != "+" or not isinstance(x, Atom | Vec) or x.kind not in NUMERIC:
        raise KindError(f"{verb}/ has no form for this")
    if isinstance(x, Atom):
        return x
    most = None if x.bound is None or x.frame.length is None else x.bound * x.frame.length
    total = exact.sum_i64(x.column, most) if x.kind is Kind.I64 else exact.sum_f64(exact.to_f64(x.column))
    return Atom(x.kind, lazy=x.frame.df.agg(total).scalar())


def scan(verb: str, x: Value) -> Value:
    """Running sums; null integers count as 0.

    Floats are added in another order where a frame is large than where it is small, so the
    last bits of their sums can differ between sizes; sums of integers are exact throughout.
    """
    if verb != "+" or not isinstance(x, Atom | Vec) or x.kind not in NUMERIC:
        raise KindError(f"{verb}\\ has no form for this")
    if isinstance(x, Atom):
        return x
    name = fresh()
    integer = x.kind is Kind.I64
    df = running_sum(x.frame.df, x.column if integer else exact.to_f64(x.column), integer, name, x.frame.length)
    return Vec(x.kind, Frame(df, x.frame.length), F.col(name))


def each(monad: Callable[[Value], Value], x: Value) -> Value:
    """The verb on the whole vector."""
    if not isinstance(x, Atom) and not (isinstance(x, Vec) and x.kind in (*NUMERIC, Kind.BOOL)):
        raise KindError("' needs numbers or booleans")
    return monad(x)


def eachprior(verb: str, x: Value) -> Value:
    """Each element with the one before it; the first stays as it is."""
    if verb not in "+-" or not isinstance(x, Vec) or x.kind is not Kind.I64:
        raise KindError(f"{verb}': has no form for this")
    own, before, name = fresh(), fresh("p"), fresh()
    df = previous(x.frame.df, x.column, own, before, x.frame.length)
    op = exact.add_i64 if verb == "+" else exact.subtract_i64
    first = F.col(POS) == 0
    out = df.select(POS, F.when(first, F.col(own)).otherwise(op(F.col(own), F.col(before))).alias(name))
    return Vec(Kind.I64, Frame(out, x.frame.length), F.col(name))
