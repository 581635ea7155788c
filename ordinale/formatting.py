"""Showing values as text, as the shell does."""

from __future__ import annotations

import math
import os
import shutil

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .kinds import MAX_I64, Kind
from .operators.values import POS, Atom, Dict, Lambda, List, Table, Value, Vec

CUT = ".."


def number(value: object, kind: Kind) -> str:
    """A number as the printer shows it; unlike the string verb it marks whole floats with .0."""
    if kind is Kind.BOOL:
        return f"{int(bool(value))}b"
    if kind in (Kind.I16, Kind.I32, Kind.F32) and (value is None or kind is Kind.F32 and math.isnan(value)):
        return {Kind.I16: "0Nh", Kind.I32: "0Ni", Kind.F32: "0ne"}[kind]
    if kind in (Kind.F64, Kind.F32):
        end = "e" if kind is Kind.F32 else ""
        if value is None or math.isnan(value):
            return "0n" + end
        if math.isinf(value):
            return "0w" + end
        return f"{value:.1f}" if value == int(value) and abs(value) < 1e16 else repr(value)
    if value is None:
        return "0N"
    return "0W" if kind is Kind.I64 and value == MAX_I64 else str(value)


def _joined(kind: Kind, values: list) -> str:
    if kind is Kind.CHAR:
        return '"' + "".join(values).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    if kind is Kind.SYM:
        return "".join(f"`{v}" for v in values)
    if kind is Kind.BOOL:
        return "".join(str(int(bool(v))) for v in values) + "b"
    return " ".join(number(v, kind) for v in values)


def width() -> int:
    """Columns of the terminal: asked for, else COLUMNS, else 80."""
    try:
        return os.get_terminal_size().columns
    except OSError:
        return shutil.get_terminal_size((80, 24)).columns


def shown(value: Value, spark: SparkSession, columns: int | None = None) -> str:
    """A value in one line of at most `columns` characters; only as many elements as may fit are fetched."""
    columns = columns or width()
    if isinstance(value, List):
        return "<List>"
    if isinstance(value, Dict):
        return "<Dict>"
    if isinstance(value, Table):
        return "<Table>"
    if isinstance(value, Lambda):
        return "<Lambda>"
    if isinstance(value, Atom):
        line = _joined(value.kind, [value.get(spark)]) if value.kind in (Kind.CHAR, Kind.SYM) else number(value.get(spark), value.kind)
    else:
        assert isinstance(value, Vec)
        fetched = [r[0] for r in value.frame.df.filter(F.col(POS) <= columns).orderBy(POS).select(value.column).collect()]
        line = _joined(value.kind, fetched)
        if len(fetched) > columns:
            line = line.ljust(columns + 1)
    return line if len(line) <= columns else line[: max(0, columns - len(CUT))] + CUT
