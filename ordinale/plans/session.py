"""Evaluating programs: the tree is lowered to Spark plans, which run when a value is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyProgram, EvalError, KindError, ShapeError, UndefinedName
from ..kinds import Kind
from ..operators import adverbs, elementwise, structural
from ..operators.values import POS, Atom, Dict, Frame, Lambda, List, Table, Value, Vec, vector
from .syntax import Adverb, Assign, Call, Cond, Dyad, Function, Items, Literal, Monad, Name, Program, parse

#: Kinds whose atoms in a list literal make a vector.
UNIFORM = (Kind.I64, Kind.F64, Kind.BOOL, Kind.CHAR, Kind.SYM, Kind.U8)


class Session:
    """Names and their values. Values are immutable plans; assignment never runs a job.

    A conditional on an atom needs its value: if that comes from data, a job runs.
    """

    def __init__(self, spark: SparkSession, names: dict[str, Value] | None = None):
        self.spark, self.names = spark, dict(names or {})

    def bind(self, frame: Frame, *columns: str, **renamed: str) -> Frame:
        """Make columns of a frame available as names (name=column to rename)."""
        for name, column in [*((c, c) for c in columns), *renamed.items()]:
            self.names[name] = frame.vector(column)
        return frame

    def eval(self, source: str | Program) -> Value:
        program = parse(source) if isinstance(source, str) else source
        if not program.statements:
            raise EmptyProgram("nothing to evaluate")
        for statement in program.statements:
            value = self.value(statement)
        return value

    def df(self, source: str, name: str = "val") -> DataFrame:
        """The result as a DataFrame: (pos, val) of a vector, one row of an atom."""
        value = self.eval(source)
        if isinstance(value, Atom):
            return value.to_df(self.spark, name)
        if isinstance(value, Vec):
            return value.to_df(name)
        if isinstance(value, Dict | Table):
            return value.to_df()
        raise KindError("lists and lambdas are no DataFrames")

    def value(self, node: object) -> Value:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def _literal(self, node: Literal) -> Value:
        return Atom(node.kind, node.values[0]) if node.atom else vector(self.spark, node.kind, list(node.values))

    def _name(self, node: Name) -> Value:
        if node.name not in self.names:
            raise UndefinedName(node.name)
        return self.names[node.name]

    def _assign(self, node: Assign) -> Value:
        self.names[node.name] = self.value(node.value)
        return self.names[node.name]

    def _function(self, node: Function) -> Lambda:
        return Lambda(node.params, node.body)

    def _items(self, node: Items) -> Value:
        items = [self.value(x) for x in node.items]
        if all(isinstance(x, Atom) for x in items) and len({x.kind for x in items}) == 1 and items[0].kind in UNIFORM:
            if all(x.folded for x in items):
                return vector(self.spark, items[0].kind, [x.value for x in items])
            cells = F.array(*(x.column() for x in items))
            df = self.spark.range(1).select(F.posexplode(cells).alias(POS, "_item")).withColumn(POS, F.col(POS).cast("bigint"))
            return Vec(items[0].kind, Frame(df, len(items)), F.col("_item"))
        return List(tuple(items))

    def truth(self, value: Value) -> bool:
        """An atom's or a vector's first element's truth; an empty vector is false."""
        if isinstance(value, Vec):
            rows = value.frame.df.filter(F.col(POS) == 0).select(value.column).take(1)
            if not rows:
                return False
            value = Atom(value.kind, rows[0][0])
        if not isinstance(value, Atom) or value.kind not in (Kind.BOOL, Kind.I64, Kind.F64):
            raise KindError("a condition is a boolean or a number")
        return value.get(self.spark) != 0

    def _cond(self, node: Cond) -> Value:
        return self.value(node.then if self.truth(self.value(node.test)) else node.other)

    def _call(self, node: Call) -> Value:
        function = self.value(node.function)
        if not isinstance(function, Lambda):
            raise KindError("this can't be called")
        arguments = [self.value(x) for x in node.arguments]
        if len(arguments) != len(function.params):
            raise ShapeError(f"{len(function.params)} arguments are needed, not {len(arguments)}")
        held = {p: self.names.get(p) for p in function.params}
        self.names.update(zip(function.params, arguments, strict=True))
        try:
            return self.value(function.body)
        except RecursionError:
            raise EvalError("too many calls within calls") from None
        finally:
            for p, v in held.items():
                if v is None:
                    self.names.pop(p, None)
                else:
                    self.names[p] = v

    def _dyad(self, node: Dyad) -> Value:
        left = self.value(node.left)
        return self.dyad(node.verb, left, self.value(node.right))

    def _monad(self, node: Monad) -> Value:
        return self.monad(node.verb, self.value(node.value))

    def _adverb(self, node: Adverb) -> Value:
        x = self.value(node.value)
        if node.adverb == "/":
            return adverbs.over(node.verb, x)
        if node.adverb == "\\":
            return adverbs.scan(node.verb, x)
        if node.adverb == "':":
            return adverbs.eachprior(node.verb, x)
        if node.verb in "$!" and isinstance(x, Vec):
            raise KindError(f"{node.verb}' has no form for a vector")
        return adverbs.each(lambda v: self.monad(node.verb, v), x)

    def dyad(self, verb: str, x: Value, y: Value) -> Value:
        if verb in elementwise.FORMS:
            return elementwise.dyad(verb, x, y)
        if verb == "~":
            return elementwise.match(x, y)
        if verb == ",":
            return structural.concat(self.spark, x, y)
        if verb == "#":
            return structural.take(self.spark, x, y)
        if verb == "_":
            return structural.drop(self.spark, x, y)
        if verb == "!":
            return structural.make_dict(x, y)
        if verb == "@" and isinstance(x, Dict):
            return structural.lookup(self.spark, x, y)
        if verb == "@" and isinstance(x, Vec):
            return structural.index(self.spark, x, y)
        raise KindError(f"{verb} has no form for these kinds")

    def monad(self, verb: str, x: Value) -> Value:
        spark = self.spark
        forms = {
            "+": lambda: structural.flip(spark, x) if isinstance(x, Dict) else x,
            "-": lambda: elementwise.negate(x),
            "!": lambda: x.keys if isinstance(x, Dict) else structural.til(spark, x),
            "@": lambda: structural.type_of(x),
            "#": lambda: structural.count(x),
            ",": lambda: structural.enlist(spark, x),
            "~": lambda: elementwise.invert(x),
            "_": lambda: elementwise.floor(x),
            "$": lambda: structural.string(spark, x),
            "^": lambda: structural.sort(x),
            "?": lambda: structural.unique(spark, x),
            "%": lambda: elementwise.square_root(x),
            "|": lambda: structural.reverse(x),
            "&": lambda: structural.where(x),
        }
        if verb == "." and isinstance(x, Dict):
            return x.values
        if verb not in forms:
            raise KindError(f"{verb} has no monadic form for this")
        return forms[verb]()
