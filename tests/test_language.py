"""Programs and their values, by source text."""

import math

import pytest

from ordinale.errors import EmptyProgram, EvalError, KindError, ParseError, ShapeError, UndefinedName
from ordinale.operators.values import Atom, Vec
from ordinale.plans.session import Session
from ordinale.plans.syntax import parse

#: (source, kind letter as the type verb shows it, value)
ATOMS = [
    ("42", "j", 42), ("3.5", "f", 3.5), ("10 - 3", "j", 7), ("7 % 2", "f", 3.5), ("2 * 3 + 4", "j", 14), ("(2 * 3) + 4", "j", 10), ("+/ 1 2 3 4 5", "j", 15), ("+/ 1.5 2.5 3.0", "f", 7.0),
    ("- 5", "j", -5), ("+/!100", "j", 4950), ("odd: 1 + 2 * !6; +/odd", "j", 36), ("@42", "n", "j"), ("@1 2 3", "n", "J"), ("@3.14", "n", "f"), ("@1.0 2.0", "n", "F"), ("#42", "j", 1), ("#1 2 3 4 5", "j", 5),
    ("#!1000", "j", 1000), ("5 = 5", "b", True), ("5 = 6", "b", False), ("42 ~ 42", "b", True), ("42 ~ 42 42 42", "b", False), ("1 2 3 ~ 1 2 3", "b", True), ("1 ~ 1.0", "b", False), ("1 2 3 ~ 1 2 4", "b", False),
    ("3 & 5", "j", 3), ("3 | 5", "j", 5), ("#+\\!10", "j", 10), ("_ 3.7", "j", 3), ("_ -1.5", "j", -2), ("~ 0 = 0", "b", False), ("~5", "b", False), ("~0", "b", True), ("%16", "f", 4.0), ("#'5", "j", 1),
    ("@ 1 2 3 ! 10 20 30", "n", "!"), ("(1 2 3 ! 10 20 30) @ 2", "j", 20), ("(1 2 3 ! 10 20 30) @ 99", "j", None), ("10 20 30 40 50 @ 2", "j", 30), ("10 20 30 @ 5", "j", None), ("#1 2 3 ! 10 20 30", "j", 3),
    ("$[7 > 2; 11 * 3; 0]", "j", 33), ("$[0N = 1; 5; 6 - 8]", "j", -2), ("$[0.0 * 2; 8; 9]", "j", 9), ("$[2.5; 8; 9]", "j", 8), ("$[+/ 1 2 - 3; # 4 4; 0]", "j", 2), ("{(x * x) - 1}[6]", "j", 35), ("{[lo;hi] hi - lo}[12;30]", "j", 18),
    ("half: {x % 2}; half[9]", "f", 4.5), ("up: {x + 3}; up[up[up[up[0]]]]", "j", 12), ("clip: {$[x > 9; 9; x]}; clip[40]", "j", 9), ("{x - y}[3;4]", "j", -1), ("{x * y + z}[2;3;4]", "j", 14), ("{z}[1;2;77]", "j", 77),
    ("pow: {$[x = 0; 1; 3 * pow[x - 1]]}; pow[7]", "j", 2187), ("gcd: {[a;b] $[b = 0; a; gcd[b; a - b * _ a % b]]}; gcd[84;30]", "j", 6), ("#(1;2;3)", "j", 3), ("#'1 2 3", "j", 3),
    # beyond the everyday cases
    ("9223372036854775807 + 1", "j", -(2**63)), ("0N + 1", "j", None), ("0N = 0N", "b", True), ("0N < 5", "b", True), ("0N > 5", "b", False), ("0N & 5", "j", None), ("0N | 5", "j", 5), ("0n = 0n", "b", False), ("0n < 1", "b", False),
    ("0n & 1.0", "f", 1.0), ("0n | 1.0", "f", 1.0), ("1 % 0", "f", math.inf), ("(0 - 1) % 0", "f", -math.inf), ("_ 0n", "j", 0), ("_ 0w", "j", 2**63 - 1), ("+/ !0", "j", 0), ("0n ~ 0n", "b", True), ("(1;2.0) ~ (1;2.0)", "b", True),
    ("(1 2 ! 3 4) ~ 1 2 ! 3 4", "b", True), ("{[x] -x}[3]", "j", -3), ("+/ 1 0N 3", "j", 4), ("(1 1 2 ! 10 20 30) @ 1", "j", 10), ("(`a`b ! 1 2) @ `b", "j", 2), ("(1.5 2.5 ! 1 2) @ 2.5", "j", 2), ("`a ~ `a", "b", True),
    ('@"abc"', "n", "C"), ('@"a"', "n", "c"), ("@`a`b", "n", "N"), ("@{x}", "n", "F"), ("@(1;2.0)", "n", "L"), ("@+1 2!3 4", "n", "+"), ("#+1 2 3!4 5 6", "j", 3), ("{x}[1]", "j", 1), ("$[,0; 1; 2]", "j", 2), ("$[0#1; 1; 2]", "j", 2),
    ("{5}[]", "j", 5), ("# ,1 2!3 4", "j", 1), ("+/0W 1", "j", -(2**63)), ("1 2.5 ~ 1.0 2.5", "b", True),
]
VECTORS = [
    ("1 2 3", "J", [1, 2, 3]), ("1.5 2.5 3.5", "F", [1.5, 2.5, 3.5]), ("1 2 3 + 10", "J", [11, 12, 13]), ("2 3 4 * 10", "J", [20, 30, 40]), ("low: 4 5; high: low * 3; high - low", "J", [8, 10]), ("1 0N 3 + 10", "J", [11, None, 13]),
    ("!5", "J", [0, 1, 2, 3, 4]), ("!0", "J", []), (",42", "J", [42]), (",3.5", "F", [3.5]), ("1 2 3 , 10 20", "J", [1, 2, 3, 10, 20]), ("99 , 1 2 3", "J", [99, 1, 2, 3]), ("3 # 10 20 30", "J", [10, 20, 30]),
    ("3 # 10 20 30 40 50", "J", [10, 20, 30]), ("7 # 1 2 3", "J", [1, 2, 3, 1, 2, 3, 1]), ("3 # !100", "J", [0, 1, 2]), ("1 5 3 < 2 5 1", "B", [True, False, False]), ("1 5 3 10 > 3", "B", [False, True, False, True]),
    ("1 2 3 = 1.0 2.0 4.0", "B", [True, True, False]), ("1 5 3 & 2 4 7", "J", [1, 4, 3]), ("1 5 3 10 | 4", "J", [4, 5, 4, 10]), ("1.5 2.5 3.5 & 2 2 2", "F", [1.5, 2.0, 2.0]), ("+\\1 2 3 4 5", "J", [1, 3, 6, 10, 15]),
    ("+\\!5", "J", [0, 1, 3, 6, 10]), ("+\\1.0 2.0 3.0", "F", [1.0, 3.0, 6.0]), ("_ 1.5 2.9 3.0", "J", [1, 2, 3]), ("2 _ 1 2 3 4 5", "J", [3, 4, 5]), ("(-2) _ 1 2 3 4 5", "J", [1, 2, 3]), ("10 _ 1 2 3", "J", []),
    ("$42", "C", list("42")), ("$ -1", "C", list("-1")), ("$3.5", "C", list("3.5")), ("$ 0 = 0", "C", list("1b")), ("$ 0 = 1", "C", list("0b")), ("~ 1 2 3 = 1 5 3", "B", [False, True, False]), ("^5 2 8 1 9 3", "J", [1, 2, 3, 5, 8, 9]),
    ("^3.5 1.5 2.5", "F", [1.5, 2.5, 3.5]), ("?3 1 2 1 3 4 2", "J", [3, 1, 2, 4]), ("%1.0 4.0 9.0 16.0", "F", [1.0, 2.0, 3.0, 4.0]), ("|1 2 3 4 5", "J", [5, 4, 3, 2, 1]), ("& 1 2 3 4 5 > 2", "J", [2, 3, 4]), ("-'1 2 3", "J", [-1, -2, -3]),
    ("%'1 4 9 16", "F", [1.0, 2.0, 3.0, 4.0]), ("+':1 2 3 4", "J", [1, 3, 5, 7]), ("-':1 3 6 10", "J", [1, 2, 3, 4]), ("-':+\\1 2 3 4 5", "J", [1, 2, 3, 4, 5]), ("!1 2 3 ! 10 20 30", "J", [1, 2, 3]), (".1 2 3 ! 10 20 30", "J", [10, 20, 30]),
    ("{!x}[5]", "J", [0, 1, 2, 3, 4]), ("(1;2;3)", "J", [1, 2, 3]), ("(1.0;2.0;3.0)", "F", [1.0, 2.0, 3.0]),
    # beyond the everyday cases
    ("9223372036854775807 1 + 1", "J", [-(2**63), 2]), ("-2 _ 1 2 3", "J", [-3]), ("0 # 1 2", "J", []), ("^ 3 0N 1", "J", [None, 1, 3]), ("(0 = 1 2) , 1 = 1", "B", [False, False, True]), ("$ 4.0", "C", ["4"]), ("$ 0N", "C", ["0", "N"]), ("$ 0n", "C", ["0", "n"]),
    ("$ `ab", "C", ["a", "b"]), ("1 2 3 = ,2", "B", [False, True, False]), ("0N 1 + 0N 2", "J", [None, 3]), ("+\\1 0N 2", "J", [1, 1, 3]), ("-':1 0N 2", "J", [1, None, None]), ("? 5", "J", [5]), ("(1 = 1; 1 = 2)", "B", [True, False]),
    ("`a`b , `c", "N", ["a", "b", "c"]), ('"ab" , "c"', "C", ["a", "b", "c"]), ("| `a`b", "N", ["b", "a"]), ("& 0 2 0 3", "J", [1, 3]), ("2 # `x", "N", ["x", "x"]), ('"a\\n\\"b"', "C", ["a", "\n", '"', "b"]), ("0W 1.5", "F", [math.inf, 1.5]),
    ("v: & 0 1 0; 1 2 3 = v", "B", [True, False, False]), ("v: & 0 1 0; v | 1 2 3", "J", [1, 2, 3]), ("v: & 0 0 1; w: & 1 1 0; v > w", "B", [True, True]), ("v: & 0 1 0; w: & 0 0 1; v < w", "B", [True]), ("v: & 0 0 1 1; 2 3 = v", "B", [True, True]),
    ("1 2 3 % 2", "F", [0.5, 1.0, 1.5]), ("5 - 1 2", "J", [4, 3]), ("f: {x + 1}; f[f[1 2]]", "J", [3, 4]), ("~ 0 0N 2", "B", [True, False, False]), ("1e3 2", "F", [1000.0, 2.0]),
]
ERRORS = [
    ("{[a;b] a+b}[3]", ShapeError), ("nope", UndefinedName), ("a_b", UndefinedName), ("", EmptyProgram), ("1 2 + 1 2 3", ShapeError), ("1 2 = 1 2 3", ShapeError), ("*1 2", KindError), ("=1 2", KindError), ("<1 2", KindError), (">1 2", KindError), ("1 $ 2", KindError),
    ("1 ^ 2", KindError), ("1 ? 2", KindError), ("1 . 2", KindError), ("*/1 2", KindError), ("&\\1 2", KindError), ("*':1 2", KindError), ("+':1.0 2.0", KindError), ("1 , 2.0", KindError), ("(-1) # 1 2", KindError), ("1 # !0", ShapeError), ("1 ! 2", KindError),
    ("1 2 ! 3", KindError), ("1 2 ! 3 4 5", ShapeError), ("! -1", ShapeError), ("! 1.5", KindError), ("$ 1 2", KindError), ("$'1 2", KindError), ("!'1 2", KindError), ("& 1", KindError), ("1 2 @ 0 1", KindError), ("v: 1 2; v[0]", KindError), ('"ab" @ 5', ShapeError),
    ("(1 2 ! 3 4) @ `a", KindError), ("`a = `a", KindError), ("(1=1) & 1=1", KindError), ("f: {x}; 2 # f", KindError), (",{x}", KindError), ("1 + (1;2.0)", KindError), ("+`a`b!(1 2;3 4 5)", ShapeError), ("f: {f[x]}; f[1]", EvalError), (".5", KindError), ("1 2 3 = & 0 1 1 0", Exception), ("v: & 0 1 0; 1 2 3 + v", Exception),
]
MALFORMED = ["(1", "1 )", "$[1;2]", "{x", '"abc', "f[1", "1 `a", "`toolongname", "longername1: 3", "1 + ", "(a: 1)", "{a: 1}", "#", "1;;2", "~", "'", '"\\q"', "1 2 3 é", "99999999999999999999", "1e"]


def value(spark, source):
    out = Session(spark).eval(source)
    if isinstance(out, Atom):
        return out.kind, out.get(spark)
    assert isinstance(out, Vec)
    rows = out.to_df().orderBy("pos").collect()
    assert [r[0] for r in rows] == list(range(len(rows)))
    return out.kind, [r[1] for r in rows]


@pytest.mark.parametrize(("source", "letter", "want"), ATOMS)
def test_atom(spark, source, letter, want):
    from ordinale.kinds import letter as of

    kind, got = value(spark, source)
    assert (of(kind, False), got) == (letter, want)


@pytest.mark.parametrize(("source", "letter", "want"), VECTORS)
def test_vector(spark, source, letter, want):
    from ordinale.kinds import letter as of

    kind, got = value(spark, source)
    assert (of(kind, True), got) == (letter, want)


@pytest.mark.parametrize(("source", "error"), ERRORS)
def test_error(spark, source, error):
    with pytest.raises(error):
        value(spark, source)


@pytest.mark.parametrize("source", MALFORMED)
def test_malformed(source):
    with pytest.raises(ParseError):
        parse(source)


def test_composites(spark):
    from ordinale.operators.values import Dict, Lambda, List, Table

    s = Session(spark)
    assert isinstance(s.eval("1 2 3 ! 10 20 30"), Dict)
    assert isinstance(s.eval("+1 2 3 ! 10 20 30"), Table)
    assert isinstance(s.eval("(1;2.0)"), List)
    assert isinstance(s.eval("{x}"), Lambda)
    flipped = s.eval("+`k`v!(1 2;3.0 4.0)")
    assert [tuple(r) for r in flipped.to_df().orderBy("pos").collect()] == [(0, 1, 3.0), (1, 2, 4.0)]


def test_parameters_are_restored(spark):
    s = Session(spark)
    s.eval("x: 7; {x+1}[1]")
    assert s.names["x"].value == 7
    s.eval("{y}[1;2]")
    assert "y" not in s.names


def test_long_scan(spark):
    got = dict(Session(spark).df("+\\!300000").where("pos in (0, 1, 2, 99, 299999)").collect())
    assert got == {i: i * (i + 1) // 2 for i in (0, 1, 2, 99, 299999)}


def test_unknown_lengths_that_differ_fail_the_query(spark):
    s = Session(spark)
    s.eval("a: & 1 0 1 1 > 0; b: & 1 1 0 0 > 0")
    with pytest.raises(Exception, match="shape"):
        s.df("a + b").count()
