"""The query catalogue: one query for each operator, with its SQL equivalent.

Most queries bind columns of a table and evaluate a program's source text, so they go
through parser, lowering and plans alike. Results carry positions, so that order counts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import temporal
from .kinds import Kind
from .operators import elementwise, structural
from .operators.values import POS, Atom, Frame, Vec
from .plans.session import Session
from .sources import tables

#: Position columns of the tables that have one.
POSITIONS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


CATALOGUE: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    df = tables.read(spark, f"{sf_dir}/{name}.parquet")
    return tables.frame(df, pos=POSITIONS[name]) if name in POSITIONS else Frame(df)


def add(name: str, sql: str) -> Callable:
    def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        CATALOGUE[name] = Query(run, sql)
        return run

    return keep


def program(name: str, source: str, sql: str, of: str | None = None, **columns: str) -> None:
    """A query that evaluates `source` with names bound to columns of the table `of`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        if of is not None:
            session.bind(table(spark, sf_dir, of), **columns)
        return session.df(source)

    CATALOGUE[name] = Query(run, sql)


def rows(name: str, source: str, sql: str, of: str, keep: tuple[str, ...], **columns: str) -> None:
    """Like program, for a table without positions: the element-wise result stands beside other columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session, frame = Session(spark), table(spark, sf_dir, of)
        session.bind(frame, **columns)
        return frame.df.select(*keep, session.eval(source).column.alias("val"))

    CATALOGUE[name] = Query(run, sql)


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
LINES = ", ".join(LINE)

# dyadic arithmetic
program("plus_vec_vec", "o + c", "SELECT o_orderkey AS pos, o_orderkey + o_custkey AS val FROM orders", "orders", o="o_orderkey", c="o_custkey")
program("plus_atom_broadcast", "e + 10", "SELECT event_id AS pos, event_id + 10 AS val FROM events", "events", e="event_id")
rows("plus_promote", "n + d", f"SELECT {LINES}, l_linenumber + l_discount AS val FROM lineitem", "lineitem", LINE, n="l_linenumber", d="l_discount")
program("minus_vec_vec", "o - c", "SELECT o_orderkey AS pos, o_orderkey - o_custkey AS val FROM orders", "orders", o="o_orderkey", c="o_custkey")
rows("times_vec_vec", "p * 1 - d", f"SELECT {LINES}, l_extendedprice * (1 - l_discount) AS val FROM lineitem", "lineitem", LINE, p="l_extendedprice", d="l_discount")
program("div_promotes", "o % c", "SELECT o_orderkey AS pos, CASE WHEN o_custkey <> 0 THEN o_orderkey::DOUBLE / o_custkey WHEN o_orderkey = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS val FROM orders", "orders", o="o_orderkey", c="o_custkey")
program("plus_wraps", "o + 0W", "SELECT o_orderkey AS pos, CASE WHEN o_orderkey = 0 THEN 9223372036854775807 ELSE (-9223372036854775808 + (o_orderkey - 1)) END::BIGINT AS val FROM orders", "orders", o="o_orderkey")
program("times_wraps", "o * 0W", "SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE -9223372036854775808::HUGEINT - o_orderkey + CASE WHEN o_orderkey > 0 THEN 18446744073709551616::HUGEINT ELSE 0 END - CASE WHEN -9223372036854775808::HUGEINT - o_orderkey + 18446744073709551616::HUGEINT > 9223372036854775807 THEN 18446744073709551616::HUGEINT ELSE 0 END END::BIGINT AS val FROM orders", "orders", o="o_orderkey")


@add("plus_null_propagates", "SELECT o_orderkey AS pos, nullif(o_custkey, 0) + 10 AS val FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "orders")
    return elementwise.dyad("+", frame.vector(F.nullif(F.col("o_custkey"), F.lit(0))), Atom(Kind.I64, 10)).to_df()


# comparison and match
program("eq_vec_atom", "r = 1", "SELECT n_nationkey::BIGINT AS pos, n_regionkey = 1 AS val FROM nation", "nation", r="n_regionkey")
program("lt_vec_vec", "o < c", "SELECT o_orderkey AS pos, o_orderkey < o_custkey AS val FROM orders", "orders", o="o_orderkey", c="o_custkey")
program("gt_vec_float", "p > 150000.0", "SELECT o_orderkey AS pos, o_totalprice > 150000 AS val FROM orders", "orders", p="o_totalprice")
program("gt_nan", "(0 * v % 0) > v", "SELECT event_id AS pos, false AS val FROM events", "events", v="event_id")
program("match_true", "e ~ e + 0", "SELECT true AS val", "events", e="event_id")
program("match_false", "e ~ u", "SELECT bool_and(event_id = user_id) AS val FROM events", "events", e="event_id", u="user_id")
program("match_across_frames", "v ~ |(|v)", "SELECT true AS val", "events", v="value")


@add("eq_null", "SELECT o_orderkey AS pos, nullif(o_custkey, 0) IS NOT DISTINCT FROM nullif(o_orderkey, 0) AS val FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "orders")
    return elementwise.dyad("=", frame.vector(F.nullif(F.col("o_custkey"), F.lit(0))), frame.vector(F.nullif(F.col("o_orderkey"), F.lit(0)))).to_df()


@add("lt_null_lowest", "SELECT o_orderkey AS pos, CASE WHEN o_custkey = 0 THEN true ELSE o_custkey < 5 END AS val FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.dyad("<", table(spark, sf_dir, "orders").vector(F.nullif(F.col("o_custkey"), F.lit(0))), Atom(Kind.I64, 5)).to_df()


# minimum and maximum
program("min_vec", "o & c", "SELECT o_orderkey AS pos, least(o_orderkey, o_custkey) AS val FROM orders", "orders", o="o_orderkey", c="o_custkey")
program("max_vec", "o | c", "SELECT o_orderkey AS pos, greatest(o_orderkey, o_custkey) AS val FROM orders", "orders", o="o_orderkey", c="o_custkey")
rows("min_float", "q & 1000 * d", f"SELECT {LINES}, least(l_quantity, 1000 * l_discount) AS val FROM lineitem", "lineitem", LINE, q="l_quantity", d="l_discount")
program("max_ignores_nan", "(0 % e) | 0.5", "SELECT event_id AS pos, 0.5::DOUBLE AS val FROM events", "events", e="event_id")


@add("min_null", "SELECT o_orderkey AS pos, CASE WHEN o_custkey = 0 THEN NULL ELSE least(o_custkey, o_orderkey) END AS val FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "orders")
    return elementwise.dyad("&", frame.vector(F.nullif(F.col("o_custkey"), F.lit(0))), frame.vector("o_orderkey")).to_df()


# structure
@add("concat", "SELECT r_regionkey::BIGINT AS pos, r_regionkey::BIGINT AS val FROM region UNION ALL SELECT n_nationkey + (SELECT count(*) FROM region), n_nationkey FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark)
    session.bind(table(spark, sf_dir, "region"), r="r_regionkey")
    session.bind(table(spark, sf_dir, "nation"), n="n_nationkey")
    return session.df("r , n")


program("take", "3 # r", "SELECT r_regionkey::BIGINT AS pos, r_regionkey::BIGINT AS val FROM region WHERE r_regionkey < 3", "region", r="r_regionkey")
program("take_cycle", "12 # 10 * r", "SELECT range AS pos, 10 * r_regionkey::BIGINT AS val FROM range(12) JOIN region ON r_regionkey = range % (SELECT count(*) FROM region)", "region", r="r_regionkey")
program("drop_first", "5 _ r", "SELECT n_nationkey::BIGINT - 5 AS pos, n_regionkey::BIGINT AS val FROM nation WHERE n_nationkey >= 5", "nation", r="n_regionkey")
program("drop_last", "(-5) _ r", "SELECT n_nationkey::BIGINT AS pos, n_regionkey::BIGINT AS val FROM nation WHERE n_nationkey < (SELECT count(*) FROM nation) - 5", "nation", r="n_regionkey")
program("dict_build", "k ! r", "SELECT n_nationkey::BIGINT AS pos, n_nationkey::BIGINT AS key, n_regionkey::BIGINT AS val FROM nation", "nation", k="n_nationkey", r="n_regionkey")
program("dict_keys", "! k ! r", "SELECT n_nationkey::BIGINT AS pos, n_nationkey::BIGINT AS val FROM nation", "nation", k="n_nationkey", r="n_regionkey")
program("dict_values", ". k ! r", "SELECT n_nationkey::BIGINT AS pos, n_regionkey::BIGINT AS val FROM nation", "nation", k="n_nationkey", r="n_regionkey")
program("dict_values_literal", ".1 2 3 ! 10 20 30", "SELECT * FROM (VALUES (0::BIGINT, 10::BIGINT), (1, 20), (2, 30)) AS t(pos, val)")
program("index_hit", "u @ 42", "SELECT user_id AS val FROM events WHERE event_id = 42", "events", u="user_id")
program("index_miss", "u @ -1", "SELECT NULL::BIGINT AS val", "events", u="user_id")
program("index_chain", "u @ u @ 42", "SELECT user_id AS val FROM events WHERE event_id = (SELECT user_id FROM events WHERE event_id = 42)", "events", u="user_id")
program("dict_lookup", "(r ! k) @ 3", "SELECT min(n_nationkey)::BIGINT AS val FROM nation WHERE n_regionkey = 3", "nation", k="n_nationkey", r="n_regionkey")
program("dict_lookup_miss", "(r ! k) @ 99", "SELECT NULL::BIGINT AS val", "nation", k="n_nationkey", r="n_regionkey")


@add("dict_lookup_all", "SELECT c_custkey AS pos, n_regionkey::BIGINT AS val FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    regions = structural.make_dict(nation.vector("n_nationkey"), nation.vector("n_regionkey"))
    return structural.lookup_all(regions, table(spark, sf_dir, "customer").vector("c_nationkey")).to_df()


@add("lookup_all_float_miss", "SELECT n_nationkey::BIGINT AS pos, CASE WHEN n_regionkey < 3 THEN s_acctbal ELSE 'nan'::DOUBLE END AS val FROM nation LEFT JOIN supplier ON s_suppkey = n_regionkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    few = Frame(suppliers.df.where(F.col(POS) < 3))
    return structural.lookup_all(structural.make_dict(few.vector("s_suppkey"), few.vector("s_acctbal")), table(spark, sf_dir, "nation").vector("n_regionkey")).to_df()


@add("flip_table", "SELECT r_regionkey::BIGINT AS pos, r_regionkey::BIGINT AS k, 2.5 * r_regionkey::DOUBLE AS h FROM region")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark)
    session.bind(table(spark, sf_dir, "region"), r="r_regionkey")
    return session.df("+ `k`h ! (r; 2.5 * r)")


# monadic verbs
program("identity", "+ o", "SELECT o_orderkey AS pos, o_orderkey AS val FROM orders", "orders", o="o_orderkey")
program("negate", "- c", "SELECT o_orderkey AS pos, -o_custkey AS val FROM orders", "orders", c="o_custkey")
program("til", "!1000", "SELECT range AS pos, range AS val FROM range(1000)")
program("til_sum", "+/ !1000000", "SELECT 499999500000::BIGINT AS val")
program("type_atom", "@ 42", "SELECT 'j' AS val")
program("count_vec", "# e", "SELECT count(*) AS val FROM events", "events", e="event_id")
program("count_where", "# & p > 150000", "SELECT count(*) AS val FROM orders WHERE o_totalprice > 150000", "orders", p="o_totalprice")
program("enlist", ", +/ r", "SELECT 0::BIGINT AS pos, sum(r_regionkey)::BIGINT AS val FROM region", "region", r="r_regionkey")
program("not_num", "~ r", "SELECT n_nationkey::BIGINT AS pos, n_regionkey = 0 AS val FROM nation", "nation", r="n_regionkey")
program("not_bool", "~ r = 2", "SELECT n_nationkey::BIGINT AS pos, n_regionkey <> 2 AS val FROM nation", "nation", r="n_regionkey")
rows("floor", "_ p", f"SELECT {LINES}, floor(l_extendedprice)::BIGINT AS val FROM lineitem", "lineitem", LINE, p="l_extendedprice")
program("string_of", "$ +/ r", "SELECT unnest(range(length(s))) AS pos, unnest(string_split(s, '')) AS val FROM (SELECT sum(r_regionkey)::VARCHAR AS s FROM region)", "region", r="r_regionkey")
program("sort_asc", "^ b", "SELECT row_number() OVER (ORDER BY c_acctbal) - 1 AS pos, c_acctbal AS val FROM customer", "customer", b="c_acctbal")
program("unique_first_seen", "? u", "SELECT row_number() OVER (ORDER BY p) - 1 AS pos, user_id AS val FROM (SELECT user_id, min(event_id) AS p FROM events GROUP BY 1)", "events", u="user_id")
program("sqrt", "% p", "SELECT p_partkey AS pos, sqrt(p_retailprice) AS val FROM part", "part", p="p_retailprice")
program("reverse", "| r", "SELECT (SELECT count(*) FROM nation) - 1 - n_nationkey AS pos, n_regionkey::BIGINT AS val FROM nation", "nation", r="n_regionkey")
program("where_indices", "& v > 100", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id AS val FROM events WHERE value > 100", "events", v="value")


@add("type_letters", """SELECT * FROM (VALUES ('customer', 'c_custkey', 'J'), ('customer', 'c_name', 'N'), ('customer', 'c_nationkey', 'J'), ('customer', 'c_acctbal', 'F'), ('customer', 'c_mktsegment', 'N'), ('orders', 'o_orderkey', 'J'), ('orders', 'o_custkey', 'J'), ('orders', 'o_orderstatus', 'N'), ('orders', 'o_totalprice', 'F'), ('orders', 'o_orderdate', 'U'), ('orders', 'o_orderpriority', 'N')) AS t(source, name, letter)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name in ("customer", "orders"):
        frame = table(spark, sf_dir, name)
        out += [(name, c, structural.type_of(frame.vector(c)).value) for c in frame.df.columns if c != POS]
    return spark.createDataFrame(out, "source string, name string, letter string")


# adverbs
program("over_sum_int", "+/ c", "SELECT sum(o_custkey)::BIGINT AS val FROM orders", "orders", c="o_custkey")
program("over_empty", "+/ 0 # c", "SELECT 0::BIGINT AS val", "orders", c="o_custkey")
program("over_wraps", "+/ 0W + 0 * c", "SELECT ((9223372036854775807::HUGEINT * count(*) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS val FROM orders", "orders", c="o_custkey")
program("scan_sum", "+\\ u", "SELECT event_id AS pos, (sum(user_id) OVER (ORDER BY event_id))::BIGINT AS val FROM events", "events", u="user_id")
program("each_sqrt", "%' p", "SELECT p_partkey AS pos, sqrt(p_retailprice) AS val FROM part", "part", p="p_retailprice")
program("eachprior_plus", "+': u", "SELECT event_id AS pos, user_id + coalesce(lag(user_id) OVER (ORDER BY event_id), 0) AS val FROM events", "events", u="user_id")
program("eachprior_minus", "-': u", "SELECT event_id AS pos, user_id - coalesce(lag(user_id) OVER (ORDER BY event_id), 0) AS val FROM events", "events", u="user_id")
program("eachprior_inverts_scan", "-': +\\ u", "SELECT event_id AS pos, user_id AS val FROM events", "events", u="user_id")


def _rounded(name: str, source: str, digits: int, sql: str, of: str, **columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        session.bind(table(spark, sf_dir, of), **columns)
        return session.df(source).withColumn("val", F.round("val", digits))

    CATALOGUE[name] = Query(run, sql)


_rounded("over_sum_float", "+/ p", 2, "SELECT round(sum(o_totalprice), 2) AS val FROM orders", "orders", p="o_totalprice")
_rounded("revenue", "+/ p * 1 - d", 2, "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS val FROM lineitem", "lineitem", p="l_extendedprice", d="l_discount")
_rounded("scan_sum_float", "+\\ v", 3, "SELECT event_id AS pos, round(sum(value) OVER (ORDER BY event_id), 3) AS val FROM events", "events", v="value")


# literals, names, control and functions
@add("cond_column", "SELECT o_orderkey AS pos, CASE WHEN o_orderkey < o_custkey THEN o_custkey ELSE -1 END AS val FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "orders")
    less = elementwise.dyad("<", frame.vector("o_orderkey"), frame.vector("o_custkey"))
    return elementwise.choose(less, frame.vector("o_custkey"), Atom(Kind.I64, -1)).to_df()


program("cond_atom", "$[10 < +/ r; # r; 0]", "SELECT CASE WHEN sum(n_regionkey) > 10 THEN count(*) ELSE 0 END AS val FROM nation", "nation", r="n_regionkey")
program("cond_vector_first", "$[r; 1; 2]", "SELECT CASE WHEN n_regionkey <> 0 THEN 1 ELSE 2 END::BIGINT AS val FROM nation WHERE n_nationkey = 0", "nation", r="n_regionkey")
program("lambda_apply", "f: {[a;b] a + 2 * b}; f[o;c]", "SELECT o_orderkey AS pos, o_orderkey + 2 * o_custkey AS val FROM orders", "orders", o="o_orderkey", c="o_custkey")
program("lambda_nested", "f: {x * 2}; f[f[f[r]]]", "SELECT n_nationkey::BIGINT AS pos, 8 * n_regionkey::BIGINT AS val FROM nation", "nation", r="n_regionkey")
program("lambda_factorial", "fac: {$[x<2; 1; x*fac[x-1]]}; fac[20]", "SELECT 2432902008176640000::BIGINT AS val")
program("lambda_fib", "fib: {$[x<2; x; fib[x-1] + fib[x-2]]}; fib[15]", "SELECT 610::BIGINT AS val")
program("list_uniform", "(1; 2; 3) + 10", "SELECT * FROM (VALUES (0::BIGINT, 11::BIGINT), (1, 12), (2, 13)) AS t(pos, val)")
program("list_of_aggregates", "(+/ c; # c)", "SELECT 0::BIGINT AS pos, sum(o_custkey)::BIGINT AS val FROM orders UNION ALL SELECT 1, count(*) FROM orders", "orders", c="o_custkey")
program("strand_promote", "1 2.5 3", "SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 2.5), (2, 3.0)) AS t(pos, val)")
program("strand_symbols", "`red`green`blue", "SELECT * FROM (VALUES (0::BIGINT, 'red'), (1, 'green'), (2, 'blue')) AS t(pos, val)")
program("string_literal", '"abc"', "SELECT * FROM (VALUES (0::BIGINT, 'a'), (1, 'b'), (2, 'c')) AS t(pos, val)")
program("right_to_left", "2 * c - 1", "SELECT o_orderkey AS pos, 2 * (o_custkey - 1) AS val FROM orders", "orders", c="o_custkey")
program("assign_sequence", "a: c + 1; b: a * a; b - a", "SELECT o_orderkey AS pos, (o_custkey + 1) * (o_custkey + 1) - (o_custkey + 1) AS val FROM orders", "orders", c="o_custkey")
program("lengths_differ_broadcast", "r = , 2", "SELECT n_nationkey::BIGINT AS pos, n_regionkey = 2 AS val FROM nation", "nation", r="n_regionkey")


def _one_unknown(name: str, source: str, sql: str) -> None:
    """A vector whose single element is known only when the query runs, beside a longer one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        session.bind(table(spark, sf_dir, "region"), r="r_regionkey")
        session.bind(table(spark, sf_dir, "nation"), n="n_nationkey")
        return session.df(source)

    CATALOGUE[name] = Query(run, sql)


_one_unknown("eq_one_unknown", "n = & r = 3", "SELECT n_nationkey::BIGINT AS pos, n_nationkey = 3 AS val FROM nation")
_one_unknown("max_one_unknown", "(& r = 3) | n", "SELECT n_nationkey::BIGINT AS pos, greatest(n_nationkey, 3)::BIGINT AS val FROM nation")


# temporal
@add("days_since_epoch", "SELECT o_orderkey AS pos, date_diff('day', DATE '2001-01-01', o_orderdate::DATE)::INT AS days FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").df.select(F.col(POS), temporal.days_from_date(F.col("o_orderdate").cast("date")).alias("days"))


@add("days_from_ymd", "SELECT o_orderkey AS pos, date_diff('day', DATE '2001-01-01', o_orderdate::DATE)::INT AS days FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").df.select(F.col(POS), temporal.days_from_ymd(F.year(d), F.month(d), F.dayofmonth(d)).alias("days"))


@add("ymd_from_days", "SELECT o_orderkey AS pos, year(d)::INT AS y, month(d)::INT AS m, day(d)::INT AS d FROM (SELECT o_orderkey, DATE '2001-01-01' + (o_orderkey % 20000 - 10000)::INT AS d FROM orders)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, m, d = temporal.ymd_from_days(F.col("o_orderkey") % 20000 - 10000)
    return table(spark, sf_dir, "orders").df.select(F.col(POS), y.alias("y"), m.alias("m"), d.alias("d"))


@add("leap_years", "SELECT o_orderkey AS pos, (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS leap FROM (SELECT o_orderkey, o_orderkey % 3000 AS y FROM orders)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").df.select(F.col(POS), temporal.is_leap_year(F.col("o_orderkey") % 3000).alias("leap"))


_PARTS = "SELECT event_id, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, microsecond(ts) % 1000000 AS us FROM events"


@add("time_of_day", f"SELECT event_id AS pos, (h * 3600 + mi * 60 + s)::BIGINT AS t_s, ((h * 3600 + mi * 60 + s) * 1000 + us // 1000)::BIGINT AS t_ms, ((h * 3600 + mi * 60 + s) * 1000000::BIGINT + us)::BIGINT AS t_us, ((h * 3600 + mi * 60 + s) * 1000000000::BIGINT + us * 1000)::BIGINT AS t_ns FROM ({_PARTS})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").df.withColumn("_t", F.col("ts").cast("timestamp_ntz"))
    h, m, s = F.hour("_t"), F.minute("_t"), F.second("_t")
    us = F.pmod(F.date_diff(F.col("_t").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 0 + F.expr("cast(date_format(_t, 'SSSSSS') as bigint)"), F.lit(1_000_000))
    fractions = {"s": F.lit(0), "ms": F.floor(us / 1000), "us": us, "ns": us * 1000}
    return df.select(F.col(POS), *(temporal.time_from_hms(h, m, s, fractions[u], u).alias(f"t_{u}") for u in fractions))


@add("hms_from_time", "SELECT o_orderkey AS pos, t // 3600000 AS h, (t // 60000) % 60 AS m, (t // 1000) % 60 AS s, t % 1000 AS f FROM (SELECT o_orderkey, (o_orderkey * 7919) % 86400000 AS t FROM orders)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, m, s, f = temporal.hms_from_time((F.col("o_orderkey") * 7919) % 86_400_000, "ms")
    return table(spark, sf_dir, "orders").df.select(F.col(POS), *(c.cast("bigint").alias(n) for n, c in (("h", h), ("m", m), ("s", s), ("f", f))))


@add("dt_compose", "SELECT o_orderkey AS pos, d * 86400 + t AS dt_s, d * 86400000 + t AS dt_ms, d * 86400000000 + t AS dt_us, d * 86400000000000 + t AS dt_ns FROM (SELECT o_orderkey, date_diff('day', DATE '2001-01-01', o_orderdate::DATE) AS d, o_custkey AS t FROM orders)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = temporal.days_from_date(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").df.select(F.col(POS), *(temporal.datetime_from(days, F.col("o_custkey"), u).alias(f"dt_{u}") for u in temporal.PER_SECOND))


# sources
@add("numbered_rows", "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos, l_extendedprice AS val FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.read(spark, f"{sf_dir}/lineitem.parquet")
    frame = tables.frame(df, order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return Vec(Kind.F64, frame, F.col("l_extendedprice")).to_df()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in CATALOGUE.items()}
