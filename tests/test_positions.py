"""Positions, exact arithmetic and calendar functions, also where frames are large."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordinale.functions import exact, temporal
from ordinale.kinds import wrap
from ordinale.operators import positions
from ordinale.operators.values import Frame

EDGES = [0, 1, -1, 2, 3, 2**31, -(2**31), 2**32, 2**63 - 1, -(2**63), 2**62, 12345678901234567, None]


def test_wrapping(spark):
    rows = [(a, b) for a in EDGES for b in EDGES]
    df = spark.createDataFrame(rows, "a long, b long")
    a, b = F.col("a"), F.col("b")
    out = df.select("a", "b", exact.add_i64(a, b), exact.subtract_i64(a, b), exact.multiply_i64(a, b)).collect()
    for x, y, *got in out:
        want = [None] * 3 if x is None or y is None else [wrap(x + y), wrap(x - y), wrap(x * y)]
        assert got == want, (x, y)


def test_ansi_mode_does_not_matter(spark):
    held = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            test_wrapping(spark)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", held)


def test_wrapping_sum(spark):
    df = spark.createDataFrame([(v,) for v in EDGES * 3], "v long")
    assert df.agg(exact.sum_i64(F.col("v"))).first()[0] == wrap(3 * sum(v for v in EDGES if v is not None))
    assert df.limit(0).agg(exact.sum_i64(F.col("v"))).first()[0] == 0


def test_floats(spark):
    v = [0.0, -0.0, 1.5, -2.0, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(a, b) for a in v for b in v], "a double, b double")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", exact.equal_f64(a, b).alias("eq"), exact.less_f64(a, b).alias("lt"), exact.min_f64(a, b).alias("lo"), exact.max_f64(a, b).alias("hi"), exact.identical_f64(a, b).alias("id")).collect():
        assert (r.eq, r.lt) == (r.a == r.b, r.a < r.b)
        if math.isnan(r.a) or math.isnan(r.b):
            other = r.b if math.isnan(r.a) else r.a
            assert repr(r.lo) == repr(other) == repr(r.hi)
        else:
            assert (r.lo, r.hi) == (min(r.a, r.b), max(r.a, r.b))
        assert r.id == (repr(r.a) == repr(r.b))


@pytest.fixture
def frame(spark):
    return spark.range(1000).select(F.col("id").alias("pos"), (F.xxhash64("id")).alias("v"), (F.col("id") % 7).alias("w"))


@pytest.mark.parametrize("rows", [None, 1000])
def test_running_sum(frame, rows):
    want, total = [], 0
    for _, v in frame.orderBy("pos").select("pos", "v").collect():
        total = wrap(total + v)
        want.append(total)
    got = positions.running_sum(frame, F.col("v"), True, "s", rows, bucket=64)
    assert [r[1] for r in got.orderBy("pos").collect()] == want


@pytest.mark.parametrize("integer", [True, False])
def test_running_sum_in_place(spark, frame, monkeypatch, integer, tmp_path):
    """Large frames whose partitions hold ranges of positions are summed without a shuffle; others by buckets, with the same result."""
    monkeypatch.setattr(positions, "SMALL", 10)
    df = frame.withColumn("v", F.when(F.col("pos") % 11 != 3, F.col("v")) if integer else F.col("v") / 3.0)
    want, total = [], 0 if integer else 0.0
    for _, v in df.orderBy("pos").select("pos", "v").collect():
        total = wrap(total + (v or 0)) if integer else total + v
        want.append(total)
    df.repartitionByRange(5, "pos").sortWithinPartitions(F.desc("pos")).write.parquet(str(tmp_path / "t"))
    backwards = spark.read.parquet(str(tmp_path / "t"))
    mixed = df.repartition(4, "w")
    for source, shuffled in ((df, False), (backwards, False), (mixed, True), (df.where("pos < 1000"), False)):
        out = positions.running_sum(source, F.col("v"), integer, "s", 1000, bucket=64)
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == shuffled
        assert [r[1] for r in out.orderBy("pos").collect()] == (want if integer else pytest.approx(want))
        assert shuffled or ("Sort [pos" in out._jdf.queryExecution().executedPlan().toString()) == (source is backwards)


def test_sums_of_ranges_are_one_plain_sum(spark):
    from ordinale.plans.session import Session

    def sums(source):
        return len(set(re.findall(r"sum\([^)]*#[^)]*", Session(spark).df(source)._jdf.queryExecution().optimizedPlan().toString())))

    assert sums("+/!1000") == 1 and sums("+/!5000000000") == 3  # there a plain one could overflow


@pytest.mark.parametrize("rows", [None, 1000])
def test_renumbered(frame, rows):
    got = positions.renumbered(frame.where("w = 3"), rows, bucket=64)
    assert [tuple(r) for r in got.orderBy("pos").select("pos", "w").collect()] == [(i, 3) for i in range(143)]


@pytest.mark.parametrize("rows", [None, 1000])
def test_numbered(frame, rows):
    got = positions.numbered(frame.drop("pos"), [F.col("v")], rows).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1000))
    assert [r.v for r in got] == sorted(r.v for r in got)


@pytest.mark.parametrize("rows", [None, 1000])
def test_previous(frame, rows):
    got = [tuple(r)[1:] for r in positions.previous(frame, F.col("v"), "v", "p", rows, bucket=64).orderBy("pos").collect()]
    v = [r[0] for r in got]
    assert [r[1] for r in got] == [None, *v[:-1]]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), max_size=30))
def test_differences_invert_scans(spark, values):
    from ordinale.kinds import Kind
    from ordinale.operators.adverbs import eachprior, scan
    from ordinale.operators.values import vector

    got = eachprior("-", scan("+", vector(spark, Kind.I64, values)))
    assert [r[1] for r in got.to_df().orderBy("pos").collect()] == [v or 0 for v in values]


def test_plans_have_no_join_and_no_python(spark, data):
    from ordinale.operators.elementwise import dyad
    from ordinale.sources import tables

    f = tables.frame(tables.read(spark, f"{data}/sf0.001/orders.parquet"), pos="o_orderkey")
    plan = dyad("+", f.vector("o_orderkey"), f.vector("o_custkey")).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
    assert "o_totalprice" not in plan


def test_calendar(spark):
    cases = [(2001, 1, 1, 0), (2000, 12, 31, -1), (1970, 1, 1, -11323), (2001, 12, 31, 364), (2020, 6, 14, 7104), (2024, 2, 29, 8459), (2024, 3, 1, 8460)]
    df = spark.createDataFrame(cases, "y int, m int, d int, n int")
    assert df.where(temporal.days_from_ymd(F.col("y"), F.col("m"), F.col("d")) != F.col("n")).count() == 0
    y, m, d = temporal.ymd_from_days(F.col("n"))
    assert df.where((y != F.col("y")) | (m != F.col("m")) | (d != F.col("d"))).count() == 0
    leap = {r[0]: r[1] for r in spark.createDataFrame([(v,) for v in (1900, 2000, 2001, 2004, 2100)], "y int").select("y", temporal.is_leap_year(F.col("y"))).collect()}
    assert leap == {1900: False, 2000: True, 2001: False, 2004: True, 2100: False}


def test_times(spark):
    one = spark.range(1)
    t = temporal.time_from_hms(F.lit(12), F.lit(34), F.lit(56), F.lit(789), "ms")
    assert one.select(t).first()[0] == 45296789
    assert tuple(one.select(*temporal.hms_from_time(t, "ms")).first()) == (12, 34, 56, 789)
    last = temporal.time_from_hms(F.lit(23), F.lit(59), F.lit(59), F.lit(999_999_999), "ns")
    assert tuple(one.select(*temporal.hms_from_time(last, "ns")).first()) == (23, 59, 59, 999_999_999)
    assert tuple(one.select(*temporal.hms_from_time(F.lit(-1).cast("bigint"), "s")).first()) == (-1, 59, 59, 0)
    assert one.select(temporal.datetime_from(F.lit(0), F.lit(43200), "s")).first()[0] == 43200
    assert one.select(temporal.datetime_from(F.lit(1), F.lit(0), "ms")).first()[0] == 86_400_000
    assert str(one.select(temporal.timestamp_from(F.lit(1), F.lit(1_500_000))).first()[0]) == "2001-01-02 00:00:01.500000"


def test_sources_and_sinks(spark, data, tmp_path):
    from ordinale.plans.session import Session
    from ordinale.sources import tables

    s = Session(spark)
    for kind in tables.FORMATS:
        tables.write(s.eval("1 2 3 * 2"), str(tmp_path / f"v.{kind}"), kind)
        schema = {"schema": "pos long, val long"} if kind == "csv" else {}
        df = tables.read(spark, str(tmp_path / f"v.{kind}")) if not schema else spark.read.schema(schema["schema"]).csv(str(tmp_path / "v.csv"))
        assert sorted(r["val"] for r in df.collect()) == [2, 4, 6]
    with pytest.raises(ValueError):
        tables.read(spark, "x.unknown")
    with pytest.raises(ValueError):
        tables.frame(spark.range(3))
    assert Frame(spark.range(3).withColumnRenamed("id", "pos")).size() == 3
