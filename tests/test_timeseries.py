"""Series small enough to work out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import aggregates as A
from tidemark.operators import timeseries as T
from tidemark.plans import tql

D = lambda h, m=0: dt.datetime(2018, 12, 1, h, m)
S = "date timestamp, value1 int, value2 double"
C1 = [(D(10), 1, 10.3), (D(10, 10), 3, 5.7), (D(10, 20), 2, 8.2), (D(10, 40), 4, 4.5)]
C2 = C1 + [(D(10, 45), 1, 6.3), (D(10, 50), 4, 18.9), (D(11), 3, 3.6)]


@pytest.fixture
def c1(spark):
    return spark.createDataFrame(C1, S)


@pytest.fixture
def c2(spark):
    return spark.createDataFrame(C2, S)


def rows(df, *keys):
    return [tuple(r) for r in df.orderBy(*(keys or df.columns[:1])).collect()]


def one(df, agg):
    return df.agg(agg).first()[0]


def test_aggregates(c1):
    assert one(c1, F.avg("value1")) == 2.5
    assert T.time_avg(c1, "date", "value1").first()[0] == pytest.approx(2.625)
    assert one(c1, A.variance0(F.col("value1"))) == pytest.approx(5 / 3)
    assert one(c1, A.stddev0(F.col("value1"))) == pytest.approx(1.290994, abs=1e-6)
    assert one(c1, A.median(F.col("value1"), "int")) == 2
    assert one(c1, A.percentile_cont(F.col("value2"), 0.5)) == pytest.approx(6.95)
    with pytest.raises(ValueError):
        A.percentile_cont(F.col("value2"), 1.5)


def test_aggregates_of_few_rows(spark, c1):
    single, none = c1.limit(1), c1.where("value1 > 9")
    assert one(single, A.variance0(F.col("value1"))) == 0.0
    assert one(single, F.var_samp("value1")) is None
    assert one(none, A.total(F.col("value1"))) == 0.0 and one(none, F.sum("value1")) is None
    assert T.time_avg(single, "date", "value1").first()[0] == 1.0
    assert T.time_avg(none, "date", "value1").count() == 0
    x = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    assert one(x, A.group_concat(F.col("x"))) == "ab" and one(x, A.group_concat(F.col("x"), "-")) == "a-b"


def test_neighbours(c1):
    at = lambda h, m: F.lit(D(h, m))
    assert T.time_next(c1, "date", at(10, 10)).first()["date"] == D(10, 10)
    assert T.time_next(c1, "date", at(10, 10), only=True).first()["date"] == D(10, 20)
    assert T.time_prev(c1, "date", at(10, 30)).first()["date"] == D(10, 20)
    assert T.time_prev(c1, "date", at(10, 20), only=True).first()["date"] == D(10, 10)
    assert T.time_next(c1, "date", at(11, 0)).count() == 0


def test_interpolation(c1):
    assert rows(T.interpolate(c1, "date", "value1", D(10, 30))) == [(D(10, 30), 3, 8.2)]
    assert rows(T.interpolate(c1, "date", "value1", D(10, 20))) == [(D(10, 20), 2, 8.2)]
    assert rows(T.interpolate(c1, "date", "value1", D(11))) == []
    assert rows(T.interpolate(c1, "date", "value1", D(9))) == []


def test_sampling(c2):
    got = rows(T.sample(c2, "date", D(10), D(11), 15, "MINUTE", ["value1"]))
    assert got == [(D(10), 1, 10.3), (D(10, 15), 2, 5.7), (D(10, 30), 3, 8.2), (D(10, 45), 1, 6.3), (D(11), 3, 3.6)]
    empty = rows(T.sample(c2, "date", D(10), D(10, 30), 15, "MINUTE", mode="empty"))
    assert empty == [(D(10), 1, 10.3), (D(10, 15), 0, 0.0), (D(10, 30), 0, 0.0)]
    with pytest.raises(ValueError):
        T.sample(c2, "date", D(10), D(11), 1, "MONTH")


def test_sampling_of_several_series(spark):
    data = [("a", D(10), 0.0), ("a", D(10, 10), 10.0), ("b", D(10, 5), 7.0)]
    df = spark.createDataFrame(data, "k string, date timestamp, v double")
    got = rows(T.sample(df, "date", D(10), D(10, 10), 5, "MINUTE", ["v"], ["k"]), "k", "date")
    assert got == [("a", D(10), 0.0), ("a", D(10, 5), 5.0), ("a", D(10, 10), 10.0), ("b", D(10, 5), 7.0)]


def test_range_group(c1):
    agg = {"v": F.round(F.avg("value2"), 6)}
    assert rows(T.range_group(c1, "date", 20, "MINUTE", agg)) == [(D(10), 8.0), (D(10, 20), 8.2), (D(10, 40), 4.5)]
    assert len(rows(T.range_group(c1, "date", 10, "MINUTE", agg))) == 4
    for fill, want in (("null", None), ("previous", 8.2), ("linear", 6.35)):
        got = dict(rows(T.range_group(c1, "date", 10, "MINUTE", agg, fill=fill)))
        assert len(got) == 5 and got[D(10, 30)] == (want if want is None else pytest.approx(want))
    ends = dict(rows(T.range_group(c1, "date", 10, "MINUTE", agg, fill="linear", begin=D(9, 50), end=D(10, 50))))
    assert ends[D(9, 50)] is None and ends[D(10, 50)] is None
    with pytest.raises(Exception, match="intervals"):
        T.range_group(c1, "date", 1, "MICROSECOND", agg, fill="null").count()
    with pytest.raises(ValueError):
        T.range_group(c1, "date", 0, "DAY", agg)
    assert T.range_group(c1.where("value1 > 9"), "date", 10, "MINUTE", agg, fill="linear").count() == 0


def test_linear_fill_truncates_integers_and_carries_text(spark):
    df = spark.createDataFrame([(D(10), 1, "a"), (D(10, 30), 3, "b")], "date timestamp, i int, s string")
    got = rows(T.range_group(df, "date", 10, "MINUTE", {"i": F.max("i"), "s": F.max("s")}, fill="linear"))
    assert got == [(D(10), 1, "a"), (D(10, 10), 1, "a"), (D(10, 20), 2, "a"), (D(10, 30), 3, "b")]


def test_window_agg_and_extremes(c1):
    got = rows(T.window_agg(c1, "date", "value1", "AVG", F.lit(D(10)), F.lit(D(10, 40)), 20, "MINUTE"))
    assert got == [(D(10), 2.0), (D(10, 20), 2.0), (D(10, 40), 4.0)]
    assert [r["date"] for r in T.extreme_rows(c1, "value2").collect()] == [D(10)]
    with pytest.raises(ValueError):
        T.window_agg(c1, "date", "value1", "SUM", F.lit(D(10)), F.lit(D(11)), 20, "MINUTE")


def test_asof(spark):
    left = spark.createDataFrame([("a", D(10, 5), 1), ("a", D(9), 2), ("b", D(11), 3)], "k string, date timestamp, id int")
    right = spark.createDataFrame([("a", D(10), 1.0), ("a", D(10, 5), 2.0), ("b", D(8), 3.0)], "k string, date timestamp, v double")
    assert sorted((r["id"], r["v"]) for r in T.asof_join(left, right, "date", ["k"], ["v"]).collect()) == [(1, 2.0), (2, None), (3, 3.0)]
    near = T.asof_join(left, right, "date", ["k"], ["v"], (1, "HOUR"))
    assert sorted((r["id"], r["v"]) for r in near.collect()) == [(1, 2.0), (2, None), (3, None)]


def test_global_time_average_equals_a_plain_window(spark):
    data = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), float(i * i % 11)) for i in range(60)]
    df = spark.createDataFrame(data, "t timestamp, v double")
    ts = [t.timestamp() for t, _ in data]
    w = [(ts[min(i + 1, 59)] - ts[max(i - 1, 0)]) / 2 for i in range(60)]
    want = sum(a * v for a, (_, v) in zip(w, data)) / sum(w)
    assert T.time_avg(df, "t", "v").first()[0] == pytest.approx(want)


def test_container_queries(spark, c2):
    q = lambda s: tql.tql(spark, s, c2, "date")
    assert q("SELECT TIME_NEXT(*, TIMESTAMP('2018-12-01T10:10:00'))").first()["value1"] == 3
    assert q("SELECT MAX_ROWS(value1)").count() == 2
    assert q("SELECT COUNT(*) WHERE value1 >= 3 XOR value2 > 5").first()[0] == 5
    assert q("SELECT TIME_SAMPLING(value1, TIMESTAMP('2018-12-01T10:00:00'), TIMESTAMP('2018-12-01T11:00:00'), 15, MINUTE)").count() == 5
    assert q("SELECT * ORDER BY value2 DESC LIMIT 1").first()["value2"] == 18.9
    assert q("SELECT TIME_INTERPOLATED(value1, TIMESTAMP('2018-12-01T10:30:00'))").first()["value1"] == 3
    with pytest.raises(ValueError):
        q("SELECT value1, value2")
