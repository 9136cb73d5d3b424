import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import gis as G
from tidemark.functions import scalar as S


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def T():
    return F.lit("2020-03-01 05:06:07.123456").cast("timestamp")


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: S.round_half_away(F.lit(-2.5)), -3.0),
        (lambda: S.round_half_away(F.lit(2.567), -2), 3.0),
        (lambda: S.int_div(F.lit(5), F.lit(2)), 2),
        (lambda: S.trunc(F.lit(-1.7)), -1.0),
        (lambda: S.trunc(F.lit(1234.5), -2), 1200.0),
        (lambda: S.trunc_int(F.lit(-1234), -2), -1200),
        (lambda: S.shift_left(F.lit(1), F.lit(-1)), 0),
        (lambda: S.shift_left(F.lit(1), F.lit(64)), 0),
        (lambda: S.shift_right(F.lit(-8), F.lit(70)), -1),
        (lambda: S.shift_right(F.lit(-8), F.lit(-2)), -32),
        (lambda: S.hex_to_dec(F.lit(" 7F ")), 127),
        (lambda: S.log(F.lit(2), F.lit(8)), pytest.approx(3.0)),
        (lambda: S.greatest_strict(F.lit(1), F.lit(None).cast("int")), None),
        (lambda: S.least_strict(F.lit(1), F.lit(2)), 1),
        (lambda: S.typeof(F.lit(1.5)), "DOUBLE"),
        (lambda: S.typeof(F.lit(None).cast("int")), "NULL"),
        (lambda: S.char(F.lit(65), F.lit(233), F.lit(0), F.lit(66)), "Aé"),
        (lambda: S.char(F.lit(0x1F600)), "😀"),
        (lambda: S.glob("a*[0-9]?", F.lit("abc7x")), True),
        (lambda: S.glob("[^a]b", F.lit("ab")), False),
        (lambda: S.glob("A*", F.lit("abc")), False),
        (lambda: S.hex_(F.lit(None).cast("string")), ""),
        (lambda: S.instr(F.lit("abcabcabc"), "bc", 1, 2), 5),
        (lambda: S.instr(F.lit("abcabc"), "bc", 3), 5),
        (lambda: S.instr(F.lit("abcabc"), "bc", 1, 3), 0),
        (lambda: S.quote(F.lit("it's")), "'it''s'"),
        (lambda: S.quote(F.lit(None).cast("string")), "NULL"),
        (lambda: S.printf("%03d|%s|%.1f|%x|%%|%q", 7, F.lit("a"), F.lit(2.25), 255, F.lit("o'k")), "007|a|2.3|ff|%|o''k"),
        (lambda: S.replace(F.lit("aXa"), "", "z"), "aXa"),
        (lambda: S.substr(F.lit("hello"), 0, 3), "he"),
        (lambda: S.substr(F.lit("hello"), -3, 2), "ll"),
        (lambda: S.trim(F.lit("xyaxy"), "xy"), "a"),
        (lambda: S.unicode_(F.lit("é")), 233),
        (lambda: S.unicode_(F.lit("")), None),
        (lambda: F.length(S.zeroblob(F.lit(3))), 3),
        (lambda: F.length(S.randomblob(F.lit(0))), 1),
        (lambda: S.extract("DAY_OF_WEEK", F.lit("2020-01-05").cast("timestamp")), 0),
        (lambda: S.extract("MILLISECOND", T()), 123),
        (lambda: S.extract("NANOSECOND", T()), 123456000),
        (lambda: S.timestamp_diff("MONTH", F.lit("2020-03-01").cast("timestamp"), F.lit("2020-01-31").cast("timestamp")), 1),
        (lambda: S.timestamp_diff("HOUR", F.lit("2020-03-01").cast("timestamp"), F.lit("2020-03-01 01:30:00").cast("timestamp")), -1),
        (lambda: S.timestamp_add("MONTH", F.lit("2020-01-31").cast("timestamp"), 1), dt.datetime(2020, 2, 29)),
        (lambda: S.timestamp_add("MILLISECOND", F.lit("2020-01-31").cast("timestamp"), -1), dt.datetime(2020, 1, 30, 23, 59, 59, 999000)),
        (lambda: S.timestamp_trunc("DAY", T()), dt.datetime(2020, 3, 1)),
        (lambda: S.strftime("%Y-%j %3f %w%%", T()), "2020-061 123 0%"),
        (lambda: S.to_epoch_ms(S.to_timestamp_ms(F.lit(1234))), 1234),
        (lambda: S.epoch_nanos(F.lit("1970-01-01 00:00:01").cast("timestamp"), F.lit(5)), 1_000_000_005),
        (lambda: S.element(F.lit(0), F.array(F.lit(7), F.lit(8))), 7),
        (lambda: S.make_timestamp(2020, 1, 2, 3, 4, 5.25), dt.datetime(2020, 1, 2, 3, 4, 5, 250000)),
    ],
)
def test_scalar(spark, made, want):
    assert value(spark, made()) == want


@pytest.mark.parametrize("made", [lambda: S.sqrt(F.lit(-1)), lambda: S.log(F.lit(1), F.lit(2)), lambda: S.hex_to_dec(F.lit("zz")), lambda: S.hex_to_dec(F.lit("FFFFFFFFFFFFFFFF")), lambda: S.int_div(F.lit(1), F.lit(0)), lambda: F.abs(F.lit(-(2**63)))])
def test_errors(spark, made):
    with pytest.raises(Exception):
        value(spark, made())


def test_unknown_format_and_unit(spark):
    for f in (lambda: S.strftime("%Q", T()), lambda: S.micros(1, "MONTH"), lambda: S.timestamp_add("DAY_OF_WEEK", T(), 1)):
        with pytest.raises(ValueError):
            f()


def test_boxes(spark):
    b = lambda s: G.box(F.lit(s))
    assert tuple(value(spark, b("POLYGON((0 0, 4 -1.5, 2e1 3))"))) == (0.0, -1.5, None, 20.0, 3.0, None)
    assert tuple(value(spark, b("POINT(1 2 3);4326"))) == (1.0, 2.0, 3.0, 1.0, 2.0, 3.0)
    assert value(spark, b("POINT EMPTY")) is None
    assert value(spark, G.srid(F.lit("POINT(1 2);4326"))) == 4326 and value(spark, G.srid(F.lit("POINT(1 2)"))) == -1
    assert value(spark, G.intersects(b("POINT(1 1)"), G.make_rect(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))) is True
    assert value(spark, G.intersects(b("POINT(1.1 1)"), G.make_rect(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))) is False
    assert value(spark, G.intersects(b("POINT(1 1 9)"), b("POINT(1 1 8)"))) is False
    ball = G.sphere(0, 0, 0, 1)
    assert value(spark, G.quadratic_intersects(ball, b("LINESTRING(0 0 0, 2 2 2)"))) is True
    assert value(spark, G.quadratic_intersects(ball, b("LINESTRING(3 3 3, 4 4 4)"))) is False
    assert value(spark, G.quadratic_intersects(G.plane(0, 0, 1, -5), b("LINESTRING(0 0 4, 1 1 6)"))) is True


def test_a_filter_works_a_box_out_once(spark):
    texts = spark.createDataFrame([("LINESTRING(0 0 4, 1 1 6)",), ("POINT(9 9 5)",), ("POINT(9 9)",), ("POINT EMPTY",), (None,)], "g string")
    box = G.box(F.col("g"))
    for holds, want in (
        (G.quadratic_intersects(G.plane(0, 0, 1, -5), box), [True, True, False, None, None]),
        (G.quadratic_intersects(G.sphere(9, 9, 5, 0), box), [False, True, False, None, None]),
        (G.intersects(box, G.make_rect(F.lit(0), F.lit(0), F.lit(2), F.lit(2))), [True, False, False, None, None]),
    ):
        assert [r[0] for r in texts.coalesce(1).select(holds).collect()] == want
        plan = texts.where(holds)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
