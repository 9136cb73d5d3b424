import datetime as dt
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import dml, pattern, relational
from tidemark.plans import sql as dialect
from tidemark.plans.database import Database
from tidemark.sources import catalog
from tidemark.streaming import windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- row patterns -------------------------------------------------------------------------------


def days(spark, values):
    return spark.createDataFrame([("d", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)], "dev string, ts timestamp, v int")


def up_down():
    p = pattern.prev("v", ["dev"], ["ts"])
    return {"UP": F.col("v") > p, "DOWN": F.col("v") < p}


def test_up_down(spark):
    got = pattern.match_rows(days(spark, [10, 12, 15, 13, 11]), ["dev"], ["ts"], "UP+ DOWN+", up_down()).orderBy("ts").collect()
    assert [(r["v"], r["match_number"], r["classifier"]) for r in got] == [(12, 1, "UP"), (15, 1, "UP"), (13, 1, "DOWN"), (11, 1, "DOWN")]
    m = {"first_up": pattern.first("v", ["ts"], "UP"), "low": pattern.last("v", ["ts"], "DOWN"), "n": F.count("*")}
    assert rows(pattern.match_recognize(days(spark, [10, 12, 15, 13, 11]), ["dev"], ["ts"], "UP+ DOWN+", up_down(), m)) == [("d", 1, 12, 11, 4)]


def test_no_partition_and_no_rows(spark):
    df = days(spark, [1, 2, 3])
    got = pattern.match_rows(df, [], ["ts"], "^A{2}", {"A": F.col("v") > 0})
    assert [r["v"] for r in got.orderBy("ts").collect()] == [1, 2]
    assert pattern.match_rows(df.where("v > 9"), ["dev"], ["ts"], "A", {"A": F.col("v") > 0}).count() == 0


@pytest.mark.parametrize("bad", ["A (", "A )", "A {2,1}", "*", "A &", "A | * B"])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        pattern.compile_pattern(bad)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=30), st.sampled_from(["A+ B*", "A (B|C)+ A?", "(A|A B) C", "A{2,3} B", "A{,2} C", "(A B?){2,} C", "B+ $", "^ A+", "A* B"]))
def test_automaton_like_regex(text, p):
    program = pattern.compile_pattern(p)
    regex = re.sub(r"\s+", "", p).replace("A", "a").replace("B", "b").replace("C", "c").replace("{,", "{0,")
    masks = [sum(1 << i for i, v in enumerate(program.variables) if v.lower() == c) for c in text]
    want, at = [], 0
    while at < len(text):
        m = re.compile(regex).match(text, at) if not regex.startswith("^") or at == 0 else None
        if m and m.end() > at:
            want.append((at, m[0].upper()))
            at = m.end()
        else:
            at += 1
    assert [(b, "".join(program.variables[v] for v in path)) for b, path in pattern.match_masks(program, masks)] == want


def test_variables_that_overlap():
    program = pattern.compile_pattern("A+ B")
    assert pattern.match_masks(program, [1, 3, 3, 1]) == [(0, [0, 0, 1])]


def test_a_failing_run_is_looked_at_once():
    program = pattern.compile_pattern("A+ B")
    began = time.time()
    assert pattern.match_masks(program, [1] * 100_000) == []
    assert pattern.match_masks(program, [1] * 100_000 + [2]) == [(0, [0] * 100_000 + [1])]
    assert time.time() - began < 10


def test_open_matches_are_bounded(monkeypatch):
    monkeypatch.setattr(pattern, "MOST_OPEN", 100)
    with pytest.raises(MemoryError):
        pattern.match_masks(pattern.compile_pattern("A+ B"), [1] * 1000)


def test_islands(spark):
    got = pattern.islands(days(spark, [10, 12, 15, 13, 11, 12, 9]), ["dev"], ["ts"], up_down(), ["UP", "DOWN"])
    assert [(r["match_number"], r["length"], r["first_ts"].day, r["last_ts"].day) for r in got.orderBy("match_number").collect()] == [(1, 4, 2, 5), (2, 2, 6, 7)]


@pytest.mark.parametrize("buffered", [0, 10**6])
def test_percentiles(spark, monkeypatch, buffered):
    rng = random.Random(3)
    monkeypatch.setattr(relational, "BUFFERED", buffered)
    monkeypatch.setattr(relational, "CELLS", 7)
    data = [(g, v) for g in ("a", "b", None) for v in [rng.choice([1.0, 2.0, 2.5, rng.uniform(-9, 9)]) for _ in range(200 if g else 3)]] + [("one", 4.0), ("same", 1.0), ("same", 1.0), ("none", None), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    rates = {"p0": 0.0, "p25": 0.25, "med": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["g"]: [r[k] for k in rates] for r in relational.percentiles(df, ["g"], "v", rates).collect()}
    for g in {g for g, v in data if v is not None}:
        own = sorted(v for x, v in data if x == g and v is not None)
        for (name, rate), value in zip(rates.items(), got[g]):
            at = rate * (len(own) - 1)
            low, high = own[int(at)], own[min(len(own) - 1, -int(-at // 1))]
            assert abs(value - (low + (high - low) * (at - int(at)))) < 1e-9, (g, name)
    assert "none" not in got
    assert relational.percentiles(df, [], "v", {"m": 0.5}).count() == 1
    assert relational.largest_group(df, ["g"]) == 201 and relational.largest_group(df.where("false"), ["g"]) == 0
    with pytest.raises(ValueError):
        relational.percentiles(df, [], "v", {"m": 1.5})


# --- changes, joins, order ----------------------------------------------------------------------


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(3, "x"), (3, "y"), (4, "z")], "k int, v string")
    assert rows(dml.upsert(t, new, ["k"], F.col("v")).where("v is not null")) == [(1, "a"), (3, "y"), (4, "z")]
    assert rows(dml.insert_or_ignore(t, new, ["k"], F.col("v")).where("v is not null")) == [(1, "a"), (3, "c"), (4, "z")]
    assert dml.insert(t, new).count() == 6
    assert sorted(r["k"] for r in dml.delete(t, F.col("v") == "a").collect()) == [2, 3]
    assert rows(dml.update(t, F.col("v") == "a", {"k": F.col("k") + 10, "v": F.lit("n")}).where("v = 'n'")) == [(11, "n")]


def test_natural_join_spreads_the_pairs_of_few_keys(spark, monkeypatch):
    monkeypatch.setattr(relational, "PAIRS", 2000, raising=False)
    monkeypatch.setattr(relational, "SIDE", 32, raising=False)
    a = spark.createDataFrame([(i % 2 if i % 50 else None, f"a{i % 7}") for i in range(400)] + [(7, "once")], "k int, x string")
    b = spark.createDataFrame([(i % 2 if i % 50 else None, None if i % 3 else "b") for i in range(300)] + [(7, "once"), (8, "alone")], "k long, y string").coalesce(1)
    for left, right, want in ((a, b, a.join(b, ["k"])), (a.drop("k"), b.drop("k"), a.drop("k").crossJoin(b.drop("k")))):
        got = relational.natural_join(left, right)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        rows = sorted(got.collect(), key=str)
        assert rows == sorted(want.collect(), key=str)
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < len(rows) / 4  # one task made all of them
    none = relational.natural_join(a.where("k < 0"), b)
    assert none.count() == 0 and none.columns == ["k", "x", "y"]


def test_range_and_salted_joins_equal_plain_ones(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.uniform(-50, 50)) for i in range(200)], "i int, x double")
    ranges = spark.createDataFrame([(j, a, a + rng.uniform(-1, 20)) for j in range(50) for a in [rng.uniform(-50, 50)]], "j int, lo double, hi double")
    want = rows(points.crossJoin(ranges).where("x >= lo and x < hi").select("i", "j"))
    for width in (0.7, 5, 100):
        assert rows(relational.range_join(points, ranges, "x", "lo", "hi", width).select("i", "j")) == want
    a = spark.createDataFrame([(i, i % 3) for i in range(60)], "i int, k int")
    b = spark.createDataFrame([(0, "x"), (1, "y")], "k int, s string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = relational.salted_join(a, b, ["k"], 4, how), a.join(b, ["k"], how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        relational.salted_join(a, b, ["k"], 4, "full")


def test_null_is_the_largest(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "i int, v int")
    assert [r["i"] for r in relational.order(df, "v").collect()] == [2, 3, 1]
    assert [r["i"] for r in relational.order(df, ("v", "desc")).collect()] == [1, 3, 2]
    assert [r["i"] for r in relational.topk_per_group(df.withColumn("g", F.lit(0)), ["g"], [F.col("i")], 1, 1).collect()] == [2]


def test_scalar_subquery_of_two_rows_raises(spark):
    spark.range(2).createOrReplaceTempView("two")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        spark.sql("SELECT (SELECT id FROM two)").collect()


# --- sources, dialect, streams ------------------------------------------------------------------


def test_partitioned_table(spark, tmp_path):
    data = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(100)]
    df = spark.createDataFrame(data, "i int, t timestamp")
    path = str(tmp_path / "t")
    catalog.write_partitioned(df, path, "t", hash_by="i", parts=3)
    got = catalog.read_partitioned(spark, path, "t", "2024-01-02 03:00:00", "2024-01-02 06:00:00")
    assert sorted(r["i"] for r in got.collect()) == [27, 28, 29, 30] and got.columns == ["i", "t"]
    assert "PartitionFilters: [isnotnull(_interval" in got._jdf.queryExecution().toString()
    assert rows(catalog.tables_of({"a": df})) == [("a", 2)] and catalog.indexes_of({"a": df}).count() == 0


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,u\n2,v\n")
    assert rows(catalog.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string")) == [(1, "u"), (2, "v")]


def test_dialect(spark):
    days(spark, [10, 12, 15, 13, 11]).createOrReplaceTempView("s")
    q = lambda s: dialect.sql(spark, s)
    assert rows(q("SELECT ts AS t, max(v) AS hi FROM s GROUP BY RANGE(ts) EVERY(2, DAY)")) == [(dt.datetime(2023, 12, 31), 10), (dt.datetime(2024, 1, 2), 15), (dt.datetime(2024, 1, 4), 13)]
    assert q("SELECT ts, v2 FROM (SELECT ts, v AS v2 FROM s WHERE v <> 15) d GROUP BY RANGE(ts) EVERY(1, DAY) FILL(LINEAR)".replace("v2 FROM (", "max(v2) AS v2 FROM (")).count() == 5
    assert [r[0] for r in q("SELECT sum(v) OVER (ORDER BY ts) ROWS BETWEEN 1 PRECEDING AND CURRENT ROW AS m FROM s ORDER BY ts").collect()] == [10, 22, 27, 28, 24]
    assert [r[0] for r in q("SELECT count(*) OVER (ORDER BY ts) RANGE (1, DAY) PRECEDING AS m FROM s ORDER BY ts").collect()] == [1, 2, 2, 2, 2]
    assert q("SELECT 1 AS x FROM s WHERE dev GLOB 'd*' AND v NOTNULL AND v IS 15 AND v IS NOT 3").count() == 1
    assert q("SELECT EXTRACT(DAY_OF_WEEK, ts) AS d, TIMESTAMP_DIFF(DAY, TIMESTAMP_ADD(DAY, ts, 3), ts) AS n FROM s LIMIT 1").first().asDict() == {"d": 1, "n": 3}


def test_streams(spark, tmp_path):
    data = [(dt.datetime(2024, 1, 1, 0, m), m % 2) for m in range(0, 60, 5)] + [(dt.datetime(2024, 1, 1, 9), 0)]
    spark.createDataFrame(data, "t timestamp, k int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k int").parquet(str(tmp_path / "in"))
    out = {}

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
        out[name] = spark.table(name).collect()

    run(windows.tumbling(stream, "t", "30 minutes", {"n": F.count("*")}, ["k"]), "tumbled")
    run(windows.sessions(stream, "t", "20 minutes", {"n": F.count("*")}, ["k"]), "sessions")
    run(windows.distinct_within(stream, "t", ["k"]), "once")
    assert sorted((r["k"], r["t"].minute, r["n"]) for r in out["tumbled"]) == [(0, 0, 3), (0, 30, 3), (1, 0, 3), (1, 30, 3)]
    assert sorted((r["k"], r["n"]) for r in out["sessions"]) == [(0, 6), (1, 6)]
    assert {r["k"] for r in out["once"]} == {0, 1}
    seen = []
    q = windows.upsert_sink(windows.sliding(stream, "t", "20 minutes", "10 minutes", {"n": F.count("*")}), lambda b, i: seen.append(b.count()), str(tmp_path / "sink"))
    q.awaitTermination(60)
    assert sum(seen) > 0


# --- statements as text -------------------------------------------------------------------------


def test_statements(spark):
    db = Database(spark)
    db.run("CREATE TABLE t (k INTEGER PRIMARY KEY, v STRING, n LONG)")
    db.run("CREATE TABLE IF NOT EXISTS t (k INTEGER)")
    db.run("INSERT INTO t VALUES (1, 'a', 10), (2, 'it''s, (b)', 20)")
    db.run("INSERT INTO t (k, v) VALUES (3, 'c')")
    db.run("REPLACE INTO t VALUES (2, 'B', 21)")
    db.run("INSERT OR IGNORE INTO t VALUES (1, 'z', 0), (4, 'd', 40)")
    assert rows(db.run("SELECT * FROM t")) == [(1, "a", 10), (2, "B", 21), (3, "c", None), (4, "d", 40)]
    db.run("UPDATE t SET n = n + 1, v = concat(v, ',x') WHERE n > :low", low=15)
    db.run("DELETE FROM t WHERE n IS NULL")
    assert rows(db.run("SELECT * FROM t;")) == [(1, "a", 10), (2, "B,x", 22), (4, "d,x", 41)]
    for bad in ("CREATE TABLE t (k INTEGER)", "UPDATE t SET k = 1", "UPDATE t SET nothing = 1", "INSERT INTO t VALUES (1)", "DELETE FROM nothing", "DROP TABLE nothing", "ALTER TABLE t DROP PARTITION FOR (1)", "CREATE TABLE u (k NOTYPE)", "ALTER TABLE t ADD v STRING"):
        with pytest.raises(ValueError):
            db.run(bad)
    db.run("DROP TABLE IF EXISTS nothing")
    db.run("DROP TABLE t")
    assert db.meta("container").count() == 0 and db.meta("column").count() == 0
    with pytest.raises(ValueError):
        db.meta("nothing")


def test_multi_put(spark):
    a, b = (spark.createDataFrame([(1, n), (2, n)], "k int, v string") for n in "ab")
    got = dml.multi_put({"a": a, "b": b}, {"a": spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")}, {"a": ["k"]})
    assert rows(got["a"]) == [(1, "a"), (2, "x"), (3, "y")] and rows(got["b"]) == [(1, "b"), (2, "b")]
    with pytest.raises(ValueError):
        dml.multi_put({"a": a}, {"c": a}, {"c": ["k"]})


@pytest.mark.parametrize(
    "where, n",
    [
        ("k BETWEEN TIMESTAMP('2023-01-01T00:00:00Z') AND TIMESTAMP('2023-01-01T00:01:00Z')", 7),
        ("k >= TIMESTAMP '2023-01-01 00:00:00' AND k < TIMESTAMP '2023-01-01 00:01:00'", 6),
        ("(v > 0 AND (TIMESTAMP '2023-01-01 00:00:00' < k)) AND k <= TIMESTAMP '2023-01-01 00:00:55'", 6),
        ("v BETWEEN 0 AND 9 AND k >= TIMESTAMP '2023-01-01 00:00:10'", 4),
        ("v > 0", 3),
    ],
)
def test_fill_takes_its_bounds_from_the_condition(spark, where, n):
    spark.sql("SELECT TIMESTAMP '2023-01-01 00:00:20' AS k, 1.0D AS v UNION ALL SELECT TIMESTAMP '2023-01-01 00:00:40', 3.0D").createOrReplaceTempView("table1")
    got = dialect.sql(spark, f"SELECT k, avg(v) AS v FROM table1 WHERE {where} GROUP BY RANGE (k) EVERY (10, SECOND) FILL (NULL)")
    assert got.count() == n and got.where("v is not null").count() == 2
    every = dialect.sql(spark, f"SELECT * FROM table1 WHERE {where} GROUP BY RANGE (k) EVERY (10, SECOND) FILL (LINEAR)").orderBy("k").collect()
    assert [r["v"] for r in every if r["k"].second in (20, 30, 40)] == [1.0, 2.0, 3.0] and len(every) == n


def test_days_of_a_zone_with_summer_time(spark):
    spark.sql("SELECT explode(sequence(TIMESTAMP '2024-03-29 00:00:00', TIMESTAMP '2024-04-02 00:00:00', INTERVAL 1 HOUR)) AS k").createOrReplaceTempView("hours")
    got = dialect.sql(spark, "SELECT k, count(*) AS n FROM hours GROUP BY RANGE (k) EVERY (1, DAY, 'Europe/Berlin') ORDER BY k").collect()
    assert [r["n"] for r in got] == [23, 24, 23, 24, 3]


def test_patterns_as_text_are_checked(spark):
    days(spark, [1, 2, 3]).createOrReplaceTempView("points")
    body = "ORDER BY ts {skip} PATTERN (UP+) DEFINE UP AS {cond}"
    q = lambda **k: f"SELECT * FROM points MATCH_RECOGNIZE ({body.format(**({'skip': '', 'cond': 'v > PREV(v)'} | k))})"
    assert dialect.sql(spark, q()).count() == 1
    for bad in (q(skip="AFTER MATCH SKIP TO UP"), "SELECT * FROM points MATCH_RECOGNIZE (PATTERN (A) DEFINE A AS true)"):
        with pytest.raises(ValueError):
            dialect.sql(spark, bad)
