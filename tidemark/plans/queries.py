"""The library's registered queries, each with the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import gis as G
from ..functions import scalar as S
from ..operators import dml, pattern, relational, timeseries
from ..session import load, ship, work_dir
from ..sources import catalog
from ..streaming import windows
from . import sql as dialect
from . import tql as container
from .database import Database

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Register f(tables) under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return _plain(f(Tables(spark, sf_dir)))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as in the tables."""
    return df.select(*[F.col(n).cast("timestamp_ntz").alias(n) if k == "timestamp" else F.col(n) for n, k in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


col, lit = F.col, F.lit


def r2(x):
    return F.round(x, 2)


def r4(x):
    return F.round(x, 4)


# --- scans, projections, predicates -----------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-07-01' AND l_quantity > 45")
def scan_filter_project(t):
    return t.lineitem.where((col("l_shipdate") >= "1995-01-01") & (col("l_shipdate") < "1995-07-01") & (col("l_quantity") > 45)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9, 15) AND p_retailprice BETWEEN 900 AND 1500 AND p_type LIKE '%E%' AND p_name NOT LIKE 'z%'")
def in_list_between_like(t):
    return t.part.where(col("p_size").isin(1, 5, 9, 15) & col("p_retailprice").between(900, 1500) & col("p_type").like("%E%") & ~col("p_name").like("z%")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size_class, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS status_code FROM orders")
def case_when(t):
    size = F.when(col("o_totalprice") > 300000, "big").when(col("o_totalprice") > 100000, "middle").otherwise("small")
    code = F.when(col("o_orderstatus") == "F", 1).when(col("o_orderstatus") == "O", 2)
    return t.orders.select("o_orderkey", size.alias("size_class"), code.alias("status_code"))


@query("SELECT event_id, nullif(event_type, 'view') IS NOT DISTINCT FROM CASE WHEN value < 50 THEN 'click' END AS same, nullif(event_type, 'view') IS NULL AS is_null FROM events")
def null_safe_eq(t):
    e = F.nullif(col("event_type"), lit("view"))
    return t.events.select("event_id", e.eqNullSafe(F.when(col("value") < 50, "click")).alias("same"), e.isNull().alias("is_null"))


@query("SELECT event_id, (user_id & 7)::BIGINT AS a, (user_id | 8)::BIGINT AS o, (~user_id)::BIGINT AS n, (user_id << 3)::BIGINT AS l, (user_id >> 2)::BIGINT AS r, (user_id >> 3)::BIGINT AS neg, 0::BIGINT AS far FROM events")
def bit_ops(t):
    u = col("user_id")
    return t.events.select("event_id", u.bitwiseAND(7).alias("a"), u.bitwiseOR(8).alias("o"), F.bitwise_not(u).alias("n"), S.shift_left(u, 3).alias("l"), S.shift_right(u, 2).alias("r"), S.shift_left(u, -3).alias("neg"), S.shift_left(u, 64).alias("far"))


@query("SELECT event_id FROM events WHERE (value > 50) <> (event_type = 'click')")
def xor_filter(t):
    return t.events.where(S.xor(col("value") > 50, col("event_type") == "click")).select("event_id")


@query("SELECT p_partkey, p_partkey // 7 AS q, p_partkey % 7 AS m, -p_size AS neg, round(p_retailprice * 1.1 + p_size, 2) AS x FROM part")
def arithmetic(t):
    return t.part.select("p_partkey", S.int_div(col("p_partkey"), lit(7)).alias("q"), (col("p_partkey") % 7).alias("m"), (-col("p_size")).alias("neg"), r2(col("p_retailprice") * 1.1 + col("p_size")).alias("x"))


@query("SELECT DISTINCT event_type, user_id % 10 AS u FROM events")
def distinct(t):
    return t.events.select("event_type", (col("user_id") % 10).alias("u")).distinct()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderpriority = '1-URGENT'")
def prepared_parameters(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderpriority = ?", args=[250000, "1-URGENT"])


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(id, name)")
def values_clause(t):
    return t.spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")


@query("SELECT 1 AS one, 'x' || '1' AS s")
def select_without_from(t):
    return t.spark.sql("SELECT 1 AS one, 'x' || 1 AS s")


@query("SELECT u, n FROM (SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id) d WHERE n > 60")
def derived_table(t):
    return t.events.groupBy(col("user_id").alias("u")).agg(F.count("*").alias("n")).where("n > 60")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 80 GROUP BY event_type")
def view_expand(t):
    t.events.where("value > 80").createOrReplaceTempView("high_events")
    return t.spark.table("high_events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts, value FROM events WHERE event_id = 77")
def point_get(t):
    return t.events.where("event_id = 77").select("event_id", "ts", "value")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' ORDER BY ts")
def key_range_query(t):
    return t.events.where(col("ts").between("2024-01-05", "2024-01-06")).select("event_id", "ts").orderBy("ts")


@query("SELECT 'customer' AS container, c_custkey AS k, c_name AS name FROM customer WHERE c_custkey IN (3, 5) UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_suppkey IN (3, 5)")
def multi_get(t):
    tables = {"customer": t.customer.select(col("c_custkey").alias("k"), col("c_name").alias("name")), "supplier": t.supplier.select(col("s_suppkey").alias("k"), col("s_name").alias("name"))}
    return dml.multi_get(tables, "k", [3, 5]).select("container", "k", "name")


# --- joins ------------------------------------------------------------------------------------


@query("SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name")
def join_inner_star(t):
    first = t.region.agg(F.min("r_name").alias("r_name"))
    nations = t.nation.join(t.region, col("n_regionkey") == col("r_regionkey")).join(first, "r_name", "left_semi").select("n_nationkey", "n_name")
    customers = t.customer.join(nations, col("c_nationkey") == col("n_nationkey")).select("c_custkey", "n_name")
    orders = t.orders.join(customers, col("o_custkey") == col("c_custkey")).select("o_orderkey", "n_name")
    lines = t.lineitem.join(orders, col("l_orderkey") == col("o_orderkey"))
    return lines.groupBy("n_name").agg(F.count("*").alias("n"), r2(F.sum(col("l_extendedprice") * (1 - col("l_discount")))).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def join_left(t):
    return t.customer.join(t.orders, (col("c_custkey") == col("o_custkey")) & (col("o_totalprice") > 200000), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT s_name, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def join_right(t):
    return t.supplier.join(t.nation, (col("s_nationkey") == col("n_nationkey")) & (col("s_acctbal") > 5000), "right").select("s_name", "n_name")


@query("SELECT a.k AS ka, b.k AS kb FROM (SELECT p_partkey AS k FROM part WHERE p_size < 10) a FULL JOIN (SELECT s_suppkey AS k FROM supplier) b ON a.k = b.k")
def join_full(t):
    a, b = t.part.where("p_size < 10").select(col("p_partkey").alias("ka")), t.supplier.select(col("s_suppkey").alias("kb"))
    return a.join(b, col("ka") == col("kb"), "full")


@query("SELECT c_nationkey, c_name, s_name FROM (SELECT c_nationkey AS nk, c_nationkey, c_name FROM customer WHERE c_acctbal > 9000) NATURAL JOIN (SELECT s_nationkey AS nk, s_name FROM supplier)")
def join_natural(t):
    c = t.customer.where("c_acctbal > 9000").select(col("c_nationkey").alias("nk"), "c_nationkey", "c_name")
    return relational.natural_join(c, t.supplier.select(col("s_nationkey").alias("nk"), "s_name")).select("c_nationkey", "c_name", "s_name")


@query("SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) JOIN (SELECT n_regionkey AS k, n_name FROM nation) USING (k)")
def join_using(t):
    return t.region.select(col("r_regionkey").alias("k"), "r_name").join(t.nation.select(col("n_regionkey").alias("k"), "n_name"), ["k"])


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross_small(t):
    return t.region.select(col("r_name").alias("a")).crossJoin(t.region.select(col("r_name").alias("b")))


@query("SELECT band, count(*) AS n FROM orders JOIN (VALUES (0, 50000, 'a'), (50000, 150000, 'b'), (150000, 400000, 'c')) v(lo, hi, band) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band")
def join_range(t):
    bands = t.spark.createDataFrame([(0, 50000, "a"), (50000, 150000, "b"), (150000, 400000, "c")], "lo int, hi int, band string")
    return relational.range_join(t.orders, bands, "o_totalprice", "lo", "hi", 50000).groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT event_type, n_name, count(*) AS n FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY event_type, n_name")
def join_skewed_salted(t):
    e = t.events.select("event_id", "event_type", (col("user_id") % 25).cast("int").alias("n_nationkey"))
    return relational.salted_join(e, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"]).groupBy("event_type", "n_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def exists_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 350000"), col("c_custkey") == col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_anti(t):
    return t.customer.join(t.orders, col("c_custkey") == col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500)")
def in_subquery(t):
    return t.orders.join(t.customer.where("c_acctbal > 9500"), col("o_custkey") == col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_nationkey <> 3)")
def not_in_subquery(t):
    t.part.createOrReplaceTempView("part")
    t.supplier.createOrReplaceTempView("supplier")
    return t.spark.sql("SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_nationkey <> 3)")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(t):
    mean = t.orders.agg(F.avg("o_totalprice").alias("m"))
    return t.orders.join(F.broadcast(mean), col("o_totalprice") > 1.5 * col("m")).select("o_orderkey", "o_totalprice")  # one row is broadcast


# --- aggregates -------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(t):
    got = t.lineitem.where(col("l_shipdate") <= "1998-09-02").groupBy("l_returnflag", "l_linestatus")
    return got.agg(r2(F.sum("l_quantity")).alias("sum_qty"), r2(F.sum("l_extendedprice")).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(nullif(user_id % 3, 0)) AS n3, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def agg_basic(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.nullif(col("user_id") % 3, lit(0))).alias("n3"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), r2(F.sum("value")).alias("total"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), r2(F.sum("o_totalprice")).alias("total")).where("n > 12")


@query("SELECT event_type, count(DISTINCT user_id) AS users, sum(DISTINCT user_id)::BIGINT AS sum_users, round(avg(DISTINCT user_id), 6) AS avg_users, round(var_samp(DISTINCT user_id), 4) AS var_users FROM events GROUP BY event_type")
def agg_distinct(t):
    ids = t.events.select("event_type", "user_id").distinct()
    return ids.groupBy("event_type").agg(F.count("*").alias("users"), F.sum("user_id").alias("sum_users"), F.round(F.avg("user_id"), 6).alias("avg_users"), r4(F.var_samp("user_id")).alias("var_users"))


@query("SELECT event_type, round(stddev_pop(value), 4) AS sp, round(stddev_samp(value), 4) AS ss, round(var_pop(value), 4) AS vp, round(var_samp(value), 4) AS vs FROM events GROUP BY event_type")
def agg_stats(t):
    v = "value"
    return t.events.groupBy("event_type").agg(r4(F.stddev_pop(v)).alias("sp"), r4(F.stddev_samp(v)).alias("ss"), r4(F.var_pop(v)).alias("vp"), r4(F.var_samp(v)).alias("vs"))


@query("SELECT user_id, coalesce(round(var_samp(value), 6), 0) AS v0, coalesce(round(stddev_samp(value), 6), 0) AS s0 FROM events GROUP BY user_id")
def agg_variance0(t):
    return t.events.groupBy("user_id").agg(F.round(A.variance0(col("value")), 6).alias("v0"), F.round(A.stddev0(col("value")), 6).alias("s0"))


@query("SELECT event_type, coalesce(round(sum(CASE WHEN value > 1e6 THEN value END), 2), 0) AS none, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def agg_total(t):
    return t.events.groupBy("event_type").agg(r2(A.total(F.when(col("value") > 1e6, col("value")))).alias("none"), r2(A.total(col("value"))).alias("total"))


@query("SELECT event_type, round(median(value), 6) AS med, trunc(median(user_id))::BIGINT AS med_user FROM events GROUP BY event_type")
def agg_median(t):
    most = relational.largest_group(t.events, ["event_type"])
    value = relational.percentiles(t.events, ["event_type"], "value", {"med": 0.5}, most)
    user = relational.percentiles(t.events, ["event_type"], "user_id", {"med_user": 0.5}, most)
    return value.join(user, "event_type").select("event_type", F.round("med", 6).alias("med"), col("med_user").cast("bigint").alias("med_user"))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.25), 6) AS p25 FROM events GROUP BY event_type")
def agg_percentile(t):
    got = relational.percentiles(t.events, ["event_type"], "value", {"p90": 0.9, "p25": 0.25})
    return got.select("event_type", F.round("p90", 6).alias("p90"), F.round("p25", 6).alias("p25"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names, string_agg(n_name, '' ORDER BY n_nationkey) AS plain FROM nation GROUP BY n_regionkey")
def group_concat(t):
    return t.nation.groupBy("n_regionkey").agg(A.group_concat(col("n_name"), ";").alias("names"), A.group_concat(col("n_name"), "", col("n_nationkey")).alias("plain"))


@query("SELECT user_id, arg_min(event_type, ts) AS first_type, arg_max(event_type, ts) AS last_type FROM events GROUP BY user_id")
def agg_first_last(t):
    return t.events.groupBy("user_id").agg(A.first_by(col("event_type"), col("ts")).alias("first_type"), A.last_by(col("event_type"), col("ts")).alias("last_type"))


# --- time series ------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def range_group(t):
    return timeseries.range_group(t.events, "ts", 6, "HOUR", {"n": F.count("*"), "mean": F.round(F.avg("value"), 6)})


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 06:00:00') AS ts, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def range_group_keys_offset(t):
    df = timeseries.range_group(t.events, "ts", 24, "HOUR", {"total": r2(F.sum("value"))}, ["event_type"], offset=6)
    return df.select("event_type", "ts", "total")


_GAPS = """
WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS k, avg(value) AS v, count(*) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-05' GROUP BY 1),
g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-05', INTERVAL 5 MINUTE)) AS k),
j AS (SELECT g.k, b.v, b.n, CASE WHEN b.k IS NOT NULL THEN b.k END AS bk FROM g LEFT JOIN b ON g.k = b.k),
w AS (SELECT k, v, n, bk,
  last_value(v IGNORE NULLS) OVER p AS y1, last_value(n IGNORE NULLS) OVER p AS n1, last_value(bk IGNORE NULLS) OVER p AS x1,
  first_value(v IGNORE NULLS) OVER f AS y2, first_value(n IGNORE NULLS) OVER f AS n2, first_value(bk IGNORE NULLS) OVER f AS x2
  FROM j WINDOW p AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


def _filled(t, fill):
    e = t.events.where("event_type = 'click'")
    df = timeseries.range_group(e, "ts", 5, "MINUTE", {"v": F.avg("value"), "n": F.count("*")}, fill=fill, begin="2024-01-03", end="2024-01-05")
    return df.select("ts", F.round("v", 6).alias("v"), "n")


@query(_GAPS + "SELECT k AS ts, round(v, 6) AS v, n FROM w")
def range_fill_null(t):
    return _filled(t, "null")


@query(_GAPS + "SELECT k AS ts, round(y1, 6) AS v, n1 AS n FROM w")
def range_fill_previous(t):
    return _filled(t, "previous")


@query(_GAPS + "SELECT k AS ts, round(CASE WHEN bk IS NOT NULL THEN v ELSE y1 + epoch(k - x1) * (y2 - y1) / epoch(x2 - x1) END, 6) AS v, CASE WHEN bk IS NOT NULL THEN n ELSE trunc(n1 + epoch(k - x1) * (n2 - n1) / epoch(x2 - x1))::BIGINT END AS n FROM w")
def range_fill_linear(t):
    return _filled(t, "linear")


_AT = "TIMESTAMP '2024-01-10 12:00:00'"


@query(f"(SELECT 'next' AS how, event_id, ts FROM events WHERE ts >= {_AT} ORDER BY ts LIMIT 1) UNION ALL (SELECT 'next_only', event_id, ts FROM events WHERE ts > {_AT} ORDER BY ts LIMIT 1) UNION ALL (SELECT 'prev', event_id, ts FROM events WHERE ts <= {_AT} ORDER BY ts DESC LIMIT 1) UNION ALL (SELECT 'prev_only', event_id, ts FROM events WHERE ts < {_AT} ORDER BY ts DESC LIMIT 1)")
def time_next_prev(t):
    at = F.lit("2024-01-10 12:00:00").cast("timestamp")
    e = t.events.select("event_id", "ts")
    made = {"next": timeseries.time_next(e, "ts", at), "next_only": timeseries.time_next(e, "ts", at, True), "prev": timeseries.time_prev(e, "ts", at), "prev_only": timeseries.time_prev(e, "ts", at, True)}
    parts = [df.select(lit(k).alias("how"), "event_id", "ts") for k, df in made.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""
WITH p AS (SELECT * FROM events WHERE ts <= {_AT} ORDER BY ts DESC LIMIT 1), n AS (SELECT * FROM events WHERE ts >= {_AT} ORDER BY ts LIMIT 1)
SELECT {_AT} AS ts, p.event_type AS event_type, round(p.value + epoch({_AT} - p.ts) * (n.value - p.value) / epoch(n.ts - p.ts), 6) AS value FROM p, n
""")
def time_interpolated(t):
    return timeseries.interpolate(t.events.select("ts", "event_type", "value"), "ts", "value", "2024-01-10 12:00:00").withColumn("value", F.round("value", 6))


@query("""
WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04', INTERVAL 30 MINUTE)) AS k),
e AS (SELECT ts, event_type, value FROM events),
p AS (SELECT g.k, e.ts, e.event_type, e.value FROM g ASOF JOIN e ON g.k >= e.ts),
n AS (SELECT g.k, e.ts, e.value FROM g ASOF JOIN e ON g.k <= e.ts)
SELECT p.k AS ts, p.event_type, round(CASE WHEN n.ts = p.ts THEN p.value ELSE p.value + epoch(p.k - p.ts) * (n.value - p.value) / epoch(n.ts - p.ts) END, 6) AS value FROM p JOIN n ON p.k = n.k
""")
def time_sampling(t):
    e = t.events.select("ts", "event_type", "value")
    return timeseries.sample(e, "ts", "2024-01-02", "2024-01-04", 30, "MINUTE", ["value"]).withColumn("value", F.round("value", 6))


@query("SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-02 01:00:00') AS ts, max(value) AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02 01:00:00' AND TIMESTAMP '2024-01-05' GROUP BY 1")
def time_window_agg(t):
    at = [F.lit(x).cast("timestamp") for x in ("2024-01-02 01:00:00", "2024-01-05")]
    return timeseries.window_agg(t.events, "ts", "value", "MAX", *at, 3, "HOUR")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)")
def max_rows(t):
    return timeseries.extreme_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT min(l_quantity) FROM lineitem)")
def min_rows(t):
    return timeseries.extreme_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", False)


_TIME_AVG = "WITH g AS (SELECT {k} value, (epoch_us(coalesce(lead(ts) OVER w, ts)) - epoch_us(coalesce(lag(ts) OVER w, ts))) / 2.0 AS wt FROM events WINDOW w AS ({p} ORDER BY ts)) SELECT {k} round(CASE WHEN sum(wt) > 0 THEN sum(value * wt) / sum(wt) ELSE avg(value) END, 6) AS time_avg FROM g {g}"


@query(_TIME_AVG.format(k="user_id,", p="PARTITION BY user_id", g="GROUP BY user_id"))
def time_avg(t):
    return timeseries.time_avg(t.events, "ts", "value", ["user_id"]).withColumn("time_avg", F.round("time_avg", 6))


@query(_TIME_AVG.format(k="", p="", g=""))
def time_avg_global(t):
    return timeseries.time_avg(t.events, "ts", "value").withColumn("time_avg", F.round("time_avg", 6))


@query("SELECT p.event_id, p.user_id, v.value AS last_view, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_join(t):
    p = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = t.events.where("event_type = 'view'").select("user_id", "ts", col("value").alias("last_view"), col("event_id").alias("view_id"))
    return timeseries.asof_join(p, v, "ts", ["user_id"], ["last_view", "view_id"]).select("event_id", "user_id", "last_view", "view_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY")
def row_expiry(t):
    return timeseries.expire(t.events, "ts", 5, "DAY", F.lit("2024-01-20").cast("timestamp")).select("event_id")


# --- windows, sorts, sets ---------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
def row_number(t):
    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("rn"))


@query("SELECT event_id, lag(value) OVER w AS p1, lag(value, 2, -1.0) OVER w AS p2, lead(event_type) OVER w AS n1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("value").over(w).alias("p1"), F.lag("value", 2, -1.0).over(w).alias("p2"), F.lead("event_type").over(w).alias("n1"))


@query("SELECT event_id, round(avg(value) OVER w, 4) AS m, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)")
def rows_frame(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 1)
    return t.events.select("event_id", r4(F.avg("value").over(w)).alias("m"), F.max("value").over(w).alias("hi"))


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW)")
def range_frame_interval(t):
    got = relational.moving(t.events, ["event_type"], "ts", "value", {"n": "count", "total": "sum"}, seconds=600)
    return got.select("event_id", "n", r2(col("total")).alias("total"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts), 2) AS running, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def default_frames(t):
    w = Window.partitionBy("user_id")
    return t.events.select("event_id", r2(F.sum("value").over(w.orderBy("ts"))).alias("running"), F.count("*").over(w).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(t):
    return relational.topk_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [col("o_totalprice").desc(), col("o_orderkey")], 3)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 25")
def limit_offset(t):
    return relational.limit(t.events.select("event_id").orderBy("event_id"), 10, 25)


@query("SELECT event_id, nullif(event_type, 'view') AS kind FROM events ORDER BY kind ASC NULLS LAST, event_id")
def order_nulls_largest(t):
    e = t.events.select("event_id", F.nullif(col("event_type"), lit("view")).alias("kind"))
    return relational.order(e, "kind", "event_id")


_A, _B = "SELECT user_id FROM events WHERE event_type = 'click' AND value > 50", "SELECT user_id FROM events WHERE event_type = 'error' AND value < 30"


def _ab(t):
    return t.events.where("event_type = 'click' AND value > 50").select("user_id"), t.events.where("event_type = 'error' AND value < 30").select("user_id")


@query(f"{_A} UNION ALL {_B}")
def union_all(t):
    a, b = _ab(t)
    return a.union(b)


@query(f"{_A} UNION {_B}")
def union_distinct(t):
    a, b = _ab(t)
    return a.union(b).distinct()


@query(f"{_A} INTERSECT {_B}")
def intersect(t):
    a, b = _ab(t)
    return a.intersect(b)


@query(f"{_A} EXCEPT {_B}")
def except_(t):
    a, b = _ab(t)
    return a.subtract(b)


# --- scalar functions -------------------------------------------------------------------------


@query("SELECT p_partkey, abs(-p_size) AS a, round(log10(p_size + 1) / log10(2), 6) AS lg, round(p_retailprice, 1) AS r1, round(sqrt(p_size), 6) AS sq, trunc(p_retailprice) AS t0, p_partkey - p_partkey % 100 AS t100, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, 255::BIGINT AS h FROM part")
def numeric_fns(t):
    p, size = col("p_retailprice"), col("p_size")
    return t.part.select("p_partkey", F.abs(-size).alias("a"), F.round(S.log(lit(2), size + 1), 6).alias("lg"), S.round_half_away(p, 1).alias("r1"), F.round(S.sqrt(size), 6).alias("sq"), S.trunc(p).alias("t0"), S.trunc_int(col("p_partkey"), -2).alias("t100"), F.ceil(p).alias("c"), F.floor(p).alias("f"), S.hex_to_dec(lit(" ff ")).alias("h"))


@query("""SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name)::INT AS n, substr(c_name, 3, 5) AS sub, replace(c_name, '0', 'o') AS rep, translate(c_name, '#0', '-') AS tr,
  trim('x' || c_mktsegment || 'xx', 'x') AS tx, instr(c_name, '0')::INT AS i1, hex(c_mktsegment) AS hx, unicode(c_mktsegment) AS u, chr(65) || chr(66) AS ab, '''' || replace(c_name, '''', '''''') || '''' AS q, printf('%05d:%s', c_custkey, c_mktsegment) AS pf, c_name GLOB 'C*[0-4]' AS g FROM customer""")
def string_fns(t):
    n, m = col("c_name"), col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.lower(n).alias("lo"), F.upper(m).alias("up"), F.char_length(n).alias("n"), S.substr(n, 3, 5).alias("sub"), S.replace(n, "0", "o").alias("rep"), F.translate(n, "#0", "-").alias("tr"),
        S.trim(S.concat(lit("x"), m, lit("xx")), "x").alias("tx"), S.instr(n, "0").alias("i1"), S.hex_(m).alias("hx"), S.unicode_(m).alias("u"), S.char(lit(65), lit(66)).alias("ab"), S.quote(n).alias("q"), S.printf("%05d:%s", col("c_custkey"), m).alias("pf"), S.glob("C*[0-4]", n).alias("g"),
    )


@query("""SELECT event_id, year(ts)::BIGINT AS y, month(ts)::BIGINT AS mo, dayofmonth(ts)::BIGINT AS d, hour(ts)::BIGINT AS h, extract(dow FROM ts)::BIGINT AS dow, dayofyear(ts)::BIGINT AS doy, (epoch_us(ts) % 1000000)::BIGINT AS us,
  ts + INTERVAL 90 MINUTE AS plus, ts + INTERVAL 1 MONTH AS next_month, date_sub('hour', TIMESTAMP '2024-01-01', ts) AS dh, date_sub('month', TIMESTAMP '2023-11-15', ts) AS dm, date_trunc('hour', ts) AS th,
  strftime(ts, '%Y/%m/%d %H:%M:%S') AS sf, epoch_us(ts) // 1000 AS ms, make_timestamp(2024, 1, 2, 3, 4, 5.5) AS mk FROM events""")
def date_fns(t):
    ts = col("ts")
    at = lambda x: F.lit(x).cast("timestamp")
    return t.events.select(
        "event_id", S.extract("YEAR", ts).alias("y"), S.extract("MONTH", ts).alias("mo"), S.extract("DAY", ts).alias("d"), S.extract("HOUR", ts).alias("h"), S.extract("DAY_OF_WEEK", ts).alias("dow"), S.extract("DAY_OF_YEAR", ts).alias("doy"), S.extract("MICROSECOND", ts).alias("us"),
        S.timestamp_add("MINUTE", ts, 90).alias("plus"), S.timestamp_add("MONTH", ts, 1).alias("next_month"), S.timestamp_diff("HOUR", ts, at("2024-01-01")).alias("dh"), S.timestamp_diff("MONTH", ts, at("2023-11-15")).alias("dm"), S.timestamp_trunc("HOUR", ts).alias("th"),
        S.strftime("%Y/%m/%d %H:%M:%S", ts).alias("sf"), S.to_epoch_ms(ts).alias("ms"), S.make_timestamp(2024, 1, 2, 3, 4, 5.5).alias("mk"),
    )


@query("SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS c, ifnull(nullif(user_id, 1), -1) AS i, CASE WHEN nullif(user_id, 1) IS NULL THEN NULL ELSE greatest(user_id, 50) END AS g, least(user_id, 50) AS l, 'DOUBLE' AS ty FROM events")
def conditional_fns(t):
    u = col("user_id")
    return t.events.select("event_id", F.coalesce(F.nullif(col("event_type"), lit("view")), lit("none")).alias("c"), F.ifnull(F.nullif(u, lit(1)), lit(-1)).alias("i"), S.greatest_strict(F.nullif(u, lit(1)), lit(50)).alias("g"), S.least_strict(u, lit(50)).alias("l"), S.typeof("value").alias("ty"))


@query("SELECT vec_id, len(embedding)::INT AS n, round(embedding[1]::DOUBLE, 6) AS e0, round(embedding[4]::DOUBLE, 6) AS e3 FROM embeddings")
def array_fns(t):
    e = col("embedding")
    return t.embeddings.select("vec_id", S.array_length(e).alias("n"), F.round(S.element(lit(0), e).cast("double"), 6).alias("e0"), F.round(S.element(lit(3), e).cast("double"), 6).alias("e3"))


@query("SELECT p_partkey, p_size::DOUBLE AS xmin, (p_size + p_partkey % 5)::DOUBLE AS xmax, p_size <= 20 AND p_size + p_partkey % 5 >= 10 AND 0 <= 5 AND p_partkey % 3 >= 1 AS hit, 4326 AS srid FROM part")
def gis_mbr(t):
    g = F.format_string("LINESTRING(%d 0, %d %d);4326", col("p_size"), (col("p_size") + col("p_partkey") % 5).cast("int"), (col("p_partkey") % 3).cast("int"))
    box = G.box(g)
    hit = G.intersects(box, G.make_rect(lit(20.0), lit(1.0), lit(10.0), lit(5.0)))
    return t.part.select("p_partkey", box["xmin"].alias("xmin"), box["xmax"].alias("xmax"), hit.alias("hit"), G.srid(g).alias("srid"))


# --- row patterns -----------------------------------------------------------------------------

_UP_DOWN = """
WITH c AS (SELECT user_id, ts, event_id, CASE WHEN value > lag(value) OVER w THEN 'U' WHEN value < lag(value) OVER w THEN 'D' ELSE '.' END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, string_agg(ch, '' ORDER BY ts, event_id) AS s FROM c GROUP BY user_id),
m AS (SELECT user_id, unnest(regexp_extract_all(s, 'U+D+')) AS m, unnest(range(1, len(regexp_extract_all(s, 'U+D+')) + 1)) AS k FROM s)
"""


def _moves(t):
    v = pattern.prev("value", ["user_id"], ["ts", "event_id"])
    return {"UP": col("value") > v, "DOWN": col("value") < v}


@query(_UP_DOWN + "SELECT user_id, k AS match_number, length(m)::BIGINT AS length FROM m")
def pattern_match_updown(t):
    d = _moves(t)
    return pattern.islands(t.events, ["user_id"], ["ts", "event_id"], d, ["UP", "DOWN"]).select("user_id", "match_number", "length")


@query(_UP_DOWN + "SELECT user_id, k AS match_number, length(m)::BIGINT AS n, length(regexp_extract(m, 'U+'))::BIGINT AS ups FROM m")
def match_recognize_one_row(t):
    e = t.events.select("user_id", "ts", "event_id", "value")
    return pattern.match_recognize(e, ["user_id"], ["ts", "event_id"], "UP+ DOWN+", _moves(t), {"n": F.count("*"), "ups": F.count(F.when(col("classifier") == "UP", 1))})


@query("""
WITH c AS (SELECT user_id, event_id, ts, event_type, lead(event_type) OVER w AS n1, lag(event_type) OVER w AS p1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, 'V' AS classifier FROM c WHERE event_type = 'view' AND n1 = 'purchase' UNION ALL SELECT user_id, event_id, 'P' FROM c WHERE event_type = 'purchase' AND p1 = 'view'
""")
def match_recognize_all_rows(t):
    e = t.events.select("user_id", "ts", "event_id", "event_type")
    got = pattern.match_rows(e, ["user_id"], ["ts", "event_id"], "V P", {"V": col("event_type") == "view", "P": col("event_type") == "purchase"})
    return got.select("user_id", "event_id", "classifier")


# --- changes of tables, catalog, front ends ---------------------------------------------------

_NEW = "SELECT c_custkey + 1490 AS c_custkey, 'new' AS c_name, c_nationkey, 0.0::DOUBLE AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey <= 20"


def _new(t):
    return t.customer.where("c_custkey <= 20").select((col("c_custkey") + 1490).alias("c_custkey"), lit("new").alias("c_name"), "c_nationkey", lit(0.0).alias("c_acctbal"), "c_mktsegment")


@query(f"WITH n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert(t):
    return dml.upsert(t.customer, _new(t), ["c_custkey"])


@query(f"WITH n AS ({_NEW}) SELECT * FROM customer UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_or_ignore(t):
    return dml.insert_or_ignore(t.customer, _new(t), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update(t):
    return dml.update(t.customer, col("c_acctbal") < 0, {"c_acctbal": lit(0.0), "c_mktsegment": lit("DEBT")}).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT event_id FROM events WHERE NOT coalesce(nullif(event_type, 'view') = 'click', false)")
def delete(t):
    return dml.delete(t.events, F.nullif(col("event_type"), lit("view")) == "click").select("event_id")


@query("SELECT n_nationkey, n_name AS label, n_regionkey, 'none' AS note FROM nation")
def alter_columns(t):
    return dml.add_column(dml.rename_column(t.nation, "n_name", "label"), "note", "string", "none")


@query("SELECT event_id FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06')")
def drop_partition(t):
    return dml.drop_partition(t.events, "ts", "2024-01-03", "2024-01-06").select("event_id")


@query("SELECT s_suppkey, count(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey")
def join_hint(t):
    return t.supplier.join(t.lineitem.hint("shuffle_hash"), col("s_suppkey") == col("l_suppkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("SELECT table_name, count(*)::INT AS n_columns FROM information_schema.columns WHERE table_name IN ('region', 'part') GROUP BY table_name")
def meta_tables(t):
    return catalog.tables_of({n: getattr(t, n) for n in ("region", "part")})


@query("SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) WHERE k = 1")
def last_row_per_series(t):
    return relational.topk_per_group(t.events.select("user_id", "ts", "value"), ["user_id"], [col("ts").desc()], 1)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS ts, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_rollup(t):
    """Tumbling windows over the events as a stream, to its end, into files."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    stream = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/event[s].parquet").withColumn("ts", col("ts").cast("timestamp"))
    got = windows.tumbling(stream, "ts", "1 day", {"n": F.count("*")}, ["event_type"])
    return windows.rollup_table(got, ["ts", "event_type"], work_dir(t.spark, "rollup")).select("ts", "event_type", "n")


@query("SELECT table_name, column_name, ordinal_position AS ordinal FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'orders')")
def meta_columns(t):
    tables = {n: getattr(t, n) for n in ("region", "nation", "customer", "orders")}
    return catalog.columns_of(tables).select("table_name", "column_name", "ordinal")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS day, count(*) AS n, coalesce(sum(value::DOUBLE), 0) > 0 AS some FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1 ORDER BY 1 LIMIT 12")
def dialect_range_group(t):
    t.events.createOrReplaceTempView("events")
    return dialect.sql(t.spark, "SELECT ts AS day, count(*) AS n, TOTAL(value) > 0 AS some FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY RANGE(ts) EVERY(1, DAY) ORDER BY day LIMIT 12")


@query("SELECT event_id, extract(dow FROM ts)::BIGINT AS dow, date_sub('hour', TIMESTAMP '2024-01-01', ts) AS h, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type GLOB 'c*' AND event_type IS NOT DISTINCT FROM 'click'")
def dialect_functions(t):
    t.events.createOrReplaceTempView("events")
    return dialect.sql(t.spark, "SELECT event_id, EXTRACT(DAY_OF_WEEK, ts) AS dow, TIMESTAMP_DIFF(HOUR, ts, TIMESTAMP '2024-01-01') AS h, count(*) OVER (PARTITION BY user_id ORDER BY ts) ROWS 2 PRECEDING AS n FROM events WHERE event_type GLOB 'c*' AND event_type IS 'click'")


@query("SELECT event_id, value FROM events WHERE (value > 99.5) <> (user_id = 3) AND ts < TIMESTAMP '2024-01-20' ORDER BY value DESC NULLS FIRST, event_id LIMIT 15")
def container_query(t):
    return container.tql(t.spark, "SELECT * WHERE (value > 99.5) XOR (user_id = 3) AND ts < TIMESTAMP('2024-01-20T00:00:00') ORDER BY value DESC, event_id LIMIT 15", t.events, "ts").select("event_id", "value")


@query("SELECT round(coalesce(var_samp(value), 0), 4) AS variance FROM events")
def container_aggregate(t):
    return container.tql(t.spark, "SELECT VARIANCE(value)", t.events, "ts").select(r4(col("variance")).alias("variance"))


@query("SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-02') AS ts, min(value) AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-09' GROUP BY 1")
def container_window_agg(t):
    return container.tql(t.spark, "SELECT TIME_WINDOW_AGG(value, 'MIN', TIMESTAMP('2024-01-02T00:00:00'), TIMESTAMP('2024-01-09T00:00:00'), 12, HOUR)", t.events, "ts")


# --- the dialect's time-series and pattern clauses as text ------------------------------------

_RANGE_FILL = """
WITH b AS (SELECT time_bucket(INTERVAL {step}, ts, TIMESTAMP '1970-01-01') AS k, {aggs} FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' GROUP BY 1),
g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06', INTERVAL {step})) AS k),
j AS (SELECT g.k, b.* EXCLUDE (k), CASE WHEN b.k IS NOT NULL THEN b.k END AS bk FROM g LEFT JOIN b ON g.k = b.k)
"""
_AROUND = "WINDOW p AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _line(column: str, kind: str = "") -> str:
    x1, y1, x2, y2 = (f"{fn}({c} IGNORE NULLS) OVER {w}" for fn, c, w in (("last_value", "bk", "p"), ("last_value", column, "p"), ("first_value", "bk", "f"), ("first_value", column, "f")))
    return f"CASE WHEN bk IS NOT NULL THEN {column} ELSE {'trunc' if kind else ''}({y1} + epoch(k - {x1}) * ({y2} - {y1}) / epoch({x2} - {x1})){kind} END"


@query("SELECT time_bucket(INTERVAL 20 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, round(avg(value), 6) AS avg_value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' GROUP BY 1")
def dialect_range_between(t):
    t.events.createOrReplaceTempView("events")
    return dialect.sql(t.spark, "SELECT ts, round(avg(value), 6) AS avg_value FROM events WHERE ts BETWEEN TIMESTAMP('2024-01-05T00:00:00Z') AND TIMESTAMP('2024-01-06T00:00:00Z') GROUP BY RANGE (ts) EVERY (20, MINUTE)")


@query(_RANGE_FILL.format(step="2 MINUTE", aggs="avg(value) AS v") + "SELECT k AS ts, round(v, 6) AS v FROM j")
def dialect_fill_null(t):
    """Gaps before the first and after the last row are filled too, up to the bounds of BETWEEN."""
    t.events.createOrReplaceTempView("events")
    return dialect.sql(t.spark, "SELECT ts, round(avg(value), 6) AS v FROM events WHERE ts BETWEEN TIMESTAMP('2024-01-05T00:00:00Z') AND TIMESTAMP('2024-01-06T00:00:00Z') GROUP BY RANGE(ts) EVERY(2, MINUTE) FILL(NULL)")


@query(_RANGE_FILL.format(step="2 MINUTE", aggs="arg_min(event_id, ts) AS event_id, arg_min(user_id, ts) AS user_id, arg_min(event_type, ts) AS event_type, arg_min(value, ts) AS value, arg_min(props, ts) AS props") + f"SELECT k AS ts, {_line('event_id', '::BIGINT')} AS event_id, {_line('user_id', '::BIGINT')} AS user_id, last_value(event_type IGNORE NULLS) OVER p AS event_type, round({_line('value')}, 6) AS value, last_value(props IGNORE NULLS) OVER p AS props FROM j {_AROUND}")
def dialect_resample(t):
    """SELECT * with FILL(LINEAR)."""
    t.events.createOrReplaceTempView("events")
    got = dialect.sql(t.spark, "SELECT * FROM events WHERE ts BETWEEN TIMESTAMP('2024-01-05T00:00:00Z') AND TIMESTAMP('2024-01-06T00:00:00Z') GROUP BY RANGE (ts) EVERY (2, MINUTE) FILL (LINEAR)")
    return got.withColumn("value", F.round("value", 6))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts + INTERVAL 9 HOUR, TIMESTAMP '1970-01-01') - INTERVAL 9 HOUR AS day, count(*) AS n FROM events GROUP BY 1")
def dialect_range_zone(t):
    """Days of a zone's local time."""
    t.events.createOrReplaceTempView("events")
    return dialect.sql(t.spark, "SELECT ts AS day, count(*) AS n FROM events GROUP BY RANGE(ts) EVERY(1, DAY, 'Asia/Tokyo')")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 90 MINUTE, TIMESTAMP '1970-01-01') AS slot, sum(value) > 100 AS much FROM events WHERE ts > TIMESTAMP '2024-01-10' GROUP BY 1")
def dialect_range_expression(t):
    """An expression as the key."""
    t.events.createOrReplaceTempView("events")
    return dialect.sql(t.spark, "SELECT TIMESTAMP_ADD(MINUTE, ts, -90) AS slot, sum(value) > 100 AS much FROM events WHERE ts > TIMESTAMP('2024-01-10T00:00:00Z') GROUP BY RANGE(TIMESTAMP_ADD(MINUTE, ts, -90)) EVERY(6, HOUR)")


_ISLANDS = """
WITH c AS (SELECT user_id, ts, event_id, value, CASE WHEN value > lag(value) OVER w THEN 'U' WHEN value < lag(value) OVER w THEN 'D' ELSE '.' END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN lag(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) = ch THEN 0 ELSE 1 END AS nw FROM c)),
g AS (SELECT user_id, isl, any_value(ch) AS ch, min(ts) AS f, max(ts) AS l, count(*) AS n, max(value) AS hi, min(value) AS lo FROM i GROUP BY ALL),
m AS (SELECT user_id, isl, f AS start_time, lead(l) OVER w AS end_time, n AS ups, hi AS peak, lead(lo) OVER w AS low, ch, lead(ch) OVER w AS nx FROM g WINDOW w AS (PARTITION BY user_id ORDER BY isl)),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY isl) AS match_no FROM m WHERE ch = 'U' AND nx = 'D')
"""
_MATCH = "FROM events MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY ts, event_id MEASURES FIRST(ts) AS start_time, LAST(ts) AS end_time, MATCH_NUMBER() AS match_no, COUNT(UP.*) AS ups, LAST(UP.value) AS peak, MIN(DOWN.value) AS low {rows} AFTER MATCH SKIP PAST LAST ROW PATTERN (UP+ DOWN+) DEFINE UP AS value > PREV(value), DOWN AS DOWN.value < PREV(value, 1))"


@query(_ISLANDS + "SELECT user_id, start_time, end_time, match_no, ups, peak, low FROM x")
def dialect_match_recognize(t):
    t.events.createOrReplaceTempView("events")
    return dialect.sql(t.spark, f"SELECT * {_MATCH.format(rows='ONE ROW PER MATCH')}")


@query(_ISLANDS + "SELECT c.user_id, c.event_id, x.match_no, x.start_time, c.ch = 'U' AS up FROM x JOIN c ON c.user_id = x.user_id AND c.ts BETWEEN x.start_time AND x.end_time")
def dialect_match_all_rows(t):
    t.events.createOrReplaceTempView("events")
    return dialect.sql(t.spark, "SELECT user_id, event_id, match_no, start_time, kind = 'UP' AS up FROM (SELECT * FROM events) MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY ts, event_id MEASURES FIRST(ts) AS start_time, MATCH_NUMBER() AS match_no, CLASSIFIER() AS kind ALL ROWS PER MATCH PATTERN (UP+ DOWN+) DEFINE UP AS value > PREV(value), DOWN AS value < PREV(value)) AS m")


@query("""SELECT event_id, ts + INTERVAL 1 MONTH AS m1, date_sub('day', date_trunc('day', TIMESTAMP '2024-01-01 09:00:00'), ts + INTERVAL 9 HOUR) AS dd, TIMESTAMP '2024-01-02 03:04:05' AS t0, TIMESTAMP '2024-01-01 18:04:05' AS t1, TIMESTAMP '2024-01-02 03:04:05' AS t2,
  TIMESTAMP '2024-01-02 03:04:05.123' AS t3, TIMESTAMP '2024-01-02 03:04:05.123456' AS t4, TIMESTAMP '2023-12-31 15:00:00' AS mk FROM events WHERE ts < TIMESTAMP '2024-01-25'""")
def dialect_timestamps(t):
    """TIMESTAMP(text[, zone]) with its finer forms, and zones in the other functions."""
    t.events.createOrReplaceTempView("events")
    return dialect.sql(t.spark, """SELECT event_id, TIMESTAMP_ADD(MONTH, ts, 1) AS m1, TIMESTAMP_DIFF(DAY, ts, TIMESTAMP('2023-12-31T15:00:00Z'), 'Asia/Tokyo') AS dd, TIMESTAMP('2024-01-02T03:04:05Z') AS t0, TIMESTAMP('2024-01-02 03:04:05', 'Asia/Tokyo') AS t1, TIMESTAMP('2024-01-02T03:04:05Z', 'Asia/Tokyo') AS t2,
      TIMESTAMP('2024-01-02T03:04:05.123456Z') AS t3, TIMESTAMP_US('2024-01-02T03:04:05.123456Z') AS t4, MAKE_TIMESTAMP(2024, 1, 1, 'Asia/Tokyo') AS mk FROM events WHERE ts < TIMESTAMP_MS('2024-01-25T00:00:00.000Z')""")


@query("SELECT TRUE AS has_plan, TRUE AS has_rows")
def dialect_explain(t):
    t.events.createOrReplaceTempView("events")
    got = dialect.sql(t.spark, "EXPLAIN ANALYZE SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    return got.agg(F.max(col("plan").contains("HashAggregate")).alias("has_plan"), F.max(col("plan").startswith("rows: 5,")).alias("has_rows"))


@query("SELECT TRUE AS random_ok, TRUE AS now_ok, 7 AS zeros, 9 AS noise")
def random_and_now(t):
    """Their values differ from run to run; their shapes don't."""
    one = t.spark.range(100).select(S.random_long().alias("r"), S.now().alias("n"), S.zeroblob(7).alias("z"), S.randomblob(9).alias("b"))
    return one.agg((F.count_distinct("r") > 90).alias("random_ok"), (F.min("n") > "2024-01-01").alias("now_ok"), F.max(F.octet_length("z")).alias("zeros"), F.max(F.octet_length("b")).alias("noise"))


@query("""SELECT event_type, count(DISTINCT user_id) AS c, min(DISTINCT user_id) AS lo, max(DISTINCT user_id) AS hi, sum(DISTINCT user_id)::DOUBLE AS total, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS ids, round(stddev_samp(DISTINCT user_id), 4) AS ss, round(stddev_pop(DISTINCT user_id), 4) AS sp,
  round(var_pop(DISTINCT user_id), 4) AS vp, round(var_samp(DISTINCT user_id), 4) AS vs, round(coalesce(var_samp(DISTINCT user_id), 0), 4) AS v0, round(coalesce(stddev_samp(DISTINCT user_id), 0), 4) AS s0, trunc(median(DISTINCT user_id))::BIGINT AS med FROM events GROUP BY event_type""")
def agg_distinct_forms(t):
    """Every aggregate over distinct values: these are formed once, then aggregated."""
    u = col("user_id")
    ids = t.events.select("event_type", "user_id").distinct()
    got = ids.groupBy("event_type").agg(F.count(u).alias("c"), F.min(u).alias("lo"), F.max(u).alias("hi"), A.total(u).alias("total"), A.group_concat(u.cast("string"), ",").alias("ids"), r4(F.stddev_samp(u)).alias("ss"), r4(F.stddev_pop(u)).alias("sp"), r4(F.var_pop(u)).alias("vp"), r4(F.var_samp(u)).alias("vs"), r4(A.variance0(u)).alias("v0"), r4(A.stddev0(u)).alias("s0"))
    return got.join(relational.percentiles(ids, ["event_type"], "user_id", {"med": 0.5}).withColumn("med", col("med").cast("bigint")), "event_type")


@query("SELECT * FROM (SELECT unnest(['SUM', 'AVG', 'MAX', 'MIN', 'COUNT', 'VARIANCE_POP', 'VARIANCE_SAMP', 'STDDEV_POP', 'STDDEV_SAMP', 'STDDEV']) AS what, unnest([sum(value), avg(value), max(value), min(value), count(*), var_pop(value), var_samp(value), stddev_pop(value), stddev_samp(value), stddev_samp(value)]) AS v FROM events)".replace("SELECT * FROM", "SELECT what, round(v, 4) AS v FROM"))
def container_aggregates(t):
    """Each aggregate of the container language over the whole container."""
    parts = []
    for name in ("SUM", "AVG", "MAX", "MIN", "COUNT", "VARIANCE_POP", "VARIANCE_SAMP", "STDDEV_POP", "STDDEV_SAMP", "STDDEV"):
        got = container.tql(t.spark, f"SELECT {name}({'*' if name == 'COUNT' else 'value'})", t.events, "ts")
        parts.append(got.select(lit(name).alias("what"), r4(col(name.lower()).cast("double")).alias("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""WITH u AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer),
d AS (SELECT * FROM u WHERE c_mktsegment <> 'BUILDING'),
n AS (SELECT c_custkey + 1490 AS c_custkey, 'new' AS c_name, c_nationkey, 1.5 AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 3),
r AS (SELECT * FROM n UNION ALL SELECT * FROM d WHERE c_custkey NOT IN (SELECT c_custkey FROM n)),
i AS (SELECT c_custkey + 10 AS c_custkey, 'kept' AS c_name, NULL::INT AS c_nationkey, NULL::DOUBLE AS c_acctbal, NULL::VARCHAR AS c_mktsegment FROM customer)
SELECT * FROM r UNION ALL SELECT * FROM i WHERE c_custkey NOT IN (SELECT c_custkey FROM r)""")
def dml_text(t):
    """UPDATE, DELETE, INSERT OR REPLACE and OR IGNORE as text, one after the other."""
    t.customer.createOrReplaceTempView("customers_before")
    db = Database(t.spark)
    db.add("customers", t.customer, ["c_custkey"])
    db.run("UPDATE customers SET c_acctbal = 0.0, c_mktsegment = 'DEBT' WHERE c_acctbal < 0")
    db.run("DELETE FROM customers WHERE c_mktsegment = 'BUILDING'")
    db.run("INSERT OR REPLACE INTO customers SELECT c_custkey + 1490, 'new', c_nationkey, 1.5, c_mktsegment FROM customers_before WHERE c_nationkey = 3")
    db.run("INSERT OR IGNORE INTO customers (c_custkey, c_name) SELECT c_custkey + 10, 'kept' FROM customers_before")
    return db.run("SELECT * FROM customers")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS day, user_id, round(sum(value), 2) AS total, 'none' AS note FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11') GROUP BY 1, 2")
def ddl_text(t):
    """CREATE TABLE with a key and interval partitions, INSERT ... SELECT, ALTER TABLE, CREATE VIEW."""
    t.events.createOrReplaceTempView("events")
    db = Database(t.spark)
    db.run("CREATE TABLE daily (d TIMESTAMP, user_id LONG, total DOUBLE, PRIMARY KEY (d, user_id)) PARTITION BY RANGE (d) EVERY (1, DAY)")
    db.run("INSERT INTO daily SELECT date_trunc('DAY', ts), user_id, round(sum(value), 2) FROM events GROUP BY 1, 2")
    db.run("ALTER TABLE daily DROP PARTITION FOR (TIMESTAMP('2024-01-10T07:00:00Z'))")
    db.run("ALTER TABLE daily RENAME COLUMN d TO day")
    db.run("ALTER TABLE daily ADD COLUMN note STRING DEFAULT 'none'")
    db.run("CREATE OR REPLACE VIEW daily_view AS SELECT day, user_id, total, note FROM daily")
    return db.run("SELECT * FROM daily_view")


@query("SELECT unnest(['container', 'column', 'key', 'index', 'view', 'partition', 'database', 'socket']) AS kind, unnest([2, 9, 3, 1, 1, 2, 1, 0])::BIGINT AS n")
def meta_kinds(t):
    """The meta tables of two tables, a view and an index."""
    db = Database(t.spark)
    db.add("supplier_table", t.supplier, ["s_suppkey"])
    db.run("CREATE TABLE readings (at TIMESTAMP(3), device STRING, v DOUBLE[], raw BLOB, ok BOOL NOT NULL, PRIMARY KEY (at, device)) USING TIMESERIES PARTITION BY RANGE at EVERY (30, DAY) SUBPARTITION BY HASH device SUBPARTITIONS 8")
    db.run("CREATE INDEX by_name ON supplier_table (s_name)")
    db.run("CREATE VIEW ok_readings AS SELECT at, device FROM readings WHERE ok")
    parts = [db.meta(k).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("container", "column", "key", "index", "view", "partition", "database", "socket")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 20 AND p_size + p_partkey % 5 >= 10 AND p_partkey % 3 >= 1 AND p_partkey > 10")
def container_geometry(t):
    """Bounding boxes in the container language."""
    shape = F.format_string("LINESTRING(%d 0, %d %d);4326", col("p_size"), (col("p_size") + col("p_partkey") % 5).cast("int"), (col("p_partkey") % 3).cast("int"))
    parts = t.part.select("p_partkey", "p_size", shape.alias("shape"))
    return container.tql(t.spark, "SELECT * WHERE p_partkey > 10 AND ST_MBRINTERSECTS(shape, ST_MAKERECT(20, 1, 10, 5))", parts).select("p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE p_size <= 1 OR (p_size <= 25 AND p_size + 3 >= 25)")
def container_quadratic_surface(t):
    """Boxes that the surface x = 25 or the cylinder of radius 0.5 around (0.5, 0) cuts: the form changes its sign there."""
    shape = F.format_string("LINESTRING(%d 0 0, %d 0 1)", col("p_size"), (col("p_size") + 3).cast("int"))
    parts = t.part.select("p_partkey", shape.alias("shape"))
    plane = container.tql(t.spark, "SELECT * WHERE ST_QSFMBRINTERSECTS(ST_GEOMFROMTEXT('QUADRATICSURFACE(0 0 0 0 0 0 0 0 0 1 0 0 -25)'), shape)", parts)
    tube = container.tql(t.spark, "SELECT * WHERE ST_QSFMBRINTERSECTS(ST_MAKECYLINDER(0.5, 0, 0.5), shape)", parts)
    return plane.union(tube).select("p_partkey").distinct()


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%e%' AND (p_type || '_x%') LIKE '%!_x!%' ESCAPE '!' AND p_name NOT LIKE 'a%'")
def dialect_like_escape(t):
    t.part.createOrReplaceTempView("part")
    return dialect.sql(t.spark, "SELECT /*+ NoCostBasedJoinDriving() */ p_partkey FROM part WHERE p_name LIKE '%e%' AND (p_type || '_x%') LIKE '%!_x!%' ESCAPE '!' AND p_name NOT LIKE 'a%'")
