"""Relational operators with this dialect's semantics, and joins for scale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(df: DataFrame, *keys: tuple[str, str] | str) -> DataFrame:
    """ORDER BY where null is the largest: last ascending, first descending."""
    made = []
    for k in keys:
        name, way = (k, "asc") if isinstance(k, str) else k
        made.append(F.col(name).asc_nulls_last() if way.lower() == "asc" else F.col(name).desc_nulls_first())
    return df.orderBy(*made)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def topk_per_group(df: DataFrame, by: list[str], keys: list[Column], k: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + k of each group in the order of `keys`; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*keys)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n").between(offset + 1, offset + k)).drop("_n")


#: Rows of a key on either side that meet in one cell of a natural join, pairs its tasks have on average, and its most tasks.
SIDE = 1024
PAIRS = 4_000_000
TASKS = 20_000
#: Keys up to which their sizes may be broadcast.
KEYS = 100_000


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """On all common columns, which appear once; without any, every pair.

    The pairs of an inner join are counted first, by key. Where they are many, and more than the rows that have a
    partner, `_celled_join` makes the same pairs; it reads both sides again, so these must not change between readings.
    """
    common = [c for c in a.columns if c in b.columns]
    if how != "inner" or any(f'"type":"{k}"' in df.schema.json() for df in (a, b) for k in ("map", "variant", "interval")):  # these have no order
        return a.join(b, common, how) if common else a.crossJoin(b)
    both = _equal(a.groupBy(*common).agg(F.count("*").alias("_n")), b.groupBy(*common).agg(F.count("*").alias("_m")), common)
    pairs = F.col("_n").cast("double") * F.col("_m")
    k, rows, p = both.agg(F.count("*"), F.sum(F.col("_n") + F.col("_m")), F.sum(pairs)).first()
    if k == 0 or p <= max(PAIRS, rows):
        return _equal(a, b, common)
    parts = both.select(*common, F.ceil(F.col("_n") / SIDE).cast("int").alias("_p"), F.ceil(F.col("_m") / SIDE).cast("int").alias("_q"))
    return _celled_join(a, b, common, F.broadcast(parts) if k <= KEYS else parts, min(TASKS, -int(-p // PAIRS)))


def _equal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.crossJoin(b)


def _celled_join(a: DataFrame, b: DataFrame, keys: list[str], parts: DataFrame, tasks: int) -> DataFrame:
    """The inner join on `keys` where rows of a key are dealt into `_p` parts of `a` and `_q` parts of `b`.

    Each two parts of a key meet in a cell of their own, which has some SIDE x SIDE pairs, and cells are spread over
    `tasks`; a row goes to as many cells as the other side has parts. Rows are dealt by their hash, so that a task run
    again deals them alike, together with the number of the row among equal ones, so that those too are spread.
    """

    def dealt(df: DataFrame, own: str, of: str, other: str, others: str) -> DataFrame:
        copy = F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(0)))
        got = _equal(df, parts, keys).withColumn("_copy", copy)
        got = got.select(*df.columns, F.pmod(F.xxhash64(*df.columns, "_copy"), F.col(of)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))
        return got.repartition(tasks, *keys, "_i", "_j")  # a number that is asked for isn't coalesced

    left, right = dealt(a, "_i", "_p", "_j", "_q"), dealt(b, "_j", "_q", "_i", "_p")
    return left.join(right.hint("merge"), [*keys, "_i", "_j"]).drop("_i", "_j")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Rows of `points` with low <= at < high in `ranges`, whose columns are added.

    Both sides meet in cells of `width`, so the join is an equality and no side need be broadcast; a
    range takes as many rows as it has cells, so `width` should be near its usual length.
    """
    on = on or []
    cell = F.floor(F.col(at) / width).cast("long")
    first, last = F.floor(F.col(low) / width).cast("long"), F.ceil(F.col(high) / width).cast("long") - 1
    r = ranges.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, last))))
    return points.withColumn("_cell", cell).join(r, [*on, "_cell"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equality join whose keys are spread over `salts` parts, for keys that hold a large share of `big`."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join can't copy its right side")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def moving(df: DataFrame, by: list[str], time: str, value: str, aggs: dict[str, str], seconds: int | None = None, rows: int | None = None) -> DataFrame:
    """Aggregates over the last `seconds` (RANGE frame on the time) or `rows` rows, the current one included."""
    if seconds is not None:
        w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    else:
        w = Window.partitionBy(*by).orderBy(time).rowsBetween(-(rows or 1) + 1, 0)
    return df.withColumns({n: F.call_function(f, F.col(value)).over(w) for n, f in aggs.items()})


#: Parts into which a group's values are cut to find those around a rank.
CELLS = 1024
#: Rows of a group up to which its values may be counted in one buffer, which then has at most so many entries.
BUFFERED = 2_000_000


def largest_group(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def percentiles(df: DataFrame, by: list[str], column: str, rates: dict[str, float], largest: int | None = None) -> DataFrame:
    """(by..., one column for each rate): exact PERCENTILE_CONT of groups of any size; nulls are left out.

    `largest` is the size of the largest group, counted if it isn't given. Up to BUFFERED rows Spark's own aggregate
    does it, which holds a group's distinct values; beyond that the same values come from counts.
    A group's range is cut in CELLS parts, whose counts (combined on the map side) tell which of them hold the ranks
    asked for. Only values of those parts are put in order, as distinct values with their counts; no group is held
    in one buffer. A group without values has no row.
    """
    for r in rates.values():
        if not 0 <= r <= 1:
            raise ValueError("a rate lies between 0 and 1")
    if (largest_group(df, by) if largest is None else largest) <= BUFFERED:
        own = F.col(column).cast("double")
        return df.where(own.isNotNull()).groupBy(*by).agg(*[F.percentile(own, r).alias(n) for n, r in rates.items()])
    v = F.col("_v")
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by], F.lit(True))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(CELLS - 1), F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS))).otherwise(F.lit(0)).cast("int")
    ends = ends if by else F.broadcast(ends)  # without groups it is one row
    cells = rows.alias("r").join(ends.alias("e"), same("r", "e")).select(*[F.col(f"r.{k}").alias(k) for k in by], cell.alias("_cell"), v, "_n")
    counts = cells.groupBy(*by, "_cell").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    before = F.sum("_k").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
    counts = counts.withColumn("_before", before)
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("rate")) for n, r in rates.items()])
    at = F.col("_x.rate") * (F.col("_n") - 1)
    wanted = counts.withColumn("_x", F.explode(ranks)).withColumn("_at", at)
    wanted = wanted.where((F.ceil("_at") >= F.col("_before")) & (F.floor("_at") < F.col("_before") + F.col("_k")))
    held = wanted.select(*by, "_cell", "_before").distinct()
    picked = cells.alias("c").join(held.alias("h"), same("c", "h") & (F.col("c._cell") == F.col("h._cell"))).select(*[F.col(f"c.{k}").alias(k) for k in by], F.col("c._cell").alias("_cell"), "_before", "_v", "_n")
    each = picked.groupBy(*by, "_cell", "_before", "_n", "_v").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    each = each.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_k"))
    out = []
    for n, r in rates.items():
        x = F.lit(float(r)) * (F.col("_n") - 1)
        low = F.max(F.when((F.floor(x) >= F.col("_start")) & (F.floor(x) < F.col("_end")), v))
        high = F.max(F.when((F.ceil(x) >= F.col("_start")) & (F.ceil(x) < F.col("_end")), v))
        out.append((low + (high - low) * F.max(x - F.floor(x))).alias(n))
    return each.groupBy(*by).agg(*out)
