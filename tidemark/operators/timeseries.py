"""Time-series operators: grouping by intervals with gap filling, sampling, interpolation, time-weighted averages.

Series are reduced to one row per interval by a hash aggregation before any window is taken, so the
windows over a whole series see at most MOST_ROWS rows, however long the table is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.scalar import micros

#: Rows that one query may generate by filling gaps, as in the reference semantics.
MOST_ROWS = 100_000


def _us(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _ts(us: Column) -> Column:
    return F.timestamp_micros(us)


def bucket(ts: Column | str, n: int, unit: str, offset: int = 0) -> Column:
    """Start of the interval of n units, counted from the epoch plus `offset` units, that holds `ts`."""
    step = micros(n, unit)
    shift = F.lit(offset * micros(1, unit))
    return _ts(_us(ts) - F.pmod(_us(ts) - shift, F.lit(step)))


def _same(by: list[str], left: DataFrame | None = None) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.lit(True))


def range_group(
    df: DataFrame,
    key: str,
    every: int,
    unit: str,
    aggs: dict[str, Column],
    by: list[str] | None = None,
    offset: int = 0,
    fill: str | None = None,
    begin=None,
    end=None,
    most: int = MOST_ROWS,
    zone: str | None = None,
) -> DataFrame:
    """GROUP BY RANGE(key) EVERY(every, unit, offset[, zone]) [FILL(...)]: (by..., key, aggregates...).

    `fill` is None or 'none' (only intervals with rows), 'null', 'previous' or 'linear'; gaps are filled
    from `begin` to `end` (inclusive bounds on the key; by default those of the data). Linear filling
    needs a neighbour on both sides; integers are truncated, other types take the previous value. Rows
    with a null key are left out. More than `most` intervals of a series raise an error. With a `zone`
    intervals are counted in its local time, so a day begins at its midnight.
    """
    by = by or []
    if zone:
        local = lambda x: None if x is None else F.from_utc_timestamp(F.lit(x).cast("timestamp"), zone)
        got = range_group(df.withColumn(key, F.from_utc_timestamp(key, zone)), key, every, unit, aggs, by, offset, fill, local(begin), local(end), most)
        return got.withColumn(key, F.to_utc_timestamp(key, zone))
    if begin is not None:
        df = df.where(F.col(key) >= F.lit(begin))
    if end is not None:
        df = df.where(F.col(key) <= F.lit(end))
    df = df.where(F.col(key).isNotNull())
    got = df.groupBy(*by, bucket(key, every, unit, offset).alias(key)).agg(*[c.alias(n) for n, c in aggs.items()])
    if fill is None or fill.lower() == "none":
        return got
    return fill_gaps(got, key, every, unit, list(aggs), by, offset, fill, begin, end, most)


def fill_gaps(got: DataFrame, key: str, every: int, unit: str, values: list[str], by: list[str], offset: int, fill: str, begin=None, end=None, most: int = MOST_ROWS) -> DataFrame:
    """The missing intervals of (by, key, values), which has one row for each interval of `by`."""
    fill = fill.lower()
    if fill not in ("null", "previous", "linear"):
        raise ValueError(f"FILL({fill})")
    step = F.lit(micros(every, unit))
    series = Window.partitionBy(*by)
    order = series.orderBy(key)
    row = F.struct(key, *values)
    first, last = _us(F.min(key).over(series)), _us(F.max(key).over(series))
    low = first if begin is None else _us(bucket(F.lit(begin).cast("timestamp"), every, unit, offset))
    high = last if end is None else _us(bucket(F.lit(end).cast("timestamp"), every, unit, offset))
    # each row stands for the intervals up to the next row, the first one also for those before it
    out = got.select(*by, row.alias("_p"), F.lead(row).over(order).alias("_n"), (F.row_number().over(order) == 1).alias("_head"), low.alias("_low"), high.alias("_high"))
    count = F.call_function("div", F.col("_high") - F.col("_low"), step) + 1
    checked = F.when(count > most, F.raise_error(F.concat(F.lit(f"more than {most} intervals: "), count.cast("string"))).cast("bigint"))
    own = _us(F.col("_p")[key])
    until = F.coalesce(checked, _us(F.col("_n")[key]) - step, F.greatest("_high", own))
    points = F.sequence(F.when(F.col("_head"), F.least("_low", own)).otherwise(own), until, step)
    out = out.withColumn("_us", F.explode(points)).withColumn("_there", F.col("_us") == own).withColumn("_after", F.col("_us") >= own)
    kinds = {f.name: f.dataType for f in got.schema}
    made = []
    for v in values:
        before = F.when(F.col("_after"), F.col("_p")[v])
        if fill == "null":
            value = F.lit(None).cast(kinds[v])
        elif fill == "linear" and isinstance(kinds[v], NumericType):
            value = F.when(F.col("_after"), linear(own, F.col("_p")[v], _us(F.col("_n")[key]), F.col("_n")[v], F.col("_us"), kinds[v].simpleString()))
        else:
            value = before
        made.append(F.when(F.col("_there"), F.col("_p")[v]).otherwise(value).alias(v))
    return out.select(*by, _ts(F.col("_us")).alias(key), *made)


def linear(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, kind: str = "double") -> Column:
    """The line through (x1, y1) and (x2, y2) at x; null if any is null; integers are truncated."""
    y = y1.cast("double") + (x - x1) * (y2.cast("double") - y1.cast("double")) / F.nullif(x2 - x1, F.lit(0))
    return y.cast(kind)


def window_agg(df: DataFrame, time: str, value: str, how: str, start, end, n: int, unit: str) -> DataFrame:
    """TIME_WINDOW_AGG: MAX, MIN or AVG of `value` in intervals counted from `start`; `end` is included."""
    fns = {"MAX": F.max, "MIN": F.min, "AVG": F.avg}
    if how.upper() not in fns:
        raise ValueError(f"TIME_WINDOW_AGG of {how}")
    step, begin = micros(n, unit), _us(F.lit(start))
    df = df.where(F.col(time).between(F.lit(start), F.lit(end)))
    at = _ts(_us(time) - F.pmod(_us(time) - begin, F.lit(step)))
    return df.groupBy(at.alias(time)).agg(fns[how.upper()](value).alias(value))


# --- nearest rows and interpolation -----------------------------------------------------------


def time_next(df: DataFrame, time: str, at, only: bool = False) -> DataFrame:
    """The first row at or after `at` (`only`: after)."""
    c = F.col(time) > F.lit(at) if only else F.col(time) >= F.lit(at)
    return df.where(c).orderBy(F.col(time).asc()).limit(1)


def time_prev(df: DataFrame, time: str, at, only: bool = False) -> DataFrame:
    """The last row at or before `at` (`only`: before)."""
    c = F.col(time) < F.lit(at) if only else F.col(time) <= F.lit(at)
    return df.where(c).orderBy(F.col(time).desc()).limit(1)


def sample(df: DataFrame, time: str, start, end, n: int, unit: str, columns: list[str] | None = None, by: list[str] | None = None, mode: str = "linear", most: int = MOST_ROWS) -> DataFrame:
    """TIME_SAMPLING: rows at start, start + n units, ... up to `end`.

    A row at the very time is taken as it is; otherwise `columns` are linear between neighbours and the
    rest are the previous row's (`mode` 'previous': all). Points without a neighbour on a side are left
    out ('previous': without one before). 'empty': points without a row hold 0, '' or false.
    """
    by = by or []
    if mode not in ("linear", "previous", "empty"):
        raise ValueError(f"mode {mode}")
    columns = columns or []
    rest = [c for c in df.columns if c not in (time, *by)]
    kinds = {f.name: f.dataType for f in df.schema}
    for c in columns:
        if not isinstance(kinds[c], NumericType):
            raise ValueError(f"{c} is not numeric")
    df = _near(df.where(F.col(time).isNotNull()), time, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), by)
    step, begin = micros(n, unit), _us(F.lit(start).cast("timestamp"))
    cells = F.call_function("div", _us(F.lit(end).cast("timestamp")) - begin, F.lit(step))
    # one row per cell [point, next point): its first and its last row; rows before the first point are cell -1
    cell = F.when(_us(time) < begin, F.lit(-1)).otherwise(F.least(F.call_function("div", _us(time) - begin, F.lit(step)), cells + 1)).cast("long")
    row = F.struct(time, *rest)
    got = df.where(F.col(time).isNotNull()).groupBy(*by, cell.alias("_cell")).agg(F.min_by(row, F.col(time)).alias("_f"), F.max_by(row, F.col(time)).alias("_l"))
    checked = F.when(cells + 1 > most, F.raise_error(F.lit(f"more than {most} points")).cast("bigint")).otherwise(cells)
    grid = got.select(*by).distinct() if by else got.agg(F.count("*").alias("_c")).where("_c > 0").drop("_c")
    grid = grid.select(*[F.col(k).alias(f"_{k}") for k in by], F.explode(F.sequence(F.lit(-1).cast("long"), checked + 1)).alias("_point"))
    out = grid.join(got, _same(by) & (F.col("_point") == F.col("_cell")), "left")
    out = out.select(*[F.col(f"_{k}").alias(k) for k in by], "_point", "_f", "_l").withColumn("_at", begin + F.col("_point") * step)
    past = Window.partitionBy(*by).orderBy("_point").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*by).orderBy("_point").rowsBetween(0, Window.unboundedFollowing)
    exact = F.coalesce((F.col("_point") >= 0) & (_us(F.col("_f")[time]) == F.col("_at")), F.lit(False))
    out = out.withColumn("_p", F.last("_l", True).over(past)).withColumn("_n", F.first("_f", True).over(future)).withColumn("_exact", exact)
    out = out.where((F.col("_point") >= 0) & (F.col("_at") <= _us(F.lit(end).cast("timestamp"))))
    if mode == "linear":
        out = out.where(F.col("_exact") | (F.col("_p").isNotNull() & F.col("_n").isNotNull()))
    elif mode == "previous":
        out = out.where(F.col("_exact") | F.col("_p").isNotNull())
    made = []
    for c in rest:
        kind = kinds[c].simpleString()
        if mode == "empty":
            value = F.lit("" if kind == "string" else False if kind == "boolean" else 0).cast(kind) if kind in ("string", "boolean") or isinstance(kinds[c], NumericType) else F.lit(None).cast(kind)
        elif mode == "linear" and c in columns:
            value = linear(_us(F.col("_p")[time]), F.col("_p")[c], _us(F.col("_n")[time]), F.col("_n")[c], F.col("_at"), kind)
        else:
            value = F.col("_p")[c]
        made.append(F.when(F.col("_exact"), F.col("_f")[c]).otherwise(value).alias(c))
    return out.select(*by, _ts(F.col("_at")).alias(time), *made)


def _near(df: DataFrame, time: str, start: Column, end: Column, by: list[str]) -> DataFrame:
    """The rows of [start, end] and enough around them to hold each series' nearest row on either side.

    The nearest times come from an aggregate that reads `time` and `by` only; as bounds they then reach the scan.
    """
    sides = df.groupBy(*by).agg(F.max(F.when(F.col(time) < start, _us(time))).alias("a"), F.min(F.when(F.col(time) > end, _us(time))).alias("b"))
    low, high = sides.agg(F.min("a"), F.max("b")).first()
    return df.where((F.col(time) >= (start if low is None else _ts(F.lit(low)))) & (F.col(time) <= (end if high is None else _ts(F.lit(high)))))


def interpolate(df: DataFrame, time: str, column: str, at, by: list[str] | None = None) -> DataFrame:
    """TIME_INTERPOLATED: the row at `at`, `column` linear between neighbours, the others the previous row's."""
    return sample(df, time, at, at, 1, "MICROSECOND", [column], by)


# --- time-weighted averages, as-of joins ------------------------------------------------------

#: Width of the pieces into which a series without a key is cut.
PIECE_US = 24 * 3600 * 1_000_000


def neighbours(df: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """Adds _before and _after: the times of the previous and next row of the series.

    A series without a key is cut into days, whose ends are joined by a window over one row a day.
    """
    by = by or []
    if by:
        w = Window.partitionBy(*by).orderBy(time)
        return df.withColumn("_before", F.lag(time).over(w)).withColumn("_after", F.lead(time).over(w))
    df = df.withColumn("_piece", F.call_function("div", _us(time), F.lit(PIECE_US)))
    w = Window.partitionBy("_piece").orderBy(time)
    every = Window.orderBy("_p")
    ends = df.groupBy(F.col("_piece").alias("_p")).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    ends = ends.select("_p", F.lag("_hi").over(every).alias("_hi"), F.lead("_lo").over(every).alias("_lo"))
    df = df.withColumn("_b", F.lag(time).over(w)).withColumn("_a", F.lead(time).over(w)).join(ends, F.col("_piece") == F.col("_p"), "left")
    return df.withColumn("_before", F.coalesce("_b", "_hi")).withColumn("_after", F.coalesce("_a", "_lo")).drop("_b", "_a", "_hi", "_lo", "_p", "_piece")


def time_avg(df: DataFrame, time: str, value: str, by: list[str] | None = None, name: str = "time_avg") -> DataFrame:
    """TIME_AVG: each value weighs half the gap to either neighbour; of one row, its value."""
    by = by or []
    got = neighbours(df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(*by, time, value), time, by)
    weight = (_us(F.coalesce("_after", time)) - _us(F.coalesce("_before", time))) / 2.0
    v = F.col(value).cast("double")
    got = got.withColumn("_w", weight).groupBy(*by).agg(F.sum(v * F.col("_w")).alias("_vw"), F.sum("_w").alias("_w"), F.avg(v).alias("_avg"), F.count("*").alias("_n"))
    out = got.select(*by, F.when(F.col("_w") > 0, F.col("_vw") / F.nullif(F.col("_w"), F.lit(0.0))).otherwise(F.col("_avg")).alias(name), "_n")
    return out.where("_n > 0").drop("_n")


def asof_join(left: DataFrame, right: DataFrame, time: str, by: list[str], values: list[str], tolerance: tuple[int, str] | None = None) -> DataFrame:
    """`left` with the `values` of the last row of `right` with the same `by`, at or before its time.

    Both sides are put in one sequence, so that a key is shuffled once and no pairs are made. Of rows of
    `right` at one time the one of largest values wins. Beyond `tolerance` values are null.
    """
    columns = left.columns
    packed = F.struct(time, *values)
    r = right.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), packed.alias("_r"), *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in columns])
    l = left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_m", F.last("_r", True).over(w)).where("_side = 1")
    m = F.col("_m")
    if tolerance is not None:
        near = _us(F.col("_t")) - _us(F.col("_m")[time]) <= micros(*tolerance)
        return out.select(*[F.col(f"_l_{c}").alias(c) for c in columns], *[F.when(near, m[v]).alias(v) for v in values])
    return out.select(*[F.col(f"_l_{c}").alias(c) for c in columns], *[m[v].alias(v) for v in values])


def extreme_rows(df: DataFrame, column: str, largest: bool = True) -> DataFrame:
    """MAX_ROWS / MIN_ROWS: all rows with the extreme; none of an empty table."""
    top = df.agg((F.max if largest else F.min)(column).alias("_top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_top")).drop("_top")  # one row is broadcast


def expire(df: DataFrame, time: str, age: int, unit: str, now) -> DataFrame:
    """Rows no older than `age` units at `now`; rows without a time stay out."""
    return df.where(F.col(time) >= _ts(_us(F.lit(now)) - F.lit(micros(age, unit))))
