"""Aggregates with the dialect's semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """TOTAL: a double, 0.0 of no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def variance0(x: Column) -> Column:
    """Sample variance, 0.0 of one row."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.var_samp(x))


def stddev0(x: Column) -> Column:
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def median(x: Column, kind: str = "double") -> Column:
    """In the type of the input: of integers the midpoint is truncated."""
    return F.median(x).cast(kind) if kind not in ("int", "bigint", "smallint", "tinyint") else F.median(x).cast("double").cast(kind)


def percentile_cont(x: Column, rate: float) -> Column:
    if not 0 <= rate <= 1:
        raise ValueError("a rate lies between 0 and 1")
    return F.percentile(x, rate)


def group_concat(x: Column, sep: str = "", order: Column | None = None, distinct: bool = False) -> Column:
    """Nulls are left out; nothing stands between values unless `sep` does. Without `order`, by value."""
    if distinct:
        return F.array_join(F.sort_array(F.collect_set(x)), sep)
    rows = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct((x if order is None else order).alias("o"), x.cast("string").alias("v")))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def first_by(x: Column, order: Column) -> Column:
    return F.min_by(x, order)


def last_by(x: Column, order: Column) -> Column:
    return F.max_by(x, order)
