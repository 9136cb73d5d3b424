"""Changes of tables as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last(rows: DataFrame, keys: list[str], order: Column | None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy((order if order is not None else F.xxhash64(*rows.columns)).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """INSERT OR REPLACE: rows of `target` with a key of `rows` are replaced; of repeated keys in `rows` the last by `order` counts."""
    new = _last(rows.select(*target.columns), keys, order)
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Only rows whose key `target` doesn't have. Of the target's keys only those that are new rows' too are put in order."""
    new = _last(rows.select(*target.columns), keys, order)
    there = target.select(*keys).join(new.select(*keys), keys, "left_semi").distinct()
    return target.unionByName(new.join(there, keys, "left_anti"))


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows.select(*target.columns))


def update(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE: all new values see the old row; a condition of null leaves it."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, values[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    """DELETE: a condition of null keeps the row."""
    return target.where(~F.coalesce(where, F.lit(False)))


def multi_get(tables: dict[str, DataFrame], key: str, keys: list) -> DataFrame:
    """Rows of several tables by key, with the table's name in `container`."""
    parts = [df.where(F.col(key).isin(keys)).withColumn("container", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def multi_put(tables: dict[str, DataFrame], rows: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Rows for several tables at once; each replaces those with its key."""
    if unknown := set(rows) - set(tables):
        raise ValueError(f"no tables {sorted(unknown)}")
    return {n: upsert(df, rows[n], keys[n]) if n in rows else df for n, df in tables.items()}


def add_column(target: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """ALTER TABLE ADD COLUMN: rows there already hold the default."""
    if name in target.columns:
        raise ValueError(f"column {name} exists")
    return target.withColumn(name, F.lit(default).cast(kind))


def rename_column(target: DataFrame, old: str, new: str) -> DataFrame:
    """ALTER TABLE RENAME COLUMN."""
    if old not in target.columns or new in target.columns:
        raise ValueError(f"can't rename {old} to {new}")
    return target.withColumnRenamed(old, new)


def drop_partition(target: DataFrame, time: str, start, end) -> DataFrame:
    """DROP PARTITION FOR: the rows of an interval [start, end) go; rows without a time stay."""
    return delete(target, (F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
