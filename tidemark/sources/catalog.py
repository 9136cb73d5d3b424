"""Tables of a folder, partitioned writes, and views of what the catalog holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import micros
from ..session import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Register the tables of a folder as temporary views."""
    found = {n: load(spark, sf_dir, n) for n in names or TABLES}
    for n, df in found.items():
        df.createOrReplaceTempView(n)
    return found


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The meta table of columns: table_name, column_name, ordinal (from 1), data_type, nullable."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, f.name, i, f.dataType.simpleString(), f.nullable) for n, df in tables.items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string, nullable boolean")


def tables_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The meta table of tables: table_name, n_columns."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(n, len(df.columns)) for n, df in tables.items()], "table_name string, n_columns int")


def indexes_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Indexes are access paths only and Parquet has none: an empty table with their columns."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([], "table_name string, column_name string, index_type string")


def write_partitioned(df: DataFrame, path: str, time: str | None = None, every: int = 1, unit: str = "DAY", hash_by: str | None = None, parts: int = 16, mode: str = "overwrite") -> None:
    """Interval, hash or interval and hash partitioning: derived columns in the path, which scans prune by.

    Rows are brought together by partition first, so that each has few files.
    """
    keys = []
    if time is not None:
        step = micros(every, unit)
        df = df.withColumn("_interval", F.call_function("div", F.unix_micros(F.col(time).cast("timestamp")), F.lit(step)))
        keys.append("_interval")
    if hash_by is not None:
        df = df.withColumn("_hash", F.pmod(F.xxhash64(hash_by), F.lit(parts)).cast("int"))
        keys.append("_hash")
    (df.repartition(*keys) if keys else df).write.mode(mode).partitionBy(*keys).parquet(path)


def read_partitioned(spark: SparkSession, path: str, time: str | None = None, start=None, end=None, every: int = 1, unit: str = "DAY") -> DataFrame:
    """Rows with start <= time <= end, from the interval partitions that can hold them."""
    df = spark.read.parquet(path)
    if time is not None:
        step = micros(every, unit)
        for bound, low in ((start, True), (end, False)):
            if bound is not None:
                at = F.call_function("div", F.unix_micros(F.lit(bound).cast("timestamp")), F.lit(step))
                df = df.where((F.col("_interval") >= at) & (F.col(time) >= F.lit(bound)) if low else (F.col("_interval") <= at) & (F.col(time) <= F.lit(bound)))
    return df.drop("_interval", "_hash")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; the schema is declared, never inferred."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
