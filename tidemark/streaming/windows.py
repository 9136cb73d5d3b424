"""Structured Streaming forms of the time-series operators: an extension, as rollups and retention go on for ever."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, every: str, aggs: dict[str, Column], by: list[str] | None = None, late: str = "10 minutes") -> DataFrame:
    """GROUP BY RANGE on a stream: rows later than the watermark are dropped, closed intervals leave the state."""
    got = stream.withWatermark(time, late).groupBy(F.window(time, every).alias("_w"), *(by or [])).agg(*[c.alias(n) for n, c in aggs.items()])
    return got.select(*(by or []), F.col("_w.start").alias(time), *aggs)


def sliding(stream: DataFrame, time: str, length: str, step: str, aggs: dict[str, Column], by: list[str] | None = None, late: str = "10 minutes") -> DataFrame:
    got = stream.withWatermark(time, late).groupBy(F.window(time, length, step).alias("_w"), *(by or [])).agg(*[c.alias(n) for n, c in aggs.items()])
    return got.select(*(by or []), F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *aggs)


def sessions(stream: DataFrame, time: str, gap: str, aggs: dict[str, Column], by: list[str], late: str = "10 minutes") -> DataFrame:
    got = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("_w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return got.select(*by, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *aggs)


def distinct_within(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key; the state of a key goes when the watermark passes it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert_sink(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run `apply(batch, number)` for each batch; `number` repeats after a failure, so that it can be applied once."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if once else writer).start()


def rollup_table(rollup: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Run an aggregated stream to its end into files under `path`; the latest row of each of `keys`.

    Each batch writes the groups that it changed to a folder of its own number, so a repeated batch replaces itself.
    """
    spark = rollup.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    upsert_sink(rollup, apply, f"{path}/state").awaitTermination()
    rows = spark.read.schema(rollup.schema.add("batch", "long")).parquet(f"{path}/rows")
    rest = [c for c in rollup.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
