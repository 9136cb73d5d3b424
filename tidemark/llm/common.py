"""What the operators share: the shared folder, written tables, Arrow mapping, components of links."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session on this machine alone may name none: it gets a temporary
    folder, which goes with the process. ValueError on a cluster without `spark.checkpoint.dir`."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # the setting itself can't be changed in a session that runs
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        d = "file://" + _own[app]
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(d)
    d = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub(r"^file:/+", "file:///", d).rstrip("/")  # a full URI, which Arrow reads too


#: Paths that were given out, in that order.
_given: list[str] = []


def new_dir(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    _given.append(f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    return f"{_given[-1]}/{name}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder. DataFrames that the operators returned read from it,
    so this comes after they were written."""
    _delete(spark, f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")


_last_step: dict[str, list[str]] = {}


@contextmanager
def step(spark: SparkSession, docs: DataFrame, last: bool = False) -> Iterator[None]:
    """One of several steps, each of which begins when the result of the one before is written: what that one left in
    the shared folder is deleted first, but for what `docs` itself reads. Only what steps wrote is; the last one's
    files stay for its result."""
    app = spark.sparkContext.applicationId
    if old := _last_step.pop(app, []):
        read = "\n".join(docs.inputFiles())
        for path in old:
            if path.rpartition("/")[2] not in read:
                _delete(spark, path)
    begin = len(_given)
    try:
        yield
    finally:
        if not last:
            _last_step[app] = _given[begin:]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names` with as many underscores before them as it takes to clash with no column of `df`, whatever the case."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def map_rows(df: DataFrame, schema: str, fn: Callable[..., dict], columns: list[str]) -> DataFrame:
    """`fn` takes one Python list for each of `columns` and gives lists by output name, a batch at a time."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small(batches):
            made = fn(*(part.column(i).to_pylist() for i in range(len(columns))))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Jobs inside send at most `rows` rows at a time to Python: for rows that hold several texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job inside go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes; a longer row comes alone. Memory of batches that are done goes back to the system."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
        del b
        release()
    release()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def release() -> None:
    """Hand back what Arrow and the C library keep for later: a worker lives on after its task, beside the next ones."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` evaluated once: a lambda's body would evaluate an outer expression for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node reaches over undirected `links`.

    Large-star and small-star rounds (Kiveris et al., 2014) over written tables; no link or
    component reaches the driver, only a count of changes. Links with a null end are left out,
    self links and repeats are harmless, no links give no rows.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small_.where("u <> v").distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
