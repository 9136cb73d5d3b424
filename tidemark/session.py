"""Sessions, and the package's own code on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: dict[str, str] = {}


def session(name: str = "tidemark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name, dots as double underscores."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application: they may not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("tidemark") / p.relative_to(root))
    spark.sparkContext.addPyFile(out)
    _shipped[app] = out


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path for intermediate files in the shared folder that `spark.checkpoint.dir` names; only a session on this
    machine alone may name none and gets a temporary folder. ValueError on a cluster without one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tidemark-work-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    return f"{d.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


TIMES = {"events": ["ts"], "orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its times as TIMESTAMP: Parquet without a zone loads as TIMESTAMP_NTZ."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for c in TIMES.get(name, []):
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df
