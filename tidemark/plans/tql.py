"""A small front end for single-container queries: SELECT what FROM container WHERE ... ORDER BY ... LIMIT ....

`what` is `*`, one aggregate (of which TIME_AVG and the sample statistics have rules of their own) or one
time-series selection. Conditions go to Spark SQL after the few forms that differ are rewritten.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import gis as G
from ..operators import relational, timeseries

CLAUSES = re.compile(r"^\s*select\s+(?P<what>.+?)(?:\s+from\s+(?P<from>[\w.]+))?(?:\s+where\s+(?P<where>.+?))?(?:\s+order\s+by\s+(?P<order>.+?))?(?:\s+limit\s+(?P<limit>\d+)(?:\s+offset\s+(?P<offset>\d+))?)?\s*;?\s*$", re.I | re.S)
CALL = re.compile(r"^(\w+)\s*\((.*)\)$", re.S)
TIMESTAMP = re.compile(r"\btimestamp(?:_ms|_us)?\s*\(\s*('[^']*')\s*\)", re.I)


def split_args(text: str) -> list[str]:
    """At commas outside parentheses and quotes."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
        elif not quoted and c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()] if text.strip() else []


def rewrite(text: str) -> str:
    """Forms of conditions that Spark SQL spells otherwise."""
    text = TIMESTAMP.sub(lambda m: f"TIMESTAMP {m[1]}", text)
    text = re.sub(r"\btimestamp_?add\s*\(\s*(\w+)\s*,", r"timestampadd(\1,", text, flags=re.I)
    text = re.sub(r"(\([^()]*\)|[\w.]+\s*(?:[<>=]+)\s*[\w.']+|\w+)\s+xor\s+(\([^()]*\)|[\w.]+\s*(?:[<>=]+)\s*[\w.']+|\w+)", r"((\1) != (\2))", text, flags=re.I)
    text = re.sub(r"\bto_timestamp_ms\s*\(", "timestamp_millis(", text, flags=re.I)
    text = re.sub(r"\bto_epoch_ms\s*\(", "unix_millis(", text, flags=re.I)
    text = re.sub(r"\bnow\s*\(\s*\)", "date_trunc('MILLISECOND', current_timestamp())", text, flags=re.I)
    text = re.sub(r"\barray_length\s*\(", "size(", text, flags=re.I)
    text = re.sub(r"\belement\s*\(\s*(\d+)\s*,\s*(\w+)\s*\)", r"\2[\1]", text, flags=re.I)
    return text


def _time(text: str):
    m = re.fullmatch(r"(?:timestamp(?:_ms|_us)?\s*\(\s*)?'([^']*)'\s*\)?", text.strip(), re.I)
    if not m:
        raise ValueError(f"a time is needed, not {text!r}")
    return F.lit(m[1]).cast("timestamp")


NUMBERS = ("ST_MAKERECT", "ST_MAKEBOX", "ST_MAKEPLANE", "ST_MAKESPHERE", "ST_MAKECYLINDER", "ST_MAKECONE", "ST_MAKEQSF")


def _geometry(text: str):
    """A geometry argument: a box as a column, or the coefficients of a quadratic surface as a list."""
    text = text.strip()
    call = CALL.match(text)
    if not call:
        return G.box(F.expr(text)) if not re.match(r"'\s*quadraticsurface", text, re.I) else G.surface(text.strip("'"))
    name, args = call[1].upper(), split_args(call[2])
    if name == "ST_GEOMFROMTEXT":
        return _geometry(args[0])
    if name not in NUMBERS:
        raise ValueError(f"geometry {text}")
    v = [float(x) for x in args]
    if name in ("ST_MAKERECT", "ST_MAKEBOX"):
        return (G.make_rect if name == "ST_MAKERECT" else G.make_box)(*[F.lit(x) for x in v])
    return {"ST_MAKEPLANE": G.plane, "ST_MAKESPHERE": G.sphere, "ST_MAKECYLINDER": G.cylinder, "ST_MAKECONE": G.cone, "ST_MAKEQSF": G.qsf}[name](*v)


def _spatial(text: str):
    """ST_MBRINTERSECTS and ST_QSFMBRINTERSECTS as conditions."""
    m = re.fullmatch(r"\s*(st_mbrintersects|st_qsfmbrintersects)\s*\((.*)\)\s*", text, re.I | re.S)
    if not m:
        return None
    a, b = (_geometry(x) for x in split_args(m[2]))
    if m[1].lower() == "st_mbrintersects":
        return G.intersects(a, b)
    return G.quadratic_intersects(a, b) if isinstance(a, list) else G.quadratic_intersects(b, a)


def tql(spark: SparkSession, text: str, container: DataFrame | None = None, time: str | None = None) -> DataFrame:
    """Run one query; `container` stands in for FROM, `time` names the row key of a time series."""
    m = CLAUSES.match(text)
    if not m:
        raise ValueError(f"not a query: {text!r}")
    df = container if container is not None else spark.table(m["from"])
    # conditions on geometries stand among others that must hold
    for part in re.split(r"\s+and\s+(?=st_)|(?<=\))\s+and\s+", m["where"] or "", flags=re.I) if re.search(r"\bst_\w*intersects\s*\(", m["where"] or "", re.I) else [m["where"]] if m["where"] else []:
        spatial = _spatial(part)
        df = df.where(rewrite(part) if spatial is None else spatial)
    what = m["what"].strip()
    call = CALL.match(what)
    if what != "*":
        if not call:
            raise ValueError("SELECT takes * or one function")
        df = _select(df, call[1].upper(), split_args(call[2]), time)
    if m["order"]:
        keys = [(p.split()[0], p.split()[1] if len(p.split()) > 1 else "asc") for p in split_args(m["order"])]
        df = relational.order(df, *keys)
    return relational.limit(df, int(m["limit"]), int(m["offset"] or 0)) if m["limit"] else df


def _select(df: DataFrame, name: str, args: list[str], time: str | None) -> DataFrame:
    simple = {"SUM": F.sum, "AVG": F.avg, "MAX": F.max, "MIN": F.min, "COUNT": F.count, "VARIANCE_POP": F.var_pop, "STDDEV_POP": F.stddev_pop, "VARIANCE": A.variance0, "VARIANCE_SAMP": A.variance0, "STDDEV": A.stddev0, "STDDEV_SAMP": A.stddev0, "MEDIAN": F.median}
    if name in simple:
        column = F.lit(1) if args[0] == "*" else F.col(args[0])
        return df.agg(simple[name](column).alias(name.lower()))
    if name in ("MAX_ROWS", "MIN_ROWS"):
        return timeseries.extreme_rows(df, args[0], name == "MAX_ROWS")
    if time is None:
        raise ValueError(f"{name} needs a time series")
    if name == "TIME_AVG":
        return timeseries.time_avg(df, time, args[0])
    if name in ("TIME_NEXT", "TIME_NEXT_ONLY"):
        return timeseries.time_next(df, time, _time(args[1]), name.endswith("ONLY"))
    if name in ("TIME_PREV", "TIME_PREV_ONLY"):
        return timeseries.time_prev(df, time, _time(args[1]), name.endswith("ONLY"))
    if name == "TIME_INTERPOLATED":
        return timeseries.interpolate(df, time, args[0], _time(args[1]))
    if name == "TIME_SAMPLING":
        columns = [] if args[0] == "*" else [args[0]]
        return timeseries.sample(df, time, _time(args[1]), _time(args[2]), int(args[3]), args[4], columns)
    if name == "TIME_WINDOW_AGG":
        return timeseries.window_agg(df, time, args[0], args[1].strip("'"), _time(args[2]), _time(args[3]), int(args[4]), args[5])
    raise ValueError(f"function {name}")
