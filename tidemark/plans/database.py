"""Statements that change tables, as text: CREATE, DROP, ALTER, INSERT, REPLACE, UPDATE, DELETE, and the meta tables.

A table is a DataFrame with the names of its key. Each change makes a new one, written to the session's shared
folder, so lineage doesn't grow with the statements and what was read before a change stays as it was. Queries and
EXPLAIN go to the dialect's front end. Indexes are access paths only: they are noted, and nothing reads them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import micros
from ..operators import dml
from ..session import work_dir
from ..sources import catalog
from .sql import _closing, _tops, rewrite, sql
from .tql import split_args

TYPES = {"BOOL": "boolean", "BOOLEAN": "boolean", "BYTE": "tinyint", "SHORT": "smallint", "INTEGER": "int", "INT": "int", "LONG": "bigint", "BIGINT": "bigint", "FLOAT": "float", "DOUBLE": "double", "STRING": "string", "VARCHAR": "string", "TEXT": "string", "TIMESTAMP": "timestamp", "BLOB": "binary", "GEOMETRY": "string"}
#: Meta tables of the running cluster, which has no counterpart here: they are empty.
RUNTIME = "trigger erasable event socket container_stats cluster_partition ra_stats statement_resources task_resources sync_stats sql partition_stats database_stats".split()
NAME = r"[\w.`]+"


def column_type(text: str) -> str:
    """TIMESTAMP(3) and STRING[] as Spark spells them."""
    m = re.fullmatch(r"(\w+)\s*(?:\([\d,\s]*\))?\s*((?:\[\])?)", text.strip())
    if not m or m[1].upper() not in TYPES:
        raise ValueError(f"type {text}")
    kind = TYPES[m[1].upper()]
    return f"array<{kind}>" if m[2] else kind


def _bound(expr: str, args: dict) -> Column:
    """An expression with `:name` parameters, which become literals."""
    spark = SparkSession.active()
    for k, v in args.items():
        own = spark.sql("SELECT typeof(:v) AS k, CAST(:v AS STRING) AS v", args={"v": v}).first()
        text = "NULL" if own["v"] is None else "'" + own["v"].replace("\\", "\\\\").replace("'", "\\'") + "'"
        expr = re.sub(rf"(?<!:):{k}\b", lambda _: f"CAST({text} AS {own['k']})", expr)
    return F.expr(rewrite(expr))


@dataclass
class Table:
    rows: DataFrame
    keys: list[str]
    kind: str = "collection"
    interval: tuple[str, int, str] | None = None  # column, n, unit
    hashed: tuple[str, int] | None = None
    indexes: dict[str, list[str]] = field(default_factory=dict)


class Database:
    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.views = spark, {}, {}

    def add(self, name: str, rows: DataFrame, keys: list[str], **more) -> None:
        """A table from rows there already."""
        self.tables[name] = Table(rows, keys, **more)
        rows.createOrReplaceTempView(name)

    def _change(self, name: str, rows: DataFrame) -> None:
        path = work_dir(self.spark, name)
        rows.write.parquet(path)
        self.tables[name].rows = self.spark.read.schema(rows.schema).parquet(path)
        self.tables[name].rows.createOrReplaceTempView(name)

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise ValueError(f"no table {name}")
        return self.tables[name]

    def run(self, text: str, **args) -> DataFrame | None:
        """Run one statement; rows for queries, nothing for changes."""
        text = text.strip().rstrip(";")
        for regex, act in self._STATEMENTS:
            if m := re.match(regex, text, re.I | re.S):
                return act(self, m, text[m.end() :].strip(), args)
        return sql(self.spark, text, **args)

    # --- definitions ----------------------------------------------------------------------------

    def _create(self, m, rest, args) -> None:
        name = m["name"]
        if name in self.tables:
            if m["if"]:
                return
            raise ValueError(f"table {name} exists")
        close = _closing(rest, 1)
        columns, keys = [], []
        for part in split_args(rest[1:close]):
            if k := re.fullmatch(r"primary\s+key\s*\((.+)\)", part, re.I | re.S):
                keys = [x.strip() for x in split_args(k[1])]
                continue
            c = re.match(r"(\w+)\s+(\w+(?:\s*\([\d,\s]*\))?(?:\[\])?)\s*(.*)$", part, re.S)
            columns.append(f"{c[1]} {column_type(c[2])}")
            if re.search(r"primary\s+key", c[3], re.I):
                keys.append(c[1])
        more = rest[close + 1 :]
        table = Table(self.spark.createDataFrame([], ", ".join(columns)), keys, "time_series" if re.search(r"using\s+timeseries", more, re.I) else "collection")
        if p := re.search(r"by\s+(?:range|interval)\s*\(?\s*(\w+)\s*\)?\s*every\s*\(\s*(\d+)\s*(?:,\s*(\w+)\s*)?\)", more, re.I):
            table.interval = (p[1], int(p[2]), p[3] or "")
        if p := re.search(r"by\s+hash\s*\(?\s*(\w+)\s*\)?\s*(?:sub)?partitions\s+(\d+)", more, re.I):
            table.hashed = (p[1], int(p[2]))
        self.tables[name] = table
        table.rows.createOrReplaceTempView(name)

    def _create_view(self, m, rest, args) -> None:
        if m["name"] in self.views and not m["or"]:
            raise ValueError(f"view {m['name']} exists")
        self.views[m["name"]] = rest
        sql(self.spark, rest, **args).createOrReplaceTempView(m["name"])

    def _create_index(self, m, rest, args) -> None:
        self._table(m["table"]).indexes[m["name"]] = split_args(rest[1 : _closing(rest, 1)])

    def _drop(self, m, rest, args) -> None:
        kind, name = m["kind"].lower(), m["name"]
        if kind == "index":
            for t in self.tables.values():
                if t.indexes.pop(name, None) is not None:
                    return
        else:
            if (self.tables if kind == "table" else self.views).pop(name, None) is not None:
                self.spark.catalog.dropTempView(name)
                return
        if not m["if"]:
            raise ValueError(f"no {kind} {name}")

    def _alter(self, m, rest, args) -> None:
        name, t = m["name"], self._table(m["name"])
        if a := re.match(r"add\s+(?:column\s+)?(\w+)\s+(.+?)(?:\s+default\s+(.+))?$", rest, re.I | re.S):
            self._change(name, t.rows.withColumn(a[1], F.expr(rewrite(a[3] or "null")).cast(column_type(a[2]))) if a[1] not in t.rows.columns else dml.add_column(t.rows, a[1], "string"))
        elif a := re.match(r"rename\s+column\s+(\w+)\s+to\s+(\w+)$", rest, re.I):
            self._change(name, dml.rename_column(t.rows, a[1], a[2]))
            t.keys = [a[2] if k == a[1] else k for k in t.keys]
        elif a := re.match(r"drop\s+partition\s+for\s*\((.+)\)$", rest, re.I | re.S):
            if not t.interval:
                raise ValueError(f"{name} isn't partitioned by intervals")
            column, n, unit = t.interval
            numeric = not unit
            step = n if numeric else micros(n, unit)
            at = f"cast({rewrite(a[1])} AS BIGINT)" if numeric else f"unix_micros(cast({rewrite(a[1])} AS TIMESTAMP))"
            value = self.spark.sql(f"SELECT {at}", args=args or None).first()[0]
            low = value - value % step
            bound = (lambda x: F.lit(x)) if numeric else (lambda x: F.timestamp_micros(F.lit(x)))
            self._change(name, dml.delete(t.rows, (F.col(column) >= bound(low)) & (F.col(column) < bound(low + step))))
        else:
            raise ValueError(f"ALTER TABLE {name} {rest}")

    # --- rows -----------------------------------------------------------------------------------

    def _insert(self, m, rest, args) -> None:
        name, t = m["name"], self._table(m["name"])
        columns = t.rows.columns
        if rest.startswith("("):
            close = _closing(rest, 1)
            columns, rest = split_args(rest[1:close]), rest[close + 1 :].strip()
        rows = sql(self.spark, rest, **args)
        if len(rows.columns) != len(columns):
            raise ValueError(f"{len(rows.columns)} values for {len(columns)} columns")
        rows = rows.toDF(*columns)
        rows = rows.select(*[(F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.rows.schema])
        way = (m["how"] or ("replace" if m["verb"].lower() == "replace" else "")).lower()
        if not t.keys:
            self._change(name, dml.insert(t.rows, rows))
        elif "ignore" in way:
            self._change(name, dml.insert_or_ignore(t.rows, rows, t.keys))
        else:  # a row with a key that is there replaces it, in plain INSERT too
            self._change(name, dml.upsert(t.rows, rows, t.keys))

    def _update(self, m, rest, args) -> None:
        name, t = m["name"], self._table(m["name"])
        at = _tops(rest, r"\bwhere\b")
        sets, where = (rest[: at[0].start()], rest[at[0].end() :]) if at else (rest, "true")
        values = {}
        for s in split_args(sets):
            a = re.match(r"(\w+)\s*=\s*(.+)$", s, re.S)
            if not a or a[1] not in t.rows.columns:
                raise ValueError(f"SET {s}")
            if a[1] in t.keys:
                raise ValueError(f"{a[1]} is the key")
            values[a[1]] = _bound(a[2], args)
        where = _bound(where, args)
        self._change(name, dml.update(t.rows, where, values))

    def _delete(self, m, rest, args) -> None:
        where = re.sub(r"^where\b", "", rest, flags=re.I).strip() or "true"
        self._change(m["name"], dml.delete(self._table(m["name"]).rows, _bound(where, args)))

    _STATEMENTS = [
        (rf"create\s+table\s+(?P<if>if\s+not\s+exists\s+)?(?P<name>{NAME})\s*(?=\()", _create),
        (rf"create\s+(?P<or>or\s+replace\s+|force\s+)?view\s+(?P<name>{NAME})\s+as\b", _create_view),
        (rf"create\s+index\s+(?:if\s+not\s+exists\s+)?(?P<name>{NAME})\s+on\s+(?P<table>{NAME})\s*(?=\()", _create_index),
        (rf"drop\s+(?P<kind>table|view|index)\s+(?P<if>if\s+exists\s+)?(?P<name>{NAME})", _drop),
        (rf"alter\s+table\s+(?P<name>{NAME})\s", _alter),
        (rf"(?P<verb>insert|replace)\s+(?P<how>or\s+(?:replace|ignore)\s+)?into\s+(?P<name>{NAME})", _insert),
        (rf"update\s+(?P<name>{NAME})\s+set\b", _update),
        (rf"delete\s+from\s+(?P<name>{NAME})", _delete),
    ]

    # --- what there is --------------------------------------------------------------------------

    def meta(self, kind: str) -> DataFrame:
        """A meta table: container, column, key, index, view, partition or database; those of a running cluster are empty."""
        if kind in RUNTIME:
            return self.spark.createDataFrame([], "name string, value string")
        tables = {n: t.rows for n, t in self.tables.items()}
        made = {
            "container": ("table_name string, kind string, n_columns int", lambda: [(n, t.kind, len(t.rows.columns)) for n, t in self.tables.items()]),
            "key": ("table_name string, column_name string, ordinal int", lambda: [(n, k, i) for n, t in self.tables.items() for i, k in enumerate(t.keys, 1)]),
            "index": ("table_name string, index_name string, column_name string, ordinal int", lambda: [(n, x, c, i) for n, t in self.tables.items() for x, cs in t.indexes.items() for i, c in enumerate(cs, 1)]),
            "view": ("view_name string, definition string", lambda: list(self.views.items())),
            "partition": ("table_name string, kind string, column_name string, n long, unit string", lambda: [(n, *p) for n, t in self.tables.items() for p in ((("interval", *t.interval),) if t.interval else ()) + ((("hash", *t.hashed, ""),) if t.hashed else ())]),
            "database": ("name string", lambda: [("public",)]),
        }
        if kind == "column":
            return catalog.columns_of(tables) if tables else self.spark.createDataFrame([], "table_name string, column_name string, ordinal int, data_type string, nullable boolean")
        if kind not in made:
            raise ValueError(f"meta table {kind}")
        schema, rows = made[kind]
        return self.spark.createDataFrame(rows(), schema)
