"""Row pattern recognition (MATCH_RECOGNIZE).

DEFINE conditions are column expressions, with `prev` and `next_` for neighbouring rows, and are evaluated
by Spark: each row carries the bits of the variables it satisfies. The pattern is compiled to a small
automaton that runs over the sorted rows of a partition as they stream by; greedy alternatives come
first, as in the standard, and matches don't overlap (SKIP PAST LAST ROW). `islands` is a shorter way for
runs of mutually exclusive variables one after the other, in window expressions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|(\{\s*(\d*)\s*(,?)\s*(\d*)\s*\})|([()|*+?^$]))")


@dataclass
class Program:
    """Instructions: ('var', bit), ('split', a, b) preferring a, ('jump', a), ('start',), ('end',), ('match',)."""

    code: list[tuple]
    variables: list[str]


def compile_pattern(pattern: str) -> Program:
    """Variables, juxtaposition, `|`, parentheses, `* + ? {n} {n,m} {n,} {,m}`, `^` and `$`; all greedy."""
    tokens, at = [], 0
    pattern = pattern.strip()
    while at < len(pattern):
        m = TOKEN.match(pattern, at)
        if not m:
            raise ValueError(f"pattern at {pattern[at:]!r}")
        tokens.append(m)
        at = m.end()
    names: list[str] = []
    pos = 0

    def peek() -> str:
        return (tokens[pos][6] or ("{" if tokens[pos][2] else "v")) if pos < len(tokens) else ""

    def alternatives():
        nonlocal pos
        parts = [sequence()]
        while peek() == "|":
            pos += 1
            parts.append(sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence():
        parts = []
        while peek() and peek() not in ")|":
            parts.append(repeated())
        return ("seq", parts)

    def repeated():
        nonlocal pos
        node = single()
        while peek() in ("*", "+", "?", "{"):
            m = tokens[pos]
            pos += 1
            if m[2]:
                low = int(m[3] or 0)
                high = (int(m[5]) if m[5] else None) if m[4] else low
                if high is not None and high < low:
                    raise ValueError(f"quantifier {m[2]}")
            else:
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[6]]
            node = ("rep", node, low, high)
        return node

    def single():
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("the pattern ends too early")
        m = tokens[pos]
        pos += 1
        if m[1]:
            if m[1] not in names:
                names.append(m[1])
            return ("var", names.index(m[1]))
        if m[6] == "(":
            node = alternatives()
            if peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            pos += 1
            return node
        if m[6] in ("^", "$"):
            return ("start",) if m[6] == "^" else ("end",)
        raise ValueError(f"pattern at {m[0]!r}")

    tree = alternatives()
    if pos < len(tokens):
        raise ValueError(f"pattern at {tokens[pos][0]!r}")
    code: list[tuple] = []

    def emit(node) -> None:
        kind = node[0]
        if kind in ("var", "start", "end"):
            code.append(node)
        elif kind == "seq":
            for n in node[1]:
                emit(n)
        elif kind == "or":
            jumps = []
            for n in node[1][:-1]:
                split = len(code)
                code.append(("split", split + 1, -1))
                emit(n)
                jumps.append(len(code))
                code.append(("jump", -1))
                code[split] = ("split", split + 1, len(code))
            emit(node[1][-1])
            for j in jumps:
                code[j] = ("jump", len(code))
        else:
            _, inner, low, high = node
            for _ in range(low):
                emit(inner)
            if high is None:
                split = len(code)
                code.append(("split", split + 1, -1))
                emit(inner)
                code.append(("jump", split))
                code[split] = ("split", split + 1, len(code))
            else:
                splits = []
                for _ in range(high - low):
                    splits.append(len(code))
                    code.append(("split", len(code) + 1, -1))
                    emit(inner)
                for s in splits:
                    code[s] = ("split", s + 1, len(code))

    emit(tree)
    code.append(("match",))
    return Program(code, names)


#: Steps of open matches that a partition may hold, at a row, before it is an error; as the reference's memory limit.
MOST_OPEN = 50_000_000


def match_masks(program: Program, masks: list[int]) -> list[tuple[int, list[int]]]:
    """(first row, variable of each row) of the matches in one partition: leftmost, greedy, not overlapping.

    One pass: threads are kept in order of preference, and while nothing has matched each row starts one more, the
    least preferred, so a row is looked at once for each instruction, whatever fails. After a match the pass goes on
    from its end. Empty matches are skipped. MemoryError beyond MOST_OPEN rows of open matches.
    """
    out, n, code = [], len(masks), program.code

    def follow(pc: int, i: int, path, threads: list, seen: set) -> None:
        stack = [pc]
        while stack:
            pc = stack.pop()
            if pc in seen:
                continue
            seen.add(pc)
            op = code[pc]
            if op[0] == "jump":
                stack.append(op[1])
            elif op[0] == "split":
                stack += (op[2], op[1])
            elif op[0] == "start":
                if i == 0:
                    stack.append(pc + 1)
            elif op[0] == "end":
                if i == n:
                    stack.append(pc + 1)
            else:
                threads.append((pc, path))

    # a path is (variable, path before, first row, rows)
    i, threads, best = 0, [], None
    seen: set = set()
    while True:
        if best is None and i < n:
            follow(0, i, None, threads, seen)
        after: list = []
        seen = set()
        for pc, path in threads:
            if code[pc][0] == "match":
                if path is not None:
                    best = path
                    break
            elif i < n and masks[i] >> code[pc][1] & 1:
                step = (code[pc][1], path, i, 1) if path is None else (code[pc][1], path, path[2], path[3] + 1)
                if step[3] * len(threads) > MOST_OPEN:
                    raise MemoryError(f"more than {MOST_OPEN} rows of open matches")
                follow(pc + 1, i + 1, step, after, seen)
        threads, i = after, i + 1
        if best is not None and not threads:
            begin, size, found = best[2], best[3], []
            path = best
            while path is not None:
                found.append(path[0])
                path = path[1]
            out.append((begin, found[::-1]))
            i, best, seen = begin + size, None, set()
        if i > n or (i == n and not threads and best is None):
            break
    return out


def _window(partition_by: list[str], order_by: list[str]):
    return Window.partitionBy(*partition_by).orderBy(*order_by)


def prev(column: str, partition_by: list[str], order_by: list[str], n: int = 1) -> Column:
    """PREV(column, n) for DEFINE conditions."""
    return F.lag(column, n).over(_window(partition_by, order_by))


def next_(column: str, partition_by: list[str], order_by: list[str], n: int = 1) -> Column:
    return F.lead(column, n).over(_window(partition_by, order_by))


def match_rows(df: DataFrame, partition_by: list[str], order_by: list[str], pattern: str, define: dict[str, Column]) -> DataFrame:
    """ALL ROWS PER MATCH: the matched rows with match_number (from 1 in each partition) and classifier.

    A variable without a definition is always true; a null condition is false. Partitions are spread over
    tasks and sorted there; one partition of masks is in memory at a time.
    """
    program = compile_pattern(pattern)
    if unknown := set(define) - set(program.variables):
        raise ValueError(f"{sorted(unknown)} aren't in the pattern")
    bits = F.lit(0).cast("long")
    for i, v in enumerate(program.variables):
        own = F.coalesce(define[v], F.lit(False)) if v in define else F.lit(True)
        bits = bits + F.when(own, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    columns = df.columns
    rows = df.withColumn("_mask", bits)
    # the windows of PREV and NEXT already sort each partition; without any the sort is asked for here
    rows = rows.repartition(*partition_by).sortWithinPartitions(*partition_by, *order_by) if partition_by else rows.coalesce(1).sortWithinPartitions(*order_by)
    keys = [columns.index(k) for k in partition_by]
    schema = df.schema.add("match_number", "long").add("classifier", "string")

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            take, number, names = [], [], []
            for k, (begin, path) in enumerate(match_masks(program, t.column(len(columns)).to_pylist()), 1):
                take += range(begin, begin + len(path))
                number += [k] * len(path)
                names += [program.variables[v] for v in path]
            if take:
                got = t.select(range(len(columns))).take(pa.array(take, pa.int64()))
                got = got.append_column("match_number", pa.array(number, pa.int64())).append_column("classifier", pa.array(names, pa.string()))
                yield from got.combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            own = list(zip(*(b.column(i).to_pylist() for i in keys))) if keys else [()] * b.num_rows
            cut = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for s, e in zip(cut, cut[1:]):
                if held and own[s] != key:
                    yield from close()
                    held.clear()
                key = own[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from close()

    return rows.mapInArrow(run, schema)


def match_recognize(df: DataFrame, partition_by: list[str], order_by: list[str], pattern: str, define: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """ONE ROW PER MATCH: (partition_by..., match_number, measures...). Measures are aggregates of the match's
    rows; `first` and `last` of this module give FIRST(v.column) and LAST(v.column)."""
    rows = match_rows(df, partition_by, order_by, pattern, define)
    return rows.groupBy(*partition_by, "match_number").agg(*[c.alias(n) for n, c in measures.items()])


def first(column: str, order_by: list[str], variable: str | None = None) -> Column:
    of = F.struct(*order_by)
    return F.min_by(column, of if variable is None else F.when(F.col("classifier") == variable, of))


def last(column: str, order_by: list[str], variable: str | None = None) -> Column:
    of = F.struct(*order_by)
    return F.max_by(column, of if variable is None else F.when(F.col("classifier") == variable, of))


def islands(df: DataFrame, partition_by: list[str], order_by: list[str], letters: dict[str, Column], sequence: list[str]) -> DataFrame:
    """(partition_by..., match_number, length, first_*, last_* of order_by): matches of a pattern like `UP+ DOWN+`, one or
    more rows of each variable in `sequence` in turn, for variables that exclude each other and occur once.

    Rows of one variable in a row are an island; islands are single rows after one aggregation, and neighbours are
    compared by windows, so no series is held in memory. Of conditions true together the first in `letters` counts.
    """
    if len(set(sequence)) != len(sequence) or not set(sequence) <= set(letters):
        raise ValueError("each variable of the sequence must be defined and stand once")
    letter = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(x)) for x, c in letters.items()], F.lit(""))
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    rows = df.select(*partition_by, *order_by, letter.alias("_c"))
    rows = rows.withColumn("_new", F.when(F.coalesce(F.lag("_c").over(w) == F.col("_c"), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order_by)
    got = rows.groupBy(*partition_by, "_island").agg(F.first("_c").alias("_c"), F.count("*").alias("_k"), F.min(at).alias("_f"), F.max(at).alias("_l"))
    w = Window.partitionBy(*partition_by).orderBy("_island")
    hit, size, last_ = F.lit(True), F.col("_k"), F.col("_l")
    for i, x in enumerate(sequence):
        hit = hit & F.coalesce((F.lead("_c", i).over(w) if i else F.col("_c")) == x, F.lit(False))
        if i:
            size, last_ = size + F.lead("_k", i).over(w), F.lead("_l", i).over(w)
    got = got.select(*partition_by, "_island", hit.alias("_hit"), size.alias("length"), "_f", last_.alias("_l")).where("_hit")
    return got.select(*partition_by, F.row_number().over(w).cast("long").alias("match_number"), F.col("length").cast("long").alias("length"), *[F.col("_f")[c].alias(f"first_{c}") for c in order_by], *[F.col("_l")[c].alias(f"last_{c}") for c in order_by])
