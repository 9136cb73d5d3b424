"""Secret scans over a trigram index, in DataFrame expressions only.

Each rule's regular expression yields a Boolean query of trigrams that any match must hold. The inverted
index holds the postings (trigram, document) of all trigrams that queries name. A query's postings are
intersected by joining the index to the table of queries and counting, by document, the trigrams of each
way, then the clauses met. Only a rule's candidates are scanned with its expression; a rule without
mandatory trigrams scans all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let


@dataclass(frozen=True)
class Rule:
    """`pattern` is read alike by Java and Python; a match counts if its group `group` has `least` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # runs are maximal, so asking for the length in the expression drops just the runs that are too short
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE + (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
#: Strings that one part of an expression may stand for before the analysis gives up on it.
MOST = 64
#: A query: a conjunction of disjunctions of conjunctions of trigrams.
Query = list[frozenset[frozenset[str]]]


def _strings(items) -> set[str] | None:
    """All strings that a sequence matches, if they are few."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            own = {chr(arg).lower()}
        elif op is sre.IN:
            own = set()
            for o, a in arg:
                if o is sre.LITERAL:
                    own.add(chr(a).lower())
                elif o is sre.RANGE and a[1] - a[0] < 6:
                    own |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
        elif op is sre.SUBPATTERN:
            own = _strings(arg[3])
        elif op is sre.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            own = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 8:
            once = _strings(arg[2])
            own = None if once is None else set()
            if own is not None:
                now = {""}
                for i in range(arg[1] + 1):
                    own |= now if i >= arg[0] else set()
                    now = {a + b for a in now for b in once}
                    if len(now) > MOST:
                        return None
        else:
            return None
        if own is None:
            return None
        out = {a + b for a in out for b in own}
        if len(out) > MOST:
            return None
    return out


def query(pattern: str) -> Query:
    """The trigrams (of lower-case text) that every match holds; empty if none are mandatory."""
    made: Query = []

    def flush(strings: set[str]) -> None:
        ways = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in ways:
            made.append(frozenset(w for w in ways if not any(v < w for v in ways)))

    def walk(items) -> None:
        run: set[str] = {""}
        for item in items:
            op, arg = item
            own = _strings([item])
            joined = None if own is None else {a + b for a in run for b in own}
            if joined is not None and len(joined) <= MOST:
                run = joined
                continue
            flush(run)
            run = own or {""}
            if own is None:
                if op is sre.SUBPATTERN:
                    walk(arg[3])
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                    walk(arg[2])
        flush(run)

    walk(list(parser.parse(pattern)))
    return made


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches, by the lengths of matches and of what is between them."""
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.zip_with(F.transform(between, F.char_length), F.zip_with(F.transform(found, F.char_length), F.transform(counted, F.char_length), lambda n, c: F.struct(n.alias("n"), c.alias("c"))), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    kind = "array<struct<start:int,end:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["m"]["n"], F.lit(0))
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["m"]["c"] >= rule.least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(parts, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def _kinded(i: int):  # a lambda with a default would be taken for one with an index
    return lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"))


def _is(i: int):
    return lambda x: x["kind"] == i


def index(docs: DataFrame, keys: list[str], text_col: str, grams: list[str]) -> DataFrame:
    """The inverted index: (gram, keys) for each of `grams` and each document whose lower-case text holds it, once."""
    has = let(F.lower(text_col), lambda low: F.filter(F.array(*[F.lit(t) for t in grams]), lambda t: F.contains(low, t)))
    return docs.select(F.explode(has).alias("gram"), *keys).distinct()


def candidates(docs: DataFrame, keys: list[str], text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(keys, rules): the numbers of the rules whose trigram queries the document meets; documents with none are left out.

    A way is a set of trigrams that a text must hold together, a clause a choice of ways, a query all its clauses.
    The table of queries has a row for each trigram of each way, so it grows with the rules alone and is broadcast.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := query(r.pattern))}
    rows = [(t, i, c, w, len(way), len(q)) for i, q in queries.items() for c, clause in enumerate(q) for w, way in enumerate(sorted(clause, key=sorted)) for t in sorted(way)]
    if not rows:
        return docs.select(*keys, F.array().cast("array<int>").alias("met")).where(F.lit(False))
    names = ("gram", "rule", "clause", "way", "grams", "clauses")
    asked = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))
    postings = index(docs, keys, text_col, sorted({r[0] for r in rows}))
    # a document's few postings lie together, so that none of the groupings moves them again
    found = postings.repartition(*keys).join(F.broadcast(asked), "gram")
    ways = found.groupBy(*keys, "rule", "clause", "way").agg(F.count("*").alias("n"), F.first("grams").alias("grams"), F.first("clauses").alias("clauses")).where("n = grams")
    met = ways.groupBy(*keys, "rule").agg(F.count_distinct("clause").alias("n"), F.first("clauses").alias("clauses")).where("n = clauses")
    return met.groupBy(*keys).agg(F.collect_list("rule").alias("met"))


def scan(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, found: str = "found") -> DataFrame:
    """`docs` with the column `found`: array<struct<start, kind, end>> of all spans by start, then by rule; kind is the rule's number.

    A null or empty text has no spans, an empty table gives no rows. Keys may be null or repeat: candidates are found by
    (key, hash of the text). Spans of several rules may overlap or be equal; all are told. ValueError if `docs` has a
    column named `found`.
    """
    if found.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {found}")
    key, digest, met_, text_ = fresh(docs, "key", "hash", "met", "t")
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.withColumn(digest, F.xxhash64(text))
    met = candidates(src.select(F.col(key_col).alias("k"), F.col(digest).alias("h"), text.alias(text_)), ["k", "h"], text_, rules)
    met = met.select(F.col("k").alias(key), F.col("h").alias(digest + "_"), F.col("met").alias(met_))
    out = src.join(met, F.col(key_col).eqNullSafe(F.col(key)) & (F.col(digest) == F.col(digest + "_")), "left")
    kind = "array<struct<start:int,kind:int,end:int>>"
    parts = []
    for i, r in enumerate(rules):
        got = F.transform(_spans(text, r), _kinded(i))
        parts.append(got if not query(r.pattern) else F.when(F.array_contains(met_, i), got).otherwise(F.array().cast(kind)))
    return out.select(*[F.col(c) for c in docs.columns], F.array_sort(F.concat(*parts)).alias(found))


def written(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256 and spans.

    Null texts are empty and have no spans; rows that repeat each get their result; spans that start together come in
    the order of the rules. An empty table gives no rows; other columns are left out.
    """
    out = scan(docs.select(id_col, text_col), text_col, id_col, rules)
    counts = [F.size(F.filter("found", _is(i))).cast("long").alias(f"n_{r.name}") for i, r in enumerate(BASE)]
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    return out.select(id_col, *counts, F.sha2(written(base, rules).cast("binary"), 256).alias("base_sha256"), written(F.col("found"), rules).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each run of overlapping spans replaced by `mark`.

    A null text stays null; repeated rows are each redacted; an empty table gives no rows. Other columns, whatever
    their names, stay as they are.
    """
    (found,) = fresh(docs, "found")
    out = scan(docs, text_col, id_col, found=found)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"])
        more = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

    def close(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text_col), acc["at"] + 1, F.char_length(text_col)))

    new = F.when(F.size(found) == 0, F.col(text_col)).otherwise(F.aggregate(found, begin, step, close))
    return out.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])
