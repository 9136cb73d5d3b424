"""Scalar functions with the semantics of the time-series SQL dialect, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | int | float | bool | None


def _c(x: ColumnLike) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# --- conditional ------------------------------------------------------------------------------


def least_strict(*xs: ColumnLike) -> Column:
    """MIN(a, b, ...): null if any is null."""
    cs = [_c(x) for x in xs]
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cs]), F.least(*cs))


def greatest_strict(*xs: ColumnLike) -> Column:
    """MAX(a, b, ...): null if any is null."""
    cs = [_c(x) for x in xs]
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cs]), F.greatest(*cs))


TYPE_NAMES = {
    "string": "STRING", "boolean": "BOOL", "tinyint": "BYTE", "smallint": "SHORT", "int": "INTEGER", "bigint": "LONG",
    "float": "FLOAT", "double": "DOUBLE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB",
}


def typeof(x: ColumnLike) -> Column:
    """Dialect name of a value's type; NULL for nulls."""
    names = F.create_map(*[F.lit(y) for kv in TYPE_NAMES.items() for y in kv])
    return F.when(_c(x).isNull(), F.lit("NULL")).otherwise(F.coalesce(names[F.typeof(_c(x))], F.upper(F.typeof(_c(x)))))


def xor(a: ColumnLike, b: ColumnLike) -> Column:
    return _c(a) != _c(b)


# --- numbers ----------------------------------------------------------------------------------


def int_div(a: ColumnLike, b: ColumnLike) -> Column:
    """Integer / integer: towards zero; division by zero is an error."""
    return F.call_function("div", _c(a), _c(b))


def shift_left(x: ColumnLike, n: ColumnLike) -> Column:
    """x << n: a negative n shifts right; 64 and more leave 0."""
    return F.when(_c(n) >= 0, _left(_c(x), _c(n))).otherwise(_right(_c(x), -_c(n)))


def shift_right(x: ColumnLike, n: ColumnLike) -> Column:
    """x >> n, arithmetic: a negative n shifts left; 64 and more leave 0 or -1."""
    return F.when(_c(n) >= 0, _right(_c(x), _c(n))).otherwise(_left(_c(x), -_c(n)))


def _left(x: Column, n: Column) -> Column:
    return F.when(n >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x.cast("long"), F.least(n, F.lit(63)).cast("int")))


def _right(x: Column, n: Column) -> Column:
    gone = F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")
    return F.when(n >= 64, gone).otherwise(F.call_function("shiftright", x.cast("long"), F.least(n, F.lit(63)).cast("int")))


def hex_to_dec(s: ColumnLike) -> Column:
    """At most 16 hexadecimal digits, outer spaces aside; others and values over 2**63 - 1 are errors."""
    t = F.trim(_c(s))
    bad = ~t.rlike("^[0-9A-Fa-f]{1,16}$")
    return F.when(bad, F.raise_error(F.concat(F.lit("not hexadecimal: "), t)).cast("bigint")).otherwise(F.conv(t, 16, 10).cast("bigint"))


def log(base: ColumnLike, x: ColumnLike) -> Column:
    b, v = _c(base).cast("double"), _c(x).cast("double")
    bad = (b <= 0) | (b == 1) | (v <= 0)
    return F.when(bad, F.raise_error(F.lit("LOG out of range")).cast("double")).otherwise(F.log(v) / F.log(b))


def sqrt(x: ColumnLike) -> Column:
    return F.when(_c(x) < 0, F.raise_error(F.lit("SQRT of a negative number")).cast("double")).otherwise(F.sqrt(_c(x)))


def round_half_away(x: ColumnLike, digits: int = 0) -> Column:
    """ROUND: half away from zero; negative digits count as 0."""
    return F.round(_c(x), max(0, digits))


def trunc(x: ColumnLike, digits: int = 0) -> Column:
    """TRUNC: towards zero; digits may be negative."""
    scale = F.lit(float(10**abs(digits)))
    v = _c(x).cast("double")
    scaled = v * scale if digits >= 0 else v / scale
    whole = F.signum(scaled) * F.floor(F.abs(scaled))
    return whole / scale if digits >= 0 else whole * scale


def trunc_int(x: ColumnLike, digits: int = 0) -> Column:
    """TRUNC of an integer: x - x % 10**-digits."""
    return _c(x) if digits >= 0 else _c(x) - _c(x) % F.lit(10**-digits)


def random_long() -> Column:
    """RANDOM(): any long, another for each row."""
    return F.xxhash64(F.rand(), F.rand())


# --- strings ----------------------------------------------------------------------------------


def concat(*xs: ColumnLike) -> Column:
    """a || b: any types, null if any is null."""
    return F.concat(*[_c(x).cast("string") for x in xs])


def char(*codes: ColumnLike) -> Column:
    """CHAR(n, ...): the code points up to the first null or 0."""
    out, open_ = F.lit(""), F.lit(True)
    for c in map(_c, codes):
        open_ = open_ & c.isNotNull() & (c != 0)
        ok = F.coalesce(open_, F.lit(False))
        one = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        out = F.concat(out, F.when(ok, one).otherwise(F.lit("")))
    return out


def glob_to_regex(pattern: str) -> str:
    """`*` any run, `?` any character, `[...]` a set (`[^...]` its complement)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif c == "[" and (j := pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))) > 0:
            body = pattern[i + 1 : j]
            mark = "^" if body.startswith("^") else ""
            out += "[" + mark + re.sub(r"([\\\[\]&~])", r"\\\1", body[len(mark) :]) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob(pattern: str, s: ColumnLike) -> Column:
    return _c(s).rlike(glob_to_regex(pattern))


def hex_(x: ColumnLike) -> Column:
    """HEX: upper-case bytes; '' for null."""
    return F.coalesce(F.hex(_c(x)), F.lit(""))


def instr(s: ColumnLike, k: str, offset: int = 1, repeat: int = 1) -> Column:
    """1-based place of the `repeat`-th `k` from `offset` on; 0 if there is none."""
    v = _c(s)
    if repeat == 1:
        return F.locate(k, v, offset)
    rest = F.substring(v, offset, 1 << 30)
    found = F.size(F.split(rest, re.escape(k), -1)) - 1
    at = F.char_length(F.substring_index(rest, k, repeat)) + offset
    return F.when(v.isNull(), None).when(found >= repeat, at).otherwise(F.lit(0))


def quote(x: ColumnLike, kind: str = "string") -> Column:
    """A value as a literal: numbers bare, strings in quotes, blobs as X'..', null as NULL."""
    v = _c(x)
    if kind == "binary":
        made = F.concat(F.lit("X'"), F.hex(v), F.lit("'"))
    elif kind == "string":
        made = F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        made = v.cast("string")
    return F.coalesce(made, F.lit("NULL"))


def printf(fmt: str, *args: ColumnLike) -> Column:
    """PRINTF with %d %s %f %x and %%; %q doubles quotes."""
    out, cols = fmt, [_c(a) for a in args]
    for i, m in enumerate(re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?([a-zA-Z])", fmt)):
        if m == "q":
            cols[i] = F.replace(cols[i], F.lit("'"), F.lit("''"))
        if m in "di":
            cols[i] = cols[i].cast("bigint")
        if m in "feg":
            cols[i] = cols[i].cast("double")
    out = re.sub(r"(%[-+ 0#]*\d*(?:\.\d+)?)(q|i)", lambda m: m[1] + {"q": "s", "i": "d"}[m[2]], out)
    return F.format_string(out, *cols)


def zeroblob(n: ColumnLike) -> Column:
    return F.unhex(F.repeat(F.lit("00"), _c(n).cast("int")))


def randomblob(n: ColumnLike) -> Column:
    """At least one byte."""
    size = F.greatest(_c(n).cast("int"), F.lit(1))
    words = F.transform(F.sequence(F.lit(1), F.ceil(size / 8).cast("int")), lambda i: F.lpad(F.hex(F.xxhash64(F.uuid(), i)), 16, "0"))
    return F.substring(F.unhex(F.array_join(words, "")), F.lit(1), size)


def replace(s: ColumnLike, a: str, b: str) -> Column:
    """An empty `a` leaves the string as it is."""
    return F.replace(_c(s), F.lit(a), F.lit(b)) if a else _c(s)


def substr(s: ColumnLike, start: int, length: int | None = None) -> Column:
    """1-based; positions before the first count towards the length, as in SQL."""
    if start < 0:
        begin = F.greatest(F.char_length(_c(s)) + start + 1, F.lit(1))
        take = F.lit(length) if length is not None else F.char_length(_c(s))
        return F.substring(_c(s), begin, take)
    if start == 0:
        start, length = 1, None if length is None else max(0, length - 1)
    return F.substring(_c(s), start, (1 << 30) if length is None else length)


def trim(s: ColumnLike, chars: str = " ") -> Column:
    return F.btrim(_c(s), F.lit(chars))


def ltrim(s: ColumnLike, chars: str = " ") -> Column:
    return F.ltrim(_c(s), F.lit(chars))


def rtrim(s: ColumnLike, chars: str = " ") -> Column:
    return F.rtrim(_c(s), F.lit(chars))


def unicode_(s: ColumnLike) -> Column:
    """First code point; null for ''."""
    return F.when(_c(s) != "", F.ascii(_c(s)))


# --- times ------------------------------------------------------------------------------------

UNITS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND")
MICROS = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000, "MILLISECOND": 1000, "MICROSECOND": 1}


def micros(n: int, unit: str) -> int:
    """Microseconds of an interval of fixed length."""
    unit = unit.upper()
    if unit not in MICROS:
        raise ValueError(f"unit {unit}: one of {', '.join(MICROS)} is needed")
    if n <= 0:
        raise ValueError("an interval must be positive")
    return n * MICROS[unit]


def _zone(ts: ColumnLike, tz: str | None) -> Column:
    return F.from_utc_timestamp(_c(ts), tz) if tz else _c(ts)


def now() -> Column:
    return F.date_trunc("MILLISECOND", F.current_timestamp())


def extract(field: str, ts: ColumnLike, tz: str | None = None) -> Column:
    """EXTRACT(field, ts[, tz]): DAY_OF_WEEK counts from Sunday = 0."""
    t = _zone(ts, tz)
    frac = F.unix_micros(t.cast("timestamp"))
    fields = {
        "YEAR": lambda: F.year(t), "MONTH": lambda: F.month(t), "DAY": lambda: F.dayofmonth(t), "HOUR": lambda: F.hour(t), "MINUTE": lambda: F.minute(t), "SECOND": lambda: F.second(t),
        "MILLISECOND": lambda: F.floor(F.pmod(frac, F.lit(1_000_000)) / 1000), "MICROSECOND": lambda: F.pmod(frac, F.lit(1_000_000)), "NANOSECOND": lambda: F.pmod(frac, F.lit(1_000_000)) * 1000,
        "DAY_OF_WEEK": lambda: F.dayofweek(t) - 1, "DAY_OF_YEAR": lambda: F.dayofyear(t),
    }
    return fields[field.upper()]().cast("long")


def timestamp_add(unit: str, ts: ColumnLike, n: ColumnLike) -> Column:
    """Months and years by the calendar."""
    if unit.upper() not in UNITS:
        raise ValueError(f"unit {unit}")
    t, k = _c(ts), _c(n)
    unit = unit.upper()
    if unit in ("YEAR", "MONTH"):
        return t + (F.make_ym_interval(k, F.lit(0)) if unit == "YEAR" else F.make_ym_interval(F.lit(0), k))
    return F.timestamp_micros(F.unix_micros(t.cast("timestamp")) + k.cast("long") * F.lit(MICROS[unit]).cast("long"))


def timestamp_diff(unit: str, a: ColumnLike, b: ColumnLike) -> Column:
    """a - b in whole units; months and years count when complete."""
    unit = unit.upper()
    if unit in MICROS:
        return int_div(F.unix_micros(_c(a).cast("timestamp")) - F.unix_micros(_c(b).cast("timestamp")), F.lit(MICROS[unit]))
    return F.timestamp_diff(unit, _c(b), _c(a))


def timestamp_trunc(unit: str, ts: ColumnLike, tz: str | None = None) -> Column:
    t = F.date_trunc(unit, _zone(ts, tz))
    return F.to_utc_timestamp(t, tz) if tz else t


STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS", "z": "xx"}


def strftime(fmt: str, ts: ColumnLike, tz: str | None = None) -> Column:
    """%Y %m %d %H %M %S %3f %6f %9f %w %W %j %c %z %%; others are errors."""
    t, parts, at = _zone(ts, tz), [], 0
    for m in re.finditer(r"%([369]f|.)", fmt):
        if m.start() > at:
            parts.append(F.lit(fmt[at : m.start()]))
        at, k = m.end(), m[1]
        if k == "%":
            parts.append(F.lit("%"))
        elif k == "w":
            parts.append((F.dayofweek(t) - 1).cast("string"))
        elif k == "W":  # weeks that start on Monday; days before the first are in week 0
            parts.append(F.lpad(F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7).cast("string"), 2, "0"))
        elif k == "c":
            parts.append(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        elif k in STRFTIME:
            parts.append(F.date_format(t, STRFTIME[k]))
        else:
            raise ValueError(f"format %{k}")
    if at < len(fmt):
        parts.append(F.lit(fmt[at:]))
    return F.concat(*parts) if parts else F.lit("")


def make_timestamp(y, mo, d, h=0, mi=0, s=0) -> Column:
    return F.make_timestamp(*[_c(x) for x in (y, mo, d, h, mi)], _c(s).cast("decimal(8,6)"))


def to_epoch_ms(ts: ColumnLike) -> Column:
    return F.unix_millis(_c(ts).cast("timestamp"))


def to_timestamp_ms(n: ColumnLike) -> Column:
    return F.timestamp_millis(_c(n))


def epoch_nanos(ts: ColumnLike, nanos: ColumnLike = 0) -> Column:
    """TIMESTAMP(9) as a long: microseconds of a timestamp and the nanoseconds beyond them."""
    return F.unix_micros(_c(ts).cast("timestamp")) * 1000 + _c(nanos)


def from_epoch_nanos(n: ColumnLike) -> tuple[Column, Column]:
    return F.timestamp_micros(F.floor(_c(n) / 1000)), F.pmod(_c(n), F.lit(1000))


# --- arrays -----------------------------------------------------------------------------------


def array_length(a: ColumnLike) -> Column:
    return F.size(_c(a))


def element(n: ColumnLike, a: ColumnLike) -> Column:
    """ELEMENT(n, a), from 0."""
    return F.element_at(_c(a), _c(n) + 1)
