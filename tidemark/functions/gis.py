"""Geometries as text with their bounding boxes: pure expressions over WKT strings.

A box is a struct of xmin, ymin, zmin, xmax, ymax, zmax (z null in the plane).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def _once(value: Column, use) -> Column:
    """use(value) with the value as a variable: a filter's own copies of an expression would each be worked out."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def srid(g: Column) -> Column:
    """ST_GETSRID of `WKT;srid`; -1 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(g, r";\s*(-?\d+)", 1), F.lit("")).cast("int"), F.lit(-1))


def box(g: Column) -> Column:
    """The bounding box of POINT, LINESTRING, POLYGON or POLYHEDRALSURFACE text; null for EMPTY and null."""
    body = F.regexp_replace(g, r";.*$", "")
    points = F.split(F.regexp_replace(F.regexp_replace(body, r"^[^(]*", ""), r"[()]", " "), ",")
    axes = F.transform(points, lambda p: F.transform(F.regexp_extract_all(p, F.lit(NUMBER), F.lit(1)), lambda n: n.cast("double")))
    axes = F.filter(axes, lambda p: F.size(p) >= 2)

    def made(axes: Column) -> Column:
        def ends(i: int):
            own = F.transform(axes, lambda p: F.get(p, F.lit(i)))
            return F.array_min(own), F.array_max(own)

        (x0, x1), (y0, y1), (z0, z1) = ends(0), ends(1), ends(2)
        return F.when(F.size(axes) > 0, F.struct(x0.alias("xmin"), y0.alias("ymin"), z0.alias("zmin"), x1.alias("xmax"), y1.alias("ymax"), z1.alias("zmax")))

    return _once(axes, made)


def make_rect(x0, y0, x1, y1) -> Column:
    """ST_MAKERECT of two corners."""
    none = F.lit(None).cast("double")
    return make_box(x0, y0, none, x1, y1, none)


def make_box(x0, y0, z0, x1, y1, z1) -> Column:
    """ST_MAKEBOX of two corners."""
    low = [F.least(a, b).cast("double") for a, b in ((x0, x1), (y0, y1), (z0, z1))]
    high = [F.greatest(a, b).cast("double") for a, b in ((x0, x1), (y0, y1), (z0, z1))]
    return F.struct(*[c.alias(n) for c, n in zip(low + high, ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"))])


def intersects(a: Column, b: Column) -> Column:
    """ST_MBRINTERSECTS: boxes that touch intersect; z counts where both have it."""

    def meet(a: Column, b: Column) -> Column:
        flat = (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])
        deep = (a["zmin"] <= b["zmax"]) & (b["zmin"] <= a["zmax"])
        return flat & F.coalesce(deep, F.lit(True))

    return _once(F.struct(a.alias("a"), b.alias("b")), lambda both: meet(both["a"], both["b"]))


def plane(a, b, c, d) -> list[float]:
    """ST_MAKEPLANE: coefficients of a x + b y + c z + d as those of a quadratic form (see `quadratic`)."""
    return [0, 0, 0, 0, 0, 0, a, b, c, d]


def sphere(x, y, z, r) -> list[float]:
    """ST_MAKESPHERE."""
    return [1, 1, 1, 0, 0, 0, -2 * x, -2 * y, -2 * z, x * x + y * y + z * z - r * r]


def cylinder(x, y, r) -> list[float]:
    """ST_MAKECYLINDER along z."""
    return [1, 1, 0, 0, 0, 0, -2 * x, -2 * y, 0, x * x + y * y - r * r]


def cone(x, y, z, slope) -> list[float]:
    """ST_MAKECONE with its tip at (x, y, z), along z."""
    k = slope * slope
    return [1, 1, -k, 0, 0, 0, -2 * x, -2 * y, 2 * k * z, x * x + y * y - k * z * z]


def surface(text: str) -> list[float]:
    """QUADRATICSURFACE(a1 ... a9 b1 b2 b3 c): the rows of a 3 x 3 matrix, a vector and a constant of
    x'Ax + b'x + c, as the coefficients of `quadratic`."""
    m = re.fullmatch(r"\s*QUADRATICSURFACE\s*\(([^()]*)\)\s*(?:;\s*-?\d+\s*)?", text, re.I)
    v = [float(x) for x in m[1].replace(",", " ").split()] if m else []
    if len(v) != 13:
        raise ValueError(f"a quadratic surface has 13 numbers: {text}")
    return qsf(*v)


def qsf(*v: float) -> list[float]:
    """ST_MAKEQSF of a matrix by rows, a vector and a constant."""
    if len(v) != 13:
        raise ValueError("ST_MAKEQSF takes 13 numbers")
    a, b = v[:9], v[9:12]
    return [a[0], a[4], a[8], a[1] + a[3], a[5] + a[7], a[2] + a[6], *b, v[12]]


def quadratic(q: list[float], x: Column, y: Column, z: Column) -> Column:
    """q0 x2 + q1 y2 + q2 z2 + q3 xy + q4 yz + q5 zx + q6 x + q7 y + q8 z + q9; terms with a zero are left out."""
    terms = (x * x, y * y, z * z, x * y, y * z, z * x, x, y, z)
    made = [F.lit(float(c)) * t for c, t in zip(q, terms) if c != 0]
    return reduce(lambda a, b: a + b, [*made, F.lit(float(q[9]))])


def quadratic_intersects(q: list[float], b: Column) -> Column:
    """ST_QSFMBRINTERSECTS: the form changes its sign, or is zero, among a box's corners and centre."""

    def values(b: Column) -> Column:
        z0, z1 = F.coalesce(b["zmin"], F.lit(0.0)), F.coalesce(b["zmax"], F.lit(0.0))
        at = [quadratic(q, x, y, z) for x in (b["xmin"], b["xmax"]) for y in (b["ymin"], b["ymax"]) for z in (z0, z1)]
        at.append(quadratic(q, (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2, (z0 + z1) / 2))
        flat = b["xmin"].isNotNull() & b["ymin"].isNotNull() & b["xmax"].isNotNull() & b["ymax"].isNotNull()
        return F.when(flat, F.array(*at))

    return _once(_once(b, values), lambda v: (F.array_min(v) <= 0) & (F.array_max(v) >= 0))
