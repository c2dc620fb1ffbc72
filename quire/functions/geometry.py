"""Rectangles, matrices, points and colours as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.coalesce(_c(v).cast("double"), F.lit(0.0)).alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))))


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def rect_of(numbers: Column) -> Column:
    """A rectangle from an array of four numbers; null stays null."""
    return F.when(numbers.isNotNull(), F.struct(*(F.get(numbers, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2")))))


ZERO = (0.0, 0.0, 0.0, 0.0)


def width(r: Column) -> Column:
    return r["x2"] - r["x1"]


def height(r: Column) -> Column:
    return r["y2"] - r["y1"]


def normalize(r: Column) -> Column:
    return F.when(r.isNotNull(), F.struct(F.least(r["x1"], r["x2"]).alias("x1"), F.least(r["y1"], r["y2"]).alias("y1"), F.greatest(r["x1"], r["x2"]).alias("x2"), F.greatest(r["y1"], r["y2"]).alias("y2")))


def contains(r: Column, x, y) -> Column:
    return _c(x).between(r["x1"], r["x2"]) & _c(y).between(r["y1"], r["y2"])


def intersect(a: Column, b: Column) -> Column:
    """The common rectangle, null if there is none; touching edges meet."""
    x1, y1, x2, y2 = F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"])
    return F.when((x1 <= x2) & (y1 <= y2), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))


def union_agg(r: Column) -> Column:
    """The bounding box of a group."""
    return F.struct(F.min(r["x1"]).alias("x1"), F.min(r["y1"]).alias("y1"), F.max(r["x2"]).alias("x2"), F.max(r["y2"]).alias("y2"))


def inflate(r: Column, dx, dy) -> Column:
    return F.struct((r["x1"] - _c(dx)).alias("x1"), (r["y1"] - _c(dy)).alias("y1"), (r["x2"] + _c(dx)).alias("x2"), (r["y2"] + _c(dy)).alias("y2"))


_CELLS = ("a", "b", "c", "d", "h", "v")


def matrix(a, b, c, d, h, v) -> Column:
    return F.struct(*(_c(x).cast("double").alias(n) for x, n in zip((a, b, c, d, h, v), _CELLS)))


def identity() -> Column:
    return matrix(1, 0, 0, 1, 0, 0)


def translation(h, v) -> Column:
    return matrix(1, 0, 0, 1, h, v)


def scale(x, y) -> Column:
    return matrix(x, 0, 0, y, 0, 0)


def rotation(radians) -> Column:
    t = _c(radians)
    return matrix(F.cos(t), F.sin(t), -F.sin(t), F.cos(t), 0, 0)


def multiply(m: Column, n: Column) -> Column:
    """Row vectors: m first, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"], m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["h"] * n["a"] + m["v"] * n["c"] + n["h"], m["h"] * n["b"] + m["v"] * n["d"] + n["v"],
    )


def concat(m: Column, n: Column) -> Column:
    return multiply(n, m)


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def inverse(m: Column) -> Column:
    """Null for a matrix whose determinant is below 1e-14."""
    det = determinant(m)
    return F.when(
        F.abs(det) >= 1e-14,
        matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["v"] - m["d"] * m["h"]) / det, (m["b"] * m["h"] - m["a"] * m["v"]) / det),
    )


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def transform_point(m: Column, p: Column) -> Column:
    return point(m["a"] * p["x"] + m["c"] * p["y"] + m["h"], m["b"] * p["x"] + m["d"] * p["y"] + m["v"])


def quads(numbers: Column) -> Column:
    """Groups of eight numbers as four points each; what is left over is ignored."""
    count = (F.size(numbers) / 8).cast("int")
    corners = lambda i: F.struct(*(F.struct(F.get(numbers, i * 8 + 2 * k).alias("x"), F.get(numbers, i * 8 + 2 * k + 1).alias("y")).alias(f"p{k + 1}") for k in range(4)))
    return F.when(numbers.isNull() | (count < 1), F.lit(None)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), corners))


def points(numbers: Column) -> Column:
    """Pairs of numbers as points."""
    count = (F.size(numbers) / 2).cast("int")
    return F.when(numbers.isNull() | (count < 1), F.lit(None)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.get(numbers, 2 * i).alias("x"), F.get(numbers, 2 * i + 1).alias("y"))))


def color(components: Column) -> Column:
    """Up to four components, absent ones 0; gray, RGB and CMYK alike."""
    return F.when(components.isNotNull(), F.struct(*(F.coalesce(F.get(components, i), F.lit(0.0)).alias(f"c{i}") for i in range(4))))
