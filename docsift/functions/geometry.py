"""Affine page transforms and boxes as column arithmetic: x' = a x + b y + c, y' = d x + e y + f."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = "abcdef"
CORNERS = ("x0", "y0", "x1", "y1")


def matrix(*six: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(six, NAMES, strict=True)])


def compose(second: Column, first: Column) -> Column:
    """The matrix that applies ``first`` and then ``second``."""
    s, t = ({n: m[n] for n in NAMES} for m in (second, first))
    return matrix(
        s["a"] * t["a"] + s["b"] * t["d"], s["a"] * t["b"] + s["b"] * t["e"], s["a"] * t["c"] + s["b"] * t["f"] + s["c"],
        s["d"] * t["a"] + s["e"] * t["d"], s["d"] * t["b"] + s["e"] * t["e"], s["d"] * t["c"] + s["e"] * t["f"] + s["f"],
    )


def invert(m: Column) -> Column:
    """The inverse matrix; null if the determinant is below 1e-12."""
    det = m["a"] * m["e"] - m["b"] * m["d"]
    safe = F.when(F.abs(det) >= 1e-12, det)
    a, b, d, e = m["e"] / safe, -m["b"] / safe, -m["d"] / safe, m["a"] / safe
    return F.when(safe.isNotNull(), matrix(a, b, -(a * m["c"] + b * m["f"]), d, e, -(d * m["c"] + e * m["f"])))


def rotation(degrees: Column, width: Column, height: Column) -> Column:
    """struct(m, width, height): a turn about the page's corner, moved so that the larger canvas starts at 0."""
    t = F.radians(degrees)
    cos, sin = F.cos(t), F.sin(t)
    xs = [F.lit(0.0), width * cos, -height * sin, width * cos - height * sin]
    ys = [F.lit(0.0), width * sin, height * cos, width * sin + height * cos]
    x, y = F.least(*xs), F.least(*ys)
    return F.struct(matrix(cos, -sin, -x, sin, cos, -y).alias("m"), F.ceil(F.greatest(*xs) - x - 1e-9).alias("width"), F.ceil(F.greatest(*ys) - y - 1e-9).alias("height"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), CORNERS, strict=True)])


def map_box(m: Column, b: Column) -> Column:
    """The upright box around the four mapped corners."""
    points = [(b[x], b[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs = [m["a"] * x + m["b"] * y + m["c"] for x, y in points]
    ys = [m["d"] * x + m["e"] * y + m["f"] for x, y in points]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def clamp(b: Column, width: Column, height: Column) -> Column:
    inside = lambda c, top: F.greatest(F.lit(0.0), F.least(c, top))
    return box(inside(b["x0"], width), inside(b["y0"], height), inside(b["x1"], width), inside(b["y1"], height))


def valid_box(b: Column) -> Column:
    """A normalised box, null unless all corners are in [0, 1] and it has an area."""
    good = F.greatest(*[b[c] for c in CORNERS]) <= 1
    good &= (F.least(*[b[c] for c in CORNERS]) >= 0) & (b["x0"] < b["x1"]) & (b["y0"] < b["y1"])
    return F.when(good, b)


def absolute(b: Column, width: Column, height: Column) -> Column:
    """Page units: a box with no corner over 1 is normalised and scaled."""
    scale = F.greatest(*[b[c] for c in CORNERS]) <= 1
    return F.when(scale, box(b["x0"] * width, b["y0"] * height, b["x1"] * width, b["y1"] * height)).otherwise(b)


def crop_box(b: Column, width: Column, height: Column) -> Column:
    """Pixels around a normalised box to read again: from the left edge, so that the label is in it, with a margin above, below and right.

    Null if a side is shorter than 8 pixels.
    """
    whole = lambda c: c.cast("int")
    top, right, bottom = F.greatest(F.lit(0), whole((b["y0"] - 0.035) * height)), F.least(width, whole((b["x1"] + 0.08) * width)), F.least(height, whole((b["y1"] + 0.035) * height))
    return F.when((right >= 8) & (bottom - top >= 8), F.struct(F.lit(0).alias("x0"), top.alias("y0"), right.alias("x1"), bottom.alias("y1")))


def plan_scale(width: Column, height: Column, target: float, trigger: float = 0.5, most: float = 2.0) -> Column:
    """The factor that brings a page's long edge to ``target``: larger pages shrink, those of ``trigger`` or less of it grow ``most`` times at most."""
    edge = F.greatest(width, height)
    factor = F.lit(float(target)) / edge
    return F.when(edge > target, factor).when((edge > 0) & (edge <= target * trigger), F.least(F.lit(float(most)), factor)).when(edge > 0, 1.0)


def setting(value: str | None, low: float, high: float, default: float, *, off: float | None = None) -> float:
    """A number from a setting's text; the default where it is none, or out of range and not the value that switches it off."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    return number if low <= number <= high or number == off else default
