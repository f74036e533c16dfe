"""Boxes, angles and detections as Column functions.

A quad is an array of four structs (x, y): upper left, upper right, lower right,
lower left. A box is four numbers x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds(quad: Column) -> tuple[Column, Column, Column, Column]:
    """The axis-aligned box around a quad."""
    xs, ys = ([F.get(quad, F.lit(i))[c] for i in range(4)] for c in "xy")
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def normalise(quad: Column, width: Column, height: Column) -> dict[str, Column]:
    """The box on a grid of 0 to 1000, cut to whole numbers toward zero."""
    x1, y1, x2, y2 = bounds(quad)
    x1, x2, y1, y2 = 1000 * x1 / width, 1000 * x2 / width, 1000 * y1 / height, 1000 * y2 / height
    return {"x1": x1.cast("int"), "y1": y1.cast("int"), "x2": (x1 + (x2 - x1)).cast("int"), "y2": (y1 + (y2 - y1)).cast("int")}


def unnormalise(v: Column, size: Column) -> Column:
    """Back to whole pixels, halves to even."""
    return F.bround(size * (v / 1000)).cast("int")


def unnormalise_float(v: Column, size: Column) -> Column:
    return size * (v / 1000)


def skew_angle(quad: Column) -> Column:
    """Degrees by which the upper edge leaves the level, two decimals; rising edges are positive, upright ones 0."""
    a, b = quad[0], quad[1]
    w, h = F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"])
    turn = F.round(F.degrees(F.atan(h / F.nullif(w, F.lit(0.0)))), 2)
    return F.when(w == 0, 0.0).otherwise(F.when(a["y"] > b["y"], turn).otherwise(-turn))


def is_oblong(quad: Column) -> Column:
    """Sides differ by more than a factor of two."""
    w = F.least(F.abs(quad[1]["x"] - quad[0]["x"]), F.abs(quad[2]["x"] - quad[3]["x"]))
    h = F.least(F.abs(quad[3]["y"] - quad[0]["y"]), F.abs(quad[2]["y"] - quad[1]["y"]))
    return (w != 0) & (h != 0) & (F.least(w, h) / F.nullif(F.greatest(w, h), F.lit(0.0)) < 0.5)


def is_upright(quad: Column) -> Column:
    """The upper edge spans less than the left side: the text runs up or down."""
    return F.abs(quad[1]["x"] - quad[0]["x"]) < F.abs(quad[2]["y"] - quad[0]["y"])


def upright_turn(corners: Column) -> Column:
    """Degrees that bring the longest side of a rotated rectangle upright; 0 for one that is nearly square."""

    def side(i: int, j: int) -> tuple[Column, Column]:
        dx, dy = corners[j]["x"] - corners[i]["x"], corners[j]["y"] - corners[i]["y"]
        return F.sqrt(dx * dx + dy * dy), F.degrees(F.atan2(dy, dx))

    sides = [side(i, (i + 1) % 4) for i in range(4)]
    longest = F.greatest(*[s[0] for s in sides])
    shortest = F.least(*[s[0] for s in sides])
    angle = sides[3][1]
    for length, a in reversed(sides[:3]):
        angle = F.when(length == longest, a).otherwise(angle)
    turn = (
        F.when(angle.between(-11, 11), angle - 90)
        .when(angle.between(169, 191), angle + 90)
        .when((angle > -180) & (angle <= 0), angle + 90)
        .otherwise(angle - 90)
    )
    return F.when(F.coalesce(shortest / F.nullif(longest, F.lit(0.0)) > 0.8, F.lit(True)), 0.0).otherwise(turn)


def canvas(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """Whole size of a page turned by ``degrees``."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return F.ceil(F.round(width * c + height * s, 6)).cast("int"), F.ceil(F.round(width * s + height * c, 6)).cast("int")


def rotate(corners: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Corners after a turn about the centre by -degrees, moved to the middle of the turned canvas."""
    w, h = canvas(width, height, degrees)
    # the same for all corners, so it is computed once and not for each of them
    known = F.struct(F.cos(F.radians(-degrees)).alias("c"), F.sin(F.radians(-degrees)).alias("s"), (width / 2).alias("x"), (height / 2).alias("y"), (w / 2).alias("w"), (h / 2).alias("h"))

    def turn(p: Column, k: Column) -> Column:
        x, y = p["x"] - k["x"], p["y"] - k["y"]
        return F.struct((x * k["c"] - y * k["s"] + k["w"]).alias("x"), (x * k["s"] + y * k["c"] + k["h"]).alias("y"))

    return F.get(F.transform(F.array(known), lambda k: F.transform(corners, lambda p: turn(p, k))), F.lit(0))


def crop_window(corners: Column, width: Column, height: Column, digits: int | None = None) -> dict[str, Column]:
    """The box around corners, inside the page; its sides are rounded to ``digits`` first, as if the corners were."""
    x1, y1, x2, y2 = bounds(corners) if digits is None else (F.round(v, digits) for v in bounds(corners))
    return {
        "cx1": F.greatest(x1.cast("int"), F.lit(0)),
        "cy1": F.greatest(y1.cast("int"), F.lit(0)),
        "cx2": F.least(x2.cast("int"), width),
        "cy2": F.least(y2.cast("int"), height),
    }


def pad(corners: Column, padding: float = 0.0) -> Column:
    """Four corners moved away from their centre by ``padding``, each along its ray; a corner at the centre stays."""
    cx, cy = F.aggregate(corners, F.lit(0.0), lambda a, p: a + p["x"]) / 4, F.aggregate(corners, F.lit(0.0), lambda a, p: a + p["y"]) / 4

    def moved(p: Column) -> Column:
        share = F.coalesce(padding / F.nullif(F.hypot(p["x"] - cx, p["y"] - cy), F.lit(0.0)), F.lit(0.0))
        return F.struct((p["x"] + (p["x"] - cx) * share).alias("x"), (p["y"] + (p["y"] - cy) * share).alias("y"))

    return F.transform(corners, moved)


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def corner_size_to_corners(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": x, "y1": y, "x2": x + w, "y2": y + h}


def percent_to_pixels(points: Column, width: Column, height: Column) -> Column:
    """Polygon points in percent of a page as whole pixels."""
    return F.transform(points, lambda p: F.struct((p[0] * width / 100).cast("int").alias("x"), (p[1] * height / 100).cast("int").alias("y")))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(a: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def box_issues(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a normalised box is thinner than 1 or leaves the grid."""
    return (x2 - x1 < 1) | (y2 - y1 < 1) | (F.greatest(x1, y1, x2, y2) > 999)
