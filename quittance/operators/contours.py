"""Outer borders of masks: following, area, simplification, and what is drawn of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.operators.images import pixels, smallest_rectangle

#: The eight neighbours (dx, dy), clockwise from the one on the left, with y downwards.
AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def regions(on: np.ndarray, corners: bool) -> np.ndarray:
    """A number over 0 for each connected region, the same for all its pixels; ``corners``: also over corners."""
    h, w = on.shape
    label = np.zeros((h + 2, w + 2), np.int64)
    label[1:-1, 1:-1] = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if corners else [])
    while True:
        best = label.copy()
        for dy, dx in steps:
            for sy, sx in ((dy, dx), (-dy, -dx)):
                best = np.maximum(best, np.roll(label, (sy, sx), (0, 1)))
        best[label == 0] = 0
        inner = best[1:-1, 1:-1]
        # jump to the label's own label: regions settle in a logarithmic number of rounds
        inner[...] = np.concatenate([[0], inner.ravel()])[inner]
        if (best == label).all():
            return label[1:-1, 1:-1]
        label = best


def follow(on: np.ndarray, x: int, y: int) -> np.ndarray:
    """The outer border of the region whose first pixel, from above and then from the left, is (x, y): (n, 2) pixels in order.

    The border is walked with the outside at one hand, and ends where it would
    go on as it began, so that bridges of one pixel are walked both ways.
    """
    h, w = on.shape
    inside = lambda px, py: 0 <= px < w and 0 <= py < h and on[py, px]
    at, came = (x, y), 0
    points: list[tuple[int, int]] = []
    first: tuple | None = None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            step = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
            if inside(*step):
                break
        else:
            return np.array([at])
        if (at, d) == first:
            return np.array(points)
        first = first or (at, d)
        points.append(at)
        # the neighbour looked at last was outside: from the new pixel, the search goes on from there
        at, came = step, (d + 5) % 8 if d % 2 else (d + 6) % 8


def outer_contours(mask: np.ndarray) -> list[np.ndarray]:
    """The outer border of every region that is not within a hole of another, in the order of their first pixels."""
    on = mask > 0
    if not on.any():
        return []
    background = np.ones((on.shape[0] + 2, on.shape[1] + 2), bool)
    background[1:-1, 1:-1] = ~on
    label = regions(background, False)
    outside = label == label[0, 0]
    beside = (outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:]) & on
    own = regions(on, True)
    out = []
    for k in np.unique(own[beside]):
        y, x = np.unravel_index(np.flatnonzero(own.ravel() == k)[0], on.shape)
        out.append((int(y), int(x), own == k))
    return [follow(region, x, y) for y, x, region in sorted(out, key=lambda r: r[:2])]


def contour_area(points: np.ndarray) -> float:
    """The area within a closed border, through the centres of its pixels."""
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def _far(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points from the line through a and b, or from a where they are one."""
    d, p = (b - a).astype(float), (points - a).astype(float)
    size = np.hypot(*d)
    return np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / size if size else np.hypot(p[:, 0], p[:, 1])


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed border with fewer points, from which none that is left out is farther than ``tolerance``.

    Split at its first point and the one farthest from that, each half keeps the
    point farthest from its chord while that is beyond the tolerance.
    """
    if len(points) < 3:
        return points
    split = int(np.argmax(((points - points[0]) ** 2).sum(1)))
    closed = np.concatenate([points, points[:1]])
    keep = np.zeros(len(closed), bool)
    keep[[0, split, len(points)]] = True
    todo = [(0, split), (split, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            far = _far(closed[a + 1 : b], closed[a], closed[b])
            k = int(far.argmax())
            if far[k] > tolerance:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep[:-1]]


def largest_contour(mask: np.ndarray) -> np.ndarray:
    """The outer border with the largest area, the first on ties; empty for an empty mask."""
    return max(outer_contours(mask), key=contour_area, default=np.empty((0, 2), int))


def pad(box: np.ndarray, padding: float) -> np.ndarray:
    """Corners moved away from their centre by ``padding`` pixels, each along its ray; a corner at the centre stays."""
    ray = box - box.mean(0)
    size = np.hypot(ray[:, 0], ray[:, 1])[:, None]
    return box + np.divide(ray, size, out=np.zeros_like(ray), where=size > 0) * padding


def receipt_corners(mask: np.ndarray, padding: float = 0.0) -> np.ndarray:
    """Corners of the smallest rectangle around the largest contour; the whole page for an empty mask."""
    border = largest_contour(mask)
    h, w = mask.shape
    box = smallest_rectangle(border) if len(border) else np.array([[0, 0], [w, 0], [w, h], [0, h]], float)
    return pad(box, padding) if padding else box


def draw_polygon(image: np.ndarray, points: np.ndarray, colour: tuple[int, int, int] = (0, 255, 0), thickness: float = 20.0) -> np.ndarray:
    """A closed line over an image."""
    out = image.copy()
    y, x = np.mgrid[0 : image.shape[0], 0 : image.shape[1]]
    for a, b in zip(points, np.roll(points, -1, 0), strict=True):
        d = b - a
        t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(1e-12, d @ d), 0, 1)
        out[np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]) <= thickness / 2] = colour
    return out


def contour_corners(height: Column, width: Column, mask: Column, padding: float = 0.0) -> Column:
    """``receipt_corners`` of masks as a column of (x, y); a null mask is an empty one."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def corners(h: pd.Series, w: pd.Series, m: pd.Series) -> pd.Series:
        masks = [pixels(height, width, 1, data)[..., 0] if data else np.zeros((height, width), np.uint8) for height, width, data in zip(h, w, m, strict=True)]
        return pd.Series([[{"x": float(x), "y": float(y)} for x, y in receipt_corners(mask, padding)] for mask in masks])

    return corners(height, width, mask)


def contour_pages(masks: DataFrame, padding: float = 0.0, thickness: float = 20.0) -> DataFrame:
    """Masks as grey pages with the rectangle around the receipt drawn on them: what an inspection of the chain looks at."""

    @F.pandas_udf("binary")
    def drawn(h: pd.Series, w: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for height, width, data in zip(h, w, m, strict=True):
            mask = pixels(height, width, 1, data)[..., 0] if data else np.zeros((height, width), np.uint8)
            out.append(draw_polygon(np.repeat(mask[..., None], 3, 2), receipt_corners(mask, padding), thickness=thickness).tobytes())
        return pd.Series(out)

    return masks.select("receipt_id", "page_no", "height", "width", F.lit(3).alias("n_channels"), drawn("height", "width", "mask").alias("data"))
