"""Pixel work on raw page bytes, in numpy over Arrow batches.

Pages have height, width, n_channels and data, rows of pixels as Spark's image
source gives them (blue, green, red).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels sampled for the colour count.
SAMPLE = 2000


def pixels(height: int, width: int, n_channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, n_channels)


def distinct_colours(image: np.ndarray, sample: int = SAMPLE, seed: int = 17) -> int:
    """Distinct colours among at most ``sample`` pixels drawn without replacement, by a fixed seed."""
    flat = image.reshape(-1, image.shape[-1])
    if len(flat) > sample:
        flat = flat[np.random.default_rng(seed).choice(len(flat), sample, replace=False)]
    return len(np.unique(flat, axis=0))


def with_colours(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Adds ``n_colours``; a page without pixels has 0."""

    @F.pandas_udf("int")
    def count(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([distinct_colours(pixels(*x), sample) if x[3] else 0 for x in zip(h, w, c, data, strict=True)])

    return pages.withColumn("n_colours", count("height", "width", "n_channels", "data"))


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """The page turned counter-clockwise on a canvas that holds all of it; nearest pixel, black outside."""
    if degrees % 90 == 0:  # every pixel keeps its neighbours
        return np.rot90(image, int(degrees // 90) % 4)
    h, w = image.shape[:2]
    t = np.radians(degrees)
    c, s = np.cos(t), np.sin(t)
    nh, nw = int(np.ceil(round(abs(w * s) + abs(h * c), 6))), int(np.ceil(round(abs(w * c) + abs(h * s), 6)))
    y, x = np.mgrid[0:nh, 0:nw]
    x, y = x - (nw - 1) / 2, y - (nh - 1) / 2
    sx, sy = np.rint(x * c - y * s + (w - 1) / 2).astype(int), np.rint(x * s + y * c + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.zeros((nh, nw, image.shape[2]), np.uint8)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def exif_orientation(raw: bytes) -> int:
    """The orientation tag (1 to 8) of a JPEG file's Exif segment; 1 where there is none."""
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if raw[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)
            first = number(4, 4)
            for k in range(number(first, 2)):
                entry = first + 2 + 12 * k
                if number(entry, 2) == 0x0112:
                    value = number(entry + 8, 2)
                    return value if 1 <= value <= 8 else 1
            return 1
        at += 2 + size
    return 1


def transposed(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image as an orientation tag says it is to be seen."""
    if orientation in (5, 6, 7, 8):
        image = image.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return np.ascontiguousarray(image)


def orient_pages(pages: DataFrame, orientation: str = "orientation") -> DataFrame:
    return map_pages(pages, lambda image, row: transposed(image, int(row[orientation])))


def png(image: np.ndarray) -> bytes:
    """A PNG file of an image in blue, green, red or of one channel."""
    h, w, c = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), (image[:, :, 2::-1] if c >= 3 else image[:, :, :1]).reshape(h, -1)], 1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c >= 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def with_png(pages: DataFrame) -> DataFrame:
    """Adds ``png``, the page as an image file; null for a page without pixels. A table of these is the image artifact."""

    @F.pandas_udf("binary")
    def made(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([png(pixels(*x)) if x[3] else None for x in zip(h, w, c, data, strict=True)])

    return pages.withColumn("png", made("height", "width", "n_channels", "data"))


def mask_of(logits: np.ndarray) -> np.ndarray:
    """255 where a segmentation's logit is above 0."""
    return np.where(logits > 0, 255, 0).astype(np.uint8)


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    h, w = image.shape[:2]
    return image[max(0, y1) : min(h, y2), max(0, x1) : min(w, x2)]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest pixel."""
    h, w = image.shape[:2]
    return image[np.arange(height) * h // height][:, np.arange(width) * w // width]


def _blend(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels, by the four around each place; places beyond the border take the border's."""
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (v.reshape(v.shape + (1,) * (image.ndim - 2)) for v in (x - x0, y - y0))
    wide = image.astype(float)
    return (wide[y0, x0] * (1 - fx) + wide[y0, x1] * fx) * (1 - fy) + (wide[y1, x0] * (1 - fx) + wide[y1, x1] * fx) * fy


def _as(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255).astype(np.uint8) if kind == np.uint8 else values.astype(kind)


def resize_smooth(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixels as areas: the corners of both images meet, not the centres of their corner pixels."""
    h, w = image.shape[:2]
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    return _as(_blend(image, *np.meshgrid(x, y)), image.dtype)


def rotate_smooth(image: np.ndarray, degrees: float) -> np.ndarray:
    """Like ``rotate``, with values between pixels; black outside."""
    h, w = image.shape[:2]
    t = np.radians(degrees)
    c, s = np.cos(t), np.sin(t)
    nh, nw = int(np.ceil(round(abs(w * s) + abs(h * c), 6))), int(np.ceil(round(abs(w * c) + abs(h * s), 6)))
    y, x = np.mgrid[0:nh, 0:nw]
    x, y = x - (nw - 1) / 2, y - (nh - 1) / 2
    sx, sy = np.round(x * c - y * s + (w - 1) / 2, 9), np.round(x * s + y * c + (h - 1) / 2, 9)
    inside = (sx > -0.5) & (sx < w - 0.5) & (sy > -0.5) & (sy < h - 0.5)
    return _as(np.where(inside.reshape(inside.shape + (1,) * (image.ndim - 2)), _blend(image, sx, sy), 0), image.dtype)


def page_mask(logits: np.ndarray, height: int, width: int) -> np.ndarray:
    """A segmentation's logits, of the size that the network works in, as the mask of a page: enlarged first, then cut at 0."""
    return mask_of(resize_smooth(logits, height, width))


def brightness(image: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(image.astype(float) * factor, 0, 255).astype(np.uint8)


@lru_cache(maxsize=64)
def drawn_pixels(n_pixels: int, sample: int, seed: int) -> np.ndarray:
    """Numbers of the ``sample`` pixels that come first by the hash (48271 i + seed) modulo 2^31 - 1; all of a smaller page."""
    i = np.arange(n_pixels, dtype=np.int64)
    return i if n_pixels <= sample else np.sort(np.argsort((i * 48_271 + seed) % 2_147_483_647, kind="stable")[:sample])


def colours_drawn(n_pixels: int, n_channels: int, data: bytes, sample: int, seed: int) -> int:
    """Distinct colours among the drawn pixels of one page; what lies beyond the end of its bytes is one colour, that of no bytes."""
    at = drawn_pixels(n_pixels, sample, seed)
    whole = len(data) // max(n_channels, 1)
    if n_channels == 3 and whole > at[-1]:
        flat = np.frombuffer(data, np.uint8, 3 * whole).reshape(whole, 3)[at].astype(np.int32)
        codes = np.sort(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2])
        return 1 + int(np.count_nonzero(codes[1:] != codes[:-1]))
    return len({data[i * n_channels : (i + 1) * n_channels] for i in at.tolist()})


def sampled_colours(n_pixels: Column, n_channels: Column, data: Column, sample: int = SAMPLE, seed: int = 17) -> Column:
    """Distinct colours among at most ``sample`` pixels, as a column: those whose numbers come first by a fixed hash.

    The hash of pixel i is (48271 i + seed) modulo 2^31 - 1, so any engine draws
    the same pixels; a worker finds them once for each size of page. A page
    without pixels has none.
    """

    @F.pandas_udf("int")
    def count(n: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([colours_drawn(int(x[0]), int(x[1]), x[2], sample, seed) if x[2] is not None and x[0] > 0 else 0 for x in zip(n, c, d, strict=True)], dtype="int32")

    return count(F.coalesce(n_pixels.cast("long"), F.lit(0).cast("long")), F.coalesce(n_channels.cast("int"), F.lit(0)), data)


def augment(image: np.ndarray, mask: np.ndarray, seed: int, size: int = 512, turn: float = 30.0, light: tuple[float, float] = (0.7, 1.3)) -> tuple[np.ndarray, np.ndarray]:
    """Both resized and turned alike by up to ``turn`` degrees; the image alone is lightened or darkened."""
    rng = np.random.default_rng(seed)
    degrees, factor = rng.uniform(-turn, turn), rng.uniform(*light)
    out = [resize(rotate(resize(x, size, size), degrees), size, size) for x in (image, mask)]
    return brightness(out[0], factor), out[1]


def fill_polygon(points: list[tuple[int, int]], height: int, width: int) -> np.ndarray:
    """A mask of 0 and 255: pixels whose centre lies inside, by the even-odd rule, and the corners."""
    out = np.zeros((height, width), bool)
    if len(points) >= 3:
        xs, ys = np.arange(width)[None, :], np.arange(height)[:, None]
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
            if ay != by:
                cross = (ys >= min(ay, by)) & (ys < max(ay, by)) & (xs < ax + (ys - ay) * (bx - ax) / (by - ay))
                out ^= cross
    for x, y in points:
        if 0 <= x < width and 0 <= y < height:
            out[y, x] = True
    return out.astype(np.uint8) * 255


def largest_region(mask: np.ndarray) -> np.ndarray:
    """(n, 2) pixels (x, y) of the largest connected region (four neighbours); empty for an empty mask."""
    on = mask > 0
    label = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:
        best = label.copy()
        best[1:] = np.maximum(best[1:], label[:-1])
        best[:-1] = np.maximum(best[:-1], label[1:])
        best[:, 1:] = np.maximum(best[:, 1:], label[:, :-1])
        best[:, :-1] = np.maximum(best[:, :-1], label[:, 1:])
        best[~on] = 0
        # jump to the label's own label: regions settle in a logarithmic number of rounds
        flat = np.concatenate([[0], best.ravel()])
        best = flat[best]
        if (best == label).all():
            break
        label = best
    if not on.any():
        return np.empty((0, 2), int)
    ids, n = np.unique(label[on], return_counts=True)
    y, x = np.nonzero(label == ids[n.argmax()])
    return np.stack([x, y], 1)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p, float).reshape(-1, 2)

    def half(seq: list) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def smallest_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners (4, 2) of the smallest rotated rectangle around points; one side lies along the hull."""
    h = hull(points)
    if len(h) < 3:
        lo, hi = (points.min(0), points.max(0)) if len(points) else (np.zeros(2), np.zeros(2))
        return np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]], float)
    best, area = None, np.inf
    for a, b in zip(h, np.roll(h, -1, 0), strict=True):
        u = (b - a) / np.linalg.norm(b - a)
        v = np.array([-u[1], u[0]])
        s, t = h @ u, h @ v
        size = (s.max() - s.min()) * (t.max() - t.min())
        if size < area:
            area = size
            best = np.array([x * u + y * v for x, y in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))])
    return best


def mask_corners(height: Column, width: Column, mask: Column) -> Column:
    """Corners of the smallest rectangle around the largest region of a mask; the whole page for an empty one."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def corners(h: pd.Series, w: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for height, width, data in zip(h, w, m, strict=True):
            region = largest_region(np.frombuffer(data, np.uint8).reshape(height, width)) if data else np.empty((0, 2))
            box = smallest_rectangle(region) if len(region) else np.array([[0, 0], [width, 0], [width, height], [0, height]], float)
            out.append([{"x": float(x), "y": float(y)} for x, y in box])
        return pd.Series(out)

    return corners(height, width, mask)


def map_pages(pages: DataFrame, change: Callable[[np.ndarray, pd.Series], np.ndarray]) -> DataFrame:
    """Replaces each page's pixels by ``change(image, row)``; pages without pixels stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            for i, row in pdf.iterrows():
                if row["data"]:
                    image = change(pixels(row["height"], row["width"], row["n_channels"], row["data"]), row)
                    pdf.at[i, "height"], pdf.at[i, "width"], pdf.at[i, "data"] = image.shape[0], image.shape[1], image.tobytes()
            yield pdf

    return pages.mapInPandas(run, pages.schema)


def turn_pages(pages: DataFrame, degrees: str = "turn") -> DataFrame:
    return map_pages(pages, lambda image, row: rotate(image, float(row[degrees])))


def crop_pages(pages: DataFrame) -> DataFrame:
    """Crops to cx1, cy1, cx2, cy2."""
    return map_pages(pages, lambda image, row: crop(image, int(row["cx1"]), int(row["cy1"]), int(row["cx2"]), int(row["cy2"])))
