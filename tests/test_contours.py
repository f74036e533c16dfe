import numpy as np
import pytest
from pyspark.sql import functions as F

from quittance.functions import geometry
from quittance.operators import contours, images, models, preocr


def rectangle(h, w, *boxes):
    out = np.zeros((h, w), np.uint8)
    for x1, y1, x2, y2 in boxes:
        out[y1:y2, x1:x2] = 255
    return out


def flood(on, starts, steps):
    seen, todo = set(starts), list(starts)
    while todo:
        y, x = todo.pop()
        for dy, dx in steps:
            p = (y + dy, x + dx)
            if 0 <= p[0] < on.shape[0] and 0 <= p[1] < on.shape[1] and on[p] and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = (*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.7, 0.9])
def test_borders_against_flood_fill(share):
    rng = np.random.default_rng(int(share * 10))
    for _ in range(30):
        on = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < share
        wide = np.zeros((on.shape[0] + 2, on.shape[1] + 2), bool)
        wide[1:-1, 1:-1] = on
        outside = flood(~wide, [(0, 0)], FOUR)
        want, left = [], {(int(y) + 1, int(x) + 1) for y, x in zip(*np.nonzero(on), strict=True)}
        while left:
            region = flood(wide, [min(left)], EIGHT)
            left -= region
            border = {(y, x) for y, x in region if any((y + a, x + b) in outside for a, b in FOUR)}
            if border:
                want.append(border)
        got = contours.outer_contours(on.astype(np.uint8) * 255)
        assert [{(y + 1, x + 1) for x, y in c.tolist()} for c in got] == want
        for c in got:
            steps = np.abs(c - np.roll(c, -1, 0)).max(1)
            assert len(c) == 1 or (steps == 1).all()


def test_the_largest_by_area_within_the_border():
    # a thin frame has fewer pixels than a block, but encloses more
    mask = rectangle(60, 80, (2, 2, 42, 42))
    mask[4:40, 4:40] = 0
    mask[10:20, 10:20] = 255  # in the frame's hole: no outer border
    mask[2:27, 50:75] = 255
    found = contours.outer_contours(mask)
    assert [contours.contour_area(c) for c in found] == [39.0 * 39, 24.0 * 24]
    assert contours.largest_contour(mask).max(0).tolist() == [41, 41]
    assert contours.largest_contour(mask * 0).shape == (0, 2)
    assert contours.contour_area(np.array([[3, 3]])) == 0
    assert sorted(map(tuple, contours.receipt_corners(mask).tolist())) == [(2, 2), (2, 41), (41, 2), (41, 41)]
    assert contours.receipt_corners(mask * 0).tolist() == [[0, 0], [80, 0], [80, 60], [0, 60]]


def test_simplified_borders_stay_close():
    border = contours.largest_contour(rectangle(40, 50, (5, 6, 30, 20), (20, 10, 45, 33)))
    assert len(contours.simplify(border, 0.0)) == 10  # inner corners are cut across
    y, x = np.mgrid[0:80, 0:80]
    disc = contours.largest_contour(np.where((x - 40) ** 2 + (y - 40) ** 2 <= 900, 255, 0))
    for tolerance in (0.5, 1.0, 3.0, 10.0):
        few = contours.simplify(disc, tolerance)
        ends = np.roll(few, -1, 0)
        far = []
        for p in disc:
            d = ends - few
            t = np.clip(((p - few) * d).sum(1) / np.maximum(1e-9, (d * d).sum(1)), 0, 1)
            far.append(np.hypot(*(few + d * t[:, None] - p).T).min())
        assert max(far) <= tolerance + 1e-9
        assert len(few) < len(disc)
    assert len(contours.simplify(disc, 3.0)) < len(contours.simplify(disc, 0.5))
    assert contours.simplify(np.array([[1, 1]]), 1).tolist() == [[1, 1]]


def test_padding_along_the_ray(spark):
    box = np.array([[0, 0], [30, 0], [30, 40], [0, 40.0]])
    want = box + np.array([[-3, -4], [3, -4], [3, 4], [-3, 4]])
    assert contours.pad(box, 5) == pytest.approx(want)
    row = spark.createDataFrame([([(float(x), float(y)) for x, y in box],)], "c array<struct<x:double,y:double>>").select(geometry.pad(F.col("c"), 5).alias("p"), geometry.pad(F.transform("c", lambda p: F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))), 5).alias("q")).first()
    assert np.array([(p.x, p.y) for p in row.p]) == pytest.approx(want)
    assert [(p.x, p.y) for p in row.q] == [(1.0, 1.0)] * 4


def test_segmentation_chain_shows_its_contour(spark):
    page = np.zeros((40, 60, 3), np.uint8)
    page[10:30, 20:50] = (200, 50, 7)
    rows = [("r", 0, "a.jpg", 40, 60, 3, bytearray(page.tobytes()))]
    pages = spark.createDataFrame(rows, "receipt_id string, page_no int, filename string, height int, width int, n_channels int, data binary")
    registry = models.ModelRegistry()
    registry.register("segmenter", lambda device: lambda image: images.page_mask(np.where(image[::2, ::2, 0] > 100, 9.0, -9.0), *image.shape[:2]))
    seen = {}
    cropped, tokens = preocr.segmentation_chain(pages, models.ModelScorer(registry), lambda name, df: seen.__setitem__(name, df.collect()))
    assert tokens is None and set(seen) == {"contour", "cropped"}
    drawn = images.pixels(40, 60, 3, seen["contour"][0].data)
    assert (drawn == (0, 255, 0)).all(2).any() and seen["contour"][0].n_channels == 3
    row = cropped.first()
    assert abs(row.height - 30) <= 2 and abs(row.width - 20) <= 2 or abs(row.height - 20) <= 2 and abs(row.width - 30) <= 2


def test_values_between_pixels():
    image = np.array([[0, 100], [200, 40]], float)
    assert images.resize_smooth(image, 2, 2).tolist() == image.tolist()
    wide = images.resize_smooth(image, 2, 4)
    assert wide[0].tolist() == [0, 25, 75, 100]
    y, x = np.mgrid[0:20, 0:30]
    ramp = np.stack([x * 8, y * 8, x * 0 + 9], -1).astype(np.uint8)
    big = images.resize_smooth(ramp, 40, 60)
    assert big.shape == (40, 60, 3) and big.dtype == np.uint8
    assert np.abs(big[2:-2, 2:-2, 0].astype(float) - ((np.arange(2, 58) + 0.5) / 2 - 0.5) * 8).max() <= 0.5
    for k in range(4):
        assert (images.rotate_smooth(ramp, 90.0 * k) == images.rotate(ramp, 90.0 * k)).all()
        assert (images.rotate_smooth(ramp, 90.0 * k) == np.rot90(ramp, k)).all()
    turned = images.rotate_smooth(ramp, 30)
    assert turned.shape == images.rotate(ramp, 30).shape
    close = np.abs(turned.astype(int) - images.rotate(ramp, 30)).max(2)
    assert np.median(close) <= 4
    mask = images.page_mask(np.where(np.arange(16)[None, :] < 8, 1.0, -1.0) * np.ones((16, 1)), 50, 100)
    assert mask.shape == (50, 100) and (mask[:, :50] == 255).all() and (mask[:, 50:] == 0).all()


def test_sampled_colours(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h, w, colours in ((50, 60, 3000), (50, 60, 7), (10, 10, 60), (1, 1, 1)):
        data = rng.integers(0, colours, h * w)
        rows.append((h * w, 3, bytearray(np.stack([data % 256, data // 256, data * 0], 1).astype(np.uint8).tobytes()), data.tolist()))
    df = spark.createDataFrame([(n, c, d) for n, c, d, _ in rows] + [(5, 3, None), (0, 3, bytearray())], "n int, c int, d binary")
    got = [r[0] for r in df.select(images.sampled_colours(F.col("n"), F.col("c"), F.col("d"))).collect()]
    want = []
    for n, _, _, data in rows:
        order = sorted(range(n), key=lambda i: ((48271 * i + 17) % 2147483647, i))[:2000]
        want.append(len({data[i] for i in order}))
    assert got == [*want, 0, 0]
