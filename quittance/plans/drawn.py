"""Receipt pages with real pixels, made from customers, and models that read them.

A page is a sheet of paper on a photo: three lines of text, a cell of two by
six pixels for each character, whose colour is the character's code. The photo
is turned by a multiple of 90 degrees and the paper lies elsewhere in each; a
seventh of the pages are scans in few colours. The models know nothing of the
customers: they find text, paper and labels in the pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.functions.labels import LABELS
from quittance.operators import images
from quittance.operators.models import ModelRegistry, ModelScorer
from quittance.operators.preocr import image_entries
from quittance.plans import derived as D
from quittance.sources.readers import PAGE_SCHEMA

#: Pixels of a side of the photo and of the paper on it; where the first line is, and how far the next.
PHOTO, PAPER, LEFT, TOP, LEADING = 128, 64, 4, 6, 16
CELL_WIDTH, CELL_HEIGHT = 2, 6
#: Levels of the first channel: paper, and the upper edge of a character, which tells which side is up.
SHEET, EDGE = 200, 255
INK = 255
#: Pages that are drawn before they are passed on: customers are small, so a batch of them is many, and pixels are not.
DRAWN = 64


def draw(key: int, lines: list[str]) -> np.ndarray:
    """The photo of a customer's receipt."""
    y, x = np.mgrid[0:PHOTO, 0:PHOTO]
    scan = key % 7 == 0
    image = np.stack([x * 0 + SHEET, x * 0, x * 0] if scan else [(x + y) % 64, (3 * x + key) % 200, y], axis=-1).astype(np.uint8)
    left, top = (0, 0) if scan else (16 + key % 16, 8 + key % 24)
    if not scan:
        sheet = image[top : top + PAPER, left : left + PAPER]
        sheet[..., 0], sheet[..., 1] = SHEET, sheet[..., 1] % 100
    for i, text in enumerate(lines):
        cells = np.repeat(np.frombuffer(text.encode("latin-1"), np.uint8), CELL_WIDTH)
        y0, x0 = top + TOP + LEADING * i, left + LEFT
        at = image[y0 : y0 + CELL_HEIGHT, x0 : x0 + len(cells)]
        at[..., 0], at[..., 1], at[..., 2] = SHEET, INK, cells
        at[0, :, 0] = EDGE
    return image if scan else np.rot90(image, key % 4)


def drawn_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each customer: store, date and total."""
    c = F.col("c_custkey")
    # dealt out while rows are small: a small file is one task, and pixels are what costs
    rows = D.table(spark, d, "customer").repartition(spark.sparkContext.defaultParallelism).select(
        c.alias("receipt_id"),
        F.concat(F.lit("Store "), (c % 50).cast("string")).alias("a"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (c % 700).cast("int")), "dd/MM/yyyy").alias("b"),
        F.regexp_replace(F.format_string("%.2f", F.abs("c_acctbal")), r"\.", ",").alias("c"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), DRAWN):
                own = batch.iloc[at : at + DRAWN]
                yield pd.DataFrame({
                    "receipt_id": own["receipt_id"], "page_no": 0, "filename": [f"c{k}.jpg" for k in own["receipt_id"]], "height": PHOTO, "width": PHOTO, "n_channels": 3,
                    "data": [np.ascontiguousarray(draw(r.receipt_id, [r.a, r.b, r.c])).tobytes() for r in own.itertuples(index=False)],
                })

    return rows.mapInPandas(run, PAGE_SCHEMA.replace("receipt_id string", "receipt_id long"))


def text_boxes(ink: np.ndarray, x: int = 0, y: int = 0) -> list[tuple[int, int, int, int]]:
    """Boxes of ink, from top to bottom, by cutting along empty rows and columns until none is left."""
    rows, cols = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
    if not len(rows):
        return []
    ink = ink[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
    x, y = x + int(cols[0]), y + int(rows[0])
    for axis, empty in ((0, ~ink.any(1)), (1, ~ink.any(0))):
        if empty.any():
            at = int(np.flatnonzero(empty)[0])
            one, two = (ink[:at], ink[at:]) if axis == 0 else (ink[:, :at], ink[:, at:])
            return text_boxes(one, x, y) + text_boxes(two, x + at * axis, y + at * (1 - axis))
    return [(x, y, x + ink.shape[1], y + ink.shape[0])]


def read(image: np.ndarray, recognise: bool) -> list[tuple]:
    """Text by the colours of its cells; what stands upside down is read backwards and believed less."""
    found = []
    for x1, y1, x2, y2 in text_boxes(image[..., 1] == INK):
        text = image[(y1 + y2) // 2, x1:x2:CELL_WIDTH, 2].tobytes().decode("latin-1") if recognise else ""
        up = image[y1, x1, 0] == EDGE
        found.append(([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], text, 0.95 if up else 0.3))
    return found


def detect(image: np.ndarray) -> list[tuple]:
    """The box of all paper, as a share of the page, and a box that is not to be believed."""
    paper = image[..., 0] >= SHEET
    rows, cols = np.flatnonzero(paper.any(1)), np.flatnonzero(paper.any(0))
    h, w = paper.shape
    y1, y2, x1, x2 = int(rows[0]), int(rows[-1]) + 1, int(cols[0]), int(cols[-1]) + 1
    return [((0.5, 0.3, 0.2), 0.5, 0.5, 1.0, 1.0), ((0.01, 0.98, 0.01), (x1 + x2) / 2 / w, (y1 + y2) / 2 / h, (x2 - x1) / w, (y2 - y1) / h)]


def label(words: list[str], boxes: list[list[int]]) -> list[list[tuple]]:
    """Store, date or total by the characters of a word."""
    names = {i: name for i, name, *_ in LABELS}
    ids = [20 if w.startswith("Store") else 2 if "/" in w else 71 for w in words]
    return [[(i, names[i], 0.9), (0, names[0], 0.06), (6, names[6], 0.04)] for i in ids]


def drawn_scorer(device: str = "cpu") -> ModelScorer:
    registry = ModelRegistry(device)
    for name, model in (("reader", read), ("detector", detect), ("labeler", label)):
        registry.register(name, lambda device, model=model: model)
    return ModelScorer(registry)


def q_image_chain(spark: SparkSession, d: str) -> DataFrame:
    """Photos and scans to labelled, typed entries: gate, turns, crop, upside, reading, labels, lines.

    Five sevenths or more of the pages are turned or cropped on the way: every
    photo is cropped, three in four are turned.
    """
    e = image_entries(drawn_pages(spark, d), drawn_scorer())
    return e.select(
        "receipt_id", "page_no", "seq", "line_no", "text", "x1", "y1", "x2", "y2", "ocr_milli", F.col("labels")[0]["label"].alias("label"),
        F.col("corrected_date").cast("string").alias("corrected_date"), "corrected_num",
    )


#: Pixels of a side of the pages whose colours are sampled: over twice the sample.
SIDE = 64


def _coloured(keys: pd.Series) -> pd.Series:
    """The pixels of customers' pages: pixel i of customer k has the colour (7 i + (i // SIDE) k) modulo (k modulo 400 + 1)."""
    i = np.arange(SIDE * SIDE, dtype=np.int64)
    pages = ((i * 7 + i // SIDE * k) % (k % 400 + 1) for k in keys.tolist())
    return pd.Series([code.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes() for code in pages], dtype=object)


def q_colour_sample(spark: SparkSession, d: str) -> DataFrame:
    """Colours of pages of more pixels than are sampled; each has as many as its customer's number says, up to some hundreds."""
    k = F.col("c_custkey")
    # dealt out while rows are small: pixels are what costs
    own = D.table(spark, d, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    pages = own.select(k.alias("receipt_id"), F.pandas_udf(_coloured, "binary")(k).alias("data"))
    n = images.sampled_colours(F.lit(SIDE * SIDE), F.lit(3), F.col("data"))
    return pages.select("receipt_id", n.cast("long").alias("n_colours")).withColumn("photo", F.col("n_colours") >= 100)


def _pixel(v: str) -> str:
    """A place on the page after the way through thousandths of it."""
    return f"round_even(side * (trunc(1000 * ({v})::DOUBLE / side) / 1000), 0)::BIGINT"


_X2, _Y1 = f"{LEFT} + {CELL_WIDTH} * length(text)", f"{TOP} + {LEADING} * seq"
SQL = {
    "q_colour_sample": f"""WITH p AS (SELECT range AS i, row_number() OVER (ORDER BY (range * 48271 + 17) % 2147483647, range) AS place FROM range({SIDE * SIDE})),
n AS (SELECT c_custkey AS receipt_id, count(DISTINCT (i * 7 + (i // {SIDE}) * c_custkey) % (c_custkey % 400 + 1)) AS n_colours FROM customer, p WHERE place <= {images.SAMPLE} GROUP BY c_custkey)
SELECT receipt_id, n_colours, n_colours >= 100 AS photo FROM n""",
    "q_image_chain": f"""WITH c AS (SELECT c_custkey AS receipt_id, CASE WHEN c_custkey % 7 = 0 THEN {PHOTO} ELSE {PAPER} END AS side,
  ['Store ' || (c_custkey % 50)::VARCHAR, strftime(DATE '2023-01-01' + (c_custkey % 700)::INT, '%d/%m/%Y'), replace(printf('%.2f', abs(c_acctbal)), '.', ',')] AS t FROM customer),
e AS (SELECT receipt_id, side, unnest([0, 1, 2]) AS seq, unnest(t) AS text FROM c),
b AS (SELECT *, {_pixel(str(LEFT))} AS x1, {_pixel(_Y1)} AS y1,
  round_even(side * (trunc(1000 * {LEFT}::DOUBLE / side + (1000 * ({_X2})::DOUBLE / side - 1000 * {LEFT}::DOUBLE / side)) / 1000), 0)::BIGINT AS x2,
  round_even(side * (trunc(1000 * ({_Y1})::DOUBLE / side + (1000 * ({_Y1} + {CELL_HEIGHT})::DOUBLE / side - 1000 * ({_Y1})::DOUBLE / side)) / 1000), 0)::BIGINT AS y2 FROM e)
SELECT receipt_id, 0 AS page_no, seq, seq AS line_no, text, x1, y1, x2, y2, 950 AS ocr_milli,
  CASE seq WHEN 0 THEN 'I-store.name' WHEN 1 THEN 'I-date_value' ELSE 'I-total.price' END AS label,
  CASE WHEN seq = 1 THEN ({D.date_sql('text')})::VARCHAR END AS corrected_date, CASE WHEN seq = 2 THEN {D.price_sql('text')} END AS corrected_num FROM b""",
}

QUERIES = {f.__name__: f for f in (q_image_chain, q_colour_sample)}
