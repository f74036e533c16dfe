"""From page images to receipts: the gate, the chains that straighten and crop pages, reading, labelling, documents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.functions.geometry import normalise, unnormalise
from quittance.operators.detection import first_box
from quittance.operators.images import crop, distinct_colours, rotate, with_colours
from quittance.operators.lines import segment_lines
from quittance.operators.models import DETECTIONS, READING, ModelRegistry, ModelScorer, detect_on_page, read_page
from quittance.operators.orientation import mean_confidence, turn_of
from quittance.operators.pages import LEAST_COLOURS, needs_preprocessing
from quittance.operators.receipt import correct_entries, receipt_documents
from quittance.operators.scorers import PAGE, Config, Scorer, crop_by_detection, crop_by_segmentation, label_tokens, read_upside_up, straighten
from quittance.sources.shared import cut

#: Sees the pages after each step, by the step's name.
Dump = Callable[[str, DataFrame], None]
#: A chain gives the pages and, where it has read them already, their tokens.
Chain = Callable[[DataFrame, Scorer, Dump], tuple[DataFrame, DataFrame | None]]


def detection_chain(pages: DataFrame, scorer: Scorer, dump: Dump) -> tuple[DataFrame, DataFrame | None]:
    """Straightens twice, so that the crop lies close, crops to the detected receipt, and turns it upside up.

    The text that decided which side is up is kept, so pages are not read again.
    Every step reads its pages more than once, so each is cut before the next.
    """
    rotated = cut(straighten(cut(straighten(pages, scorer)), scorer))
    dump("rotated", rotated)
    cropped = cut(crop_by_detection(rotated, scorer))
    dump("cropped", cropped)
    upright, tokens = (cut(x) for x in read_upside_up(cropped, scorer))
    dump("rotated2", upright)
    return upright, tokens


def segmentation_chain(pages: DataFrame, scorer: Scorer, dump: Dump) -> tuple[DataFrame, DataFrame | None]:
    """Turns the smallest rectangle around the receipt's mask upright and crops to it."""
    cropped = cut(crop_by_segmentation(pages, scorer, dump))
    dump("cropped", cropped)
    return cropped, None


CHAINS: dict[str, Chain] = {"detection": detection_chain, "segmentation": segmentation_chain}


def read_pages(pages: DataFrame, scorer: Scorer, algorithm: str | None = "detection", enabled: bool = True, dump: Dump | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, tokens): photos go through the chain of ``algorithm``, all other pages, and all without one, are read as they are.

    Pages are parted before the chain runs: Spark may call a Python function even
    where a condition would not need it.
    """
    wanted, dump = dump is not None, dump or (lambda name, df: None)
    if algorithm is None or not enabled:
        return pages, scorer.read_text(pages)
    dump("original", pages)
    gated = cut(with_colours(pages).withColumn("_gate", needs_preprocessing(F.col("filename"), F.col("n_colours"))))
    photos, others = (gated.where(c).drop("_gate", "n_colours") for c in (F.col("_gate"), ~F.col("_gate")))
    if not wanted and photos.isEmpty():  # nothing for the chain to do, whose every step would read all scores again
        return others.select(*pages.columns), scorer.read_text(others)
    done, tokens = CHAINS[algorithm](photos, scorer, dump)
    tokens = scorer.read_text(done) if tokens is None else tokens
    after = done.select(*pages.columns).unionByName(others)
    dump("after", after)
    return after, tokens.unionByName(scorer.read_text(others))


def tokens_by_page(pages: DataFrame, scorer: ModelScorer) -> DataFrame:
    """Tokens, with the size of their page, by the detection chain as ``read_pages`` runs it, each page in its row from the gate to its text.

    Nothing is joined, so no step has to be cut, and a task holds the pixels of a
    few small batches, whatever the number of pages.
    """
    text = {"found": READING}
    quads = F.transform("found", lambda t: t["quad"])
    straight = lambda image, row: rotate(image, row.turn) if row.photo and image.size else image

    def count_and_look(registry: ModelRegistry, image: np.ndarray, row: tuple) -> tuple[np.ndarray, list]:
        n = distinct_colours(image) if image.size else 0
        return image, [n, read_page(registry, image, False) if row.photo and n >= LEAST_COLOURS else []]

    def turn_and_look(registry: ModelRegistry, image: np.ndarray, row: tuple) -> tuple[np.ndarray, list[list]]:
        image = straight(image, row)
        return image, [read_page(registry, image, False) if row.photo else []]

    def turn_and_detect(registry: ModelRegistry, image: np.ndarray, row: tuple) -> tuple[np.ndarray, list[list]]:
        image = straight(image, row)
        return image, [detect_on_page(registry, image) if row.photo else []]

    def read_both_ways(registry: ModelRegistry, image: np.ndarray, row: tuple) -> tuple[None, list]:
        image = crop(image, row.x1, row.y1, row.x2, row.y2) if row.photo and image.size else image
        turned = rotate(image, 180.0) if image.size else image
        return None, [*image.shape[:2], read_page(registry, image), read_page(registry, turned) if row.photo else []]

    gate = lambda n: needs_preprocessing(F.col("filename"), n)
    named = pages.select(*PAGE, "filename", "height", "width", "n_channels", "data", gate(F.lit(LEAST_COLOURS)).alias("photo"))
    seen = scorer.on_pages(named, count_and_look, n_colours="int", **text).withColumns({"photo": gate(F.col("n_colours")), "turn": turn_of(quads)}).drop("found", "filename", "n_colours")
    turned = scorer.on_pages(seen, turn_and_look, **text).withColumn("turn", turn_of(quads)).drop("found")
    straightened = scorer.on_pages(turned, turn_and_detect, found=DETECTIONS).withColumns(first_box(F.col("found"), F.col("width"), F.col("height"))).drop("found", "turn")
    done = scorer.on_pages(straightened, read_both_ways, rows="int", columns="int", own=READING, other=READING)
    better = F.when(mean_confidence(F.col("own")) < mean_confidence(F.col("other")), F.col("other")).otherwise(F.col("own"))
    return done.select(*PAGE, F.col("columns").alias("width"), F.col("rows").alias("height"), F.explode(better).alias("t")).select(*PAGE, "t.*", "width", "height")


def token_entries(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Entries with boxes in whole pixels, by way of the thousandths of the page that labelers take."""
    return sized_entries(tokens.join(pages.select(*PAGE, "width", "height"), PAGE))


def sized_entries(sized: DataFrame) -> DataFrame:
    """``token_entries`` of tokens that have the width and height of their page."""
    sized = sized.withColumns({f"_{k}": v for k, v in normalise(F.col("quad"), F.col("width"), F.col("height")).items()})
    box = {k: unnormalise(F.col(f"_{k}"), F.col("width" if k[0] == "x" else "height")).cast("long") for k in ("x1", "y1", "x2", "y2")}
    return sized.withColumns(box).drop("_x1", "_y1", "_x2", "_y2", "width", "height")


def labelled_entries(pages: DataFrame, scorer: Scorer, algorithm: str | None = "detection", dump: Dump | None = None) -> DataFrame:
    """Labelled entries of page images. Models that are called by page keep each page in its row; other scorers, and who dumps steps, need tables."""
    if dump is None and isinstance(scorer, ModelScorer) and CHAINS.get(algorithm) is detection_chain:
        entries = sized_entries(tokens_by_page(pages, scorer))
    else:
        entries = token_entries(*read_pages(pages, scorer, algorithm, dump=dump))
    return label_tokens(entries, scorer).drop("chunk", "copy")


def image_entries(pages: DataFrame, scorer: Scorer, config: Config | None = None, algorithm: str | None = "detection", dump: Dump | None = None) -> DataFrame:
    """Labelled, segmented and corrected entries of page images."""
    config = config or Config()
    entries = labelled_entries(pages, scorer, algorithm, dump)
    # documents read entries once; who dumps steps reads them again
    return correct_entries(segment_lines(cut(entries) if dump else entries, config.order))


def image_receipts(pages: DataFrame, scorer: Scorer, config: Config | None = None, algorithm: str | None = "detection", dump: Dump | None = None) -> DataFrame:
    """The default chain: (receipt_id, json) from page images."""
    return receipt_documents(image_entries(pages, scorer, config, algorithm, dump))


def choose_device(available: tuple[str, ...], wanted: str | None = None) -> str:
    """The wanted device where it is available, else the first of cuda, mps and cpu that is."""
    if wanted and wanted in available:
        return wanted
    return next((d for d in ("cuda", "mps") if d in available), "cpu")
