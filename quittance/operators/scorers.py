"""Model calls behind an interface, and the steps around them.

No weights come with this library. A scorer turns a frame of pages or tokens
into a frame with scores; ``FixtureScorer`` reads them from tables, and any
object with the same methods (for example one that runs a network in
``mapInPandas``, loaded once per worker) can stand in.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.functions.geometry import crop_window, rotate, upright_turn
from quittance.operators.contours import contour_corners, contour_pages
from quittance.operators.detection import chunks, pick_detection
from quittance.operators.images import crop_pages, turn_pages
from quittance.operators.orientation import choose_upside, page_turns, upside_tokens
from quittance.sources.shared import cut

PAGE = ["receipt_id", "page_no"]


class Scorer(Protocol):
    def read_text(self, pages: DataFrame, recognise: bool = True) -> DataFrame:
        """(receipt_id, page_no, seq, quad, text, ocr_milli) of pages; text is empty where only detection is asked for."""

    def detect(self, pages: DataFrame) -> DataFrame:
        """(receipt_id, page_no, query, probs, cx, cy, w, h, width, height)."""

    def segment(self, pages: DataFrame) -> DataFrame:
        """(receipt_id, page_no, height, width, mask)."""

    def label(self, tokens: DataFrame) -> DataFrame:
        """``tokens``, which have a chunk, with labels: three of (label_id, label, prob_milli)."""


@dataclass
class FixtureScorer:
    """Scores read from tables by page, or by token; without a table of labels, tokens have theirs beside them."""

    tokens: DataFrame | None = None
    detections: DataFrame | None = None
    masks: DataFrame | None = None
    labels: DataFrame | None = None

    def read_text(self, pages: DataFrame, recognise: bool = True) -> DataFrame:
        own = self.tokens.join(pages.select(*PAGE), PAGE, "left_semi")
        return own if recognise else own.withColumn("text", F.lit(""))

    def detect(self, pages: DataFrame) -> DataFrame:
        if self.detections is None:  # no query for any page
            return pages.where(F.lit(False)).selectExpr(*PAGE, "0 query", "array(0d, 0d) probs", "0d cx", "0d cy", "0d w", "0d h", "width", "height")
        return self.detections.join(pages.select(*PAGE), PAGE, "left_semi")

    def segment(self, pages: DataFrame) -> DataFrame:
        return self.masks.join(pages.select(*PAGE), PAGE, "left_semi")

    def label(self, tokens: DataFrame) -> DataFrame:
        if self.labels is None:
            return tokens
        return tokens.join(self.labels.select(*PAGE, "seq", "labels"), [*PAGE, "seq"])


def straighten(pages: DataFrame, scorer: Scorer, turn: Callable[[DataFrame], DataFrame] = turn_pages) -> DataFrame:
    """Turns pages by their mean skew, and by 90 degrees where most text stands upright; pages without text stay."""
    found = page_turns(scorer.read_text(pages, recognise=False)).select(*PAGE, (F.when(F.col("sideways"), 90.0).otherwise(0.0) - F.col("skew")).alias("turn"))
    return turn(pages.join(found, PAGE, "left").withColumn("turn", F.coalesce("turn", F.lit(0.0)))).drop("turn")


def read_upside_up(pages: DataFrame, scorer: Scorer, turn: Callable[[DataFrame], DataFrame] = turn_pages) -> tuple[DataFrame, DataFrame]:
    """(pages, tokens): each page read as it is and turned by 180 degrees; the better reading stays, so text is not read again."""
    turned = turn(pages.withColumn("turn", F.lit(180.0))).drop("turn")
    variants = scorer.read_text(pages).withColumn("turned", F.lit(False)).unionByName(scorer.read_text(turned).withColumn("turned", F.lit(True)))
    choice = choose_upside(variants).select(*PAGE, "turned")
    both = pages.withColumn("turned", F.lit(False)).unionByName(turned.withColumn("turned", F.lit(True)))
    chosen = both.join(choice, PAGE, "left").where(both["turned"] == F.coalesce(choice["turned"], F.lit(False))).drop("turned")
    return chosen, upside_tokens(variants).drop("turned")


def crop_by_detection(pages: DataFrame, scorer: Scorer) -> DataFrame:
    """Crops pages to the first receipt that is detected; the whole page where there is none."""
    found = pick_detection(scorer.detect(pages), tuple(PAGE)).select(*PAGE, *[F.col(c).cast("int").alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")])
    whole = {"cx1": F.coalesce("cx1", F.lit(0)), "cy1": F.coalesce("cy1", F.lit(0)), "cx2": F.coalesce("cx2", "width"), "cy2": F.coalesce("cy2", "height")}
    return crop_pages(pages.join(found, PAGE, "left").withColumns(whole)).drop("cx1", "cy1", "cx2", "cy2")


def crop_by_segmentation(pages: DataFrame, scorer: Scorer, dump: Callable[[str, DataFrame], None] | None = None, padding: float = 0.0) -> DataFrame:
    """Turns the smallest rectangle around the receipt's largest contour upright and crops to it; ``dump`` sees it drawn."""
    m = scorer.segment(pages)
    if dump:
        dump("contour", contour_pages(m, padding))
    m = m.withColumn("corners", contour_corners(F.col("height"), F.col("width"), F.col("mask"), padding))
    m = m.withColumn("turn", upright_turn(F.col("corners")))
    m = m.withColumn("after", rotate(F.col("corners"), F.col("width"), F.col("height"), F.col("turn")))
    found = m.select(*PAGE, "turn", "after")
    turned = turn_pages(pages.join(found, PAGE))
    return crop_pages(turned.withColumns(crop_window(F.col("after"), F.col("width"), F.col("height")))).drop("turn", "after", "cx1", "cy1", "cx2", "cy2")


def label_tokens(tokens: DataFrame, scorer: Scorer, words: int | None = 10, duplicate_tail: bool = False) -> DataFrame:
    """Labels tokens in windows of ``words`` words; None labels a page in one window."""
    dealt = chunks(tokens, words=words, duplicate_tail=duplicate_tail) if words else tokens.withColumns({"chunk": F.lit(0).cast("long"), "copy": F.lit(0)})
    return scorer.label(dealt)


@dataclass
class Config:
    """``save_results`` writes the result of each step below ``data_dir``; the device is what model loaders are told."""

    save_results: bool = False
    data_dir: str = "data"
    device: str = "cpu"
    order: str = "ocr"
    all_pages: bool = False

    def dump(self) -> Callable[[str, DataFrame], None] | None:
        from quittance.sources.writers import write_stage

        return (lambda name, df: write_stage(df, self.data_dir, name)) if self.save_results else None


@dataclass
class Pipeline:
    """An ordered list of steps on pages, then on entries, then on receipts; ``dump`` sees the result of each."""

    page_steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    receipt_step: Callable[[DataFrame], DataFrame] | None = None
    dump: Callable[[str, DataFrame], None] | None = None

    def _steps(self) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
        steps = [*self.page_steps, *([self.receipt_step] if self.receipt_step else [])]
        return [(f"{k}-{getattr(step, '__name__', 'step').strip('<>')}", step) for k, step in enumerate(steps)]

    def run(self, entries: DataFrame) -> DataFrame:
        for name, step in self._steps():
            entries = entries.transform(step)
            if self.dump:
                self.dump(name, entries)
        return entries

    def run_timed(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the result, (step, n_rows, seconds) of each step): every step is computed and cut before the next begins."""
        taken = []
        for name, step in self._steps():
            began = time.perf_counter()
            entries = cut(entries.transform(step))
            seconds = time.perf_counter() - began
            taken.append((name, entries.count(), seconds))
            if self.dump:
                self.dump(name, entries)
        return entries, entries.sparkSession.createDataFrame(taken, "step string, n_rows long, seconds double")


def pipeline(name: str = "default", config: Config | None = None, scorer: Scorer | None = None, algorithm: str | None = "detection") -> Pipeline:
    """The registered pipelines: "default" gives nested documents, "ocr_lilt" the entry list of the first page.

    With a ``scorer`` they begin at page images, "default" with the chain of
    ``algorithm`` before the reading and "ocr_lilt" without one; else they begin
    at labelled entries.
    """
    from quittance.operators.lines import segment_lines
    from quittance.operators.preocr import image_entries, labelled_entries
    from quittance.operators.receipt import correct_entries, entry_documents, receipt_documents

    config = config or Config()
    dump = config.dump()
    if name == "default":
        if scorer is not None:
            return Pipeline([lambda pages: image_entries(pages, scorer, config, algorithm, dump)], receipt_documents, dump)
        return Pipeline([lambda e: segment_lines(e, config.order), correct_entries], receipt_documents, dump)
    if name == "ocr_lilt":
        first = [] if scorer is None else [lambda pages: labelled_entries(pages, scorer, None)]
        return Pipeline(first, lambda e: entry_documents(e, config.all_pages), dump)
    raise ValueError(f"no pipeline {name!r}; there are default and ocr_lilt")
