"""Pages: the pre-processing gate and the algorithm it leads to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewer distinct sampled colours than this is a scan or a drawing, not a photo.
LEAST_COLOURS = 100


def needs_preprocessing(filename: Column, n_colours: Column, enabled: bool = True, any_case: bool = True) -> Column:
    """Photos only: not if switched off, not for PDF pages, not for pages of few colours.

    PDF pages are told by ``.pdf`` in the name, in any case unless ``any_case`` is off.
    """
    name = F.lower(filename) if any_case else filename
    return F.when(F.lit(not enabled), False).when(name.contains(".pdf"), False).when(n_colours < LEAST_COLOURS, False).otherwise(True)


def page_names(pdf: DataFrame) -> DataFrame:
    """Page rows of PDF files that have ``path`` and an array ``pages``: the name is the base name with the page's number."""
    name = F.substring_index("path", "/", -1)
    return pdf.select(F.col("path").alias("receipt_id"), name.alias("_name"), F.posexplode("pages").alias("page_no", "image")).select(
        "receipt_id", "page_no", F.concat_ws("_", "_name", "page_no").alias("filename"), "image"
    )


def render_plan(entries: DataFrame) -> DataFrame:
    """What to draw for each entry: its box, the colour of its first label, and a caption."""
    from quittance.functions.labels import colour_of, label_of

    top = F.get("labels", F.lit(0))
    caption = F.format_string("%s (%s) %d.%03d", label_of(top["label_id"]), F.col("text"), F.floor(top["prob_milli"] / 1000).cast("int"), (top["prob_milli"] % 1000).cast("int"))
    return entries.select("receipt_id", "page_no", "seq", "x1", "y1", "x2", "y2", colour_of(top["label_id"]).alias("colour"), caption.alias("caption"))


def render_line_plan(lines: DataFrame) -> DataFrame:
    """What to draw for each line: its box, the colour of its best group, and a caption with the conflict flag."""
    from quittance.functions.labels import group_colour_of

    top = F.get("merged", F.lit(0))
    caption = F.format_string("%s %d.%03d (conflict = %s)", top["grp"], F.floor(top["score_milli"] / 1000).cast("int"), (top["score_milli"] % 1000).cast("int"), F.col("conflict").cast("string"))
    return lines.select("receipt_id", "page_no", "line_no", "x1", "y1", "x2", "y2", group_colour_of(top["grp"]).alias("colour"), caption.alias("caption"))


def render_detections(queries: DataFrame, keys: tuple[str, ...] = ("image",), least: float = 0.9) -> DataFrame:
    """What to draw for each kept detection: its box in pixels, the class of the largest score, and a caption."""
    from quittance.functions.geometry import argmax
    from quittance.operators.detection import kept_detections

    kept = kept_detections(queries, least).withColumn("class", argmax(F.slice("probs", 1, F.size("probs") - 1)))
    return kept.select(*keys, "query", "class", "x1", "y1", "x2", "y2", F.format_string("%d: %.2f", F.col("class").cast("int"), F.col("score")).alias("caption"))
