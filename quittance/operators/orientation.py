"""Orientation of a page from its text boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.functions.geometry import is_oblong, is_upright, skew_angle

#: Texts of fewer characters say nothing about orientation.
SIGNIFICANT = 4


def is_significant(text: Column) -> Column:
    return F.length(text) >= SIGNIFICANT


def page_turns(quads: DataFrame, keys: tuple[str, ...] = ("receipt_id", "page_no")) -> DataFrame:
    """(page, skew, sideways): mean skew of oblong boxes, 0 where there are none; whether most boxes stand upright."""
    q = F.col("quad")
    return quads.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(is_oblong(q), skew_angle(q))), F.lit(0.0)).alias("skew"),
        F.coalesce(F.sum(is_upright(q).cast("int")) * 2 > F.count(F.lit(1)), F.lit(False)).alias("sideways"),
        F.count(F.lit(1)).alias("n_boxes"),
    )


def turn_of(quads: Column) -> Column:
    """The degrees that straighten a page, from all its boxes in one array: those of page_turns."""
    oblong = F.filter(quads, is_oblong)
    skew = F.aggregate(oblong, F.lit(0.0), lambda a, q: a + skew_angle(q)) / F.nullif(F.size(oblong), F.lit(0))
    return F.when(F.size(F.filter(quads, is_upright)) * 2 > F.size(quads), 90.0).otherwise(0.0) - F.coalesce(skew, F.lit(0.0))


def mean_confidence(tokens: Column) -> Column:
    """The mean confidence of the significant texts of a page's tokens in one array; 0 without any."""
    own = F.filter(tokens, lambda t: is_significant(t["text"]))
    return F.coalesce(F.aggregate(own, F.lit(0.0), lambda a, t: a + t["ocr_milli"]) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0))


def choose_upside(variants: DataFrame, keys: tuple[str, ...] = ("receipt_id", "page_no")) -> DataFrame:
    """(page, mean_0, mean_180, turned): compares the mean confidence of significant texts as read and turned by 180 degrees.

    ``variants`` has a row for each token and ``turned``, whether the page was turned. The turned reading wins only if it is
    strictly better; a variant without significant text counts 0.
    """
    mean = lambda t: F.coalesce(F.avg(F.when((F.col("turned") == t) & is_significant(F.col("text")), F.col("ocr_milli"))), F.lit(0.0))
    both = variants.groupBy(*keys).agg(mean(F.lit(False)).alias("mean_0"), mean(F.lit(True)).alias("mean_180"))
    return both.withColumn("turned", F.col("mean_0") < F.col("mean_180"))


def upside_tokens(variants: DataFrame, keys: tuple[str, ...] = ("receipt_id", "page_no")) -> DataFrame:
    """The tokens of the winning variant of each page."""
    return variants.join(choose_upside(variants, keys).select(*keys, "turned"), [*keys, "turned"])
