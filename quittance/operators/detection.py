"""Candidates from model scores: detections, label top-k, sub-token means, scoring windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.functions.geometry import centre_to_corners, softmax

#: Words that the labeler sees at once.
CHUNK_WORDS = 10


def kept_detections(queries: DataFrame, least: float = 0.9) -> DataFrame:
    """Queries whose best class, the last one (no object) aside, is over ``least``; boxes in pixels."""
    best = F.array_max(F.slice("probs", 1, F.size("probs") - 1))
    box = centre_to_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    px = {k: v * (F.col("width") if k[0] == "x" else F.col("height")) for k, v in box.items()}
    return queries.withColumn("score", best).where(F.col("score") > least).withColumns(px)


def pick_detection(queries: DataFrame, keys: tuple[str, ...] = ("image",), least: float = 0.9) -> DataFrame:
    """The first kept query of each image, the whole image where none is kept."""
    kept = kept_detections(queries, least).groupBy(*keys).agg(F.min_by(F.struct("query", "score", "x1", "y1", "x2", "y2"), "query").alias("d"))
    images = queries.groupBy(*keys).agg(F.first("width").alias("width"), F.first("height").alias("height"))
    return images.join(kept, list(keys), "left").select(
        *keys,
        F.col("d.query").alias("query"),
        F.coalesce("d.x1", F.lit(0.0)).alias("x1"),
        F.coalesce("d.y1", F.lit(0.0)).alias("y1"),
        F.coalesce("d.x2", F.col("width").cast("double")).alias("x2"),
        F.coalesce("d.y2", F.col("height").cast("double")).alias("y2"),
    )


def first_box(detections: Column, width: Column, height: Column, least: float = 0.9) -> dict[str, Column]:
    """The box, in whole pixels, that pick_detection takes from a page's detections in one array, which are in order of query."""
    best = lambda q: F.array_max(F.slice(q["probs"], 2, F.size(q["probs"])))
    q = F.get(F.filter(detections, lambda q: best(q) > least), F.lit(0))
    box = centre_to_corners(q["cx"], q["cy"], q["w"], q["h"])
    return {k: F.coalesce((v * (width if k[0] == "x" else height)).cast("int"), F.lit(0) if k[1] == "1" else (width if k[0] == "x" else height)) for k, v in box.items()}


def milli(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5).cast("int")


def top_labels(logits: Column, k: int = 3) -> Column:
    """The ``k`` likeliest of softmax(logits) as (label_id, prob_milli), best first, ties to the lower id."""
    ranked = F.array_sort(F.transform(softmax(logits), lambda p, i: F.struct((-p).alias("neg"), i.alias("label_id"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["label_id"].alias("label_id"), milli(-r["neg"]).alias("prob_milli")))


def merge_subtokens(sub: DataFrame, keys: tuple[str, ...], order: str, box: tuple[str, ...], logits: str = "logits") -> DataFrame:
    """Means the logits of consecutive sub-tokens that share a box: one row for each run, numbered as ``island``."""
    w = W.partitionBy(*keys).orderBy(order)
    b = F.struct(*box)
    new = F.coalesce(~b.eqNullSafe(F.lag(b).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    runs = sub.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w) - 1)
    flat = runs.select(*keys, "island", *box, order, F.posexplode(logits).alias("class", "logit"))
    by_class = flat.groupBy(*keys, "island", *box, "class").agg(F.avg("logit").alias("logit"), F.count(F.lit(1)).alias("n"))
    return by_class.groupBy(*keys, "island", *box).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "logit"))), lambda v: v["logit"]).alias("logits"), F.max("n").alias("n_sub")
    )


def chunks(tokens: DataFrame, keys: tuple[str, ...] = ("receipt_id", "page_no"), words: int = CHUNK_WORDS, duplicate_tail: bool = False) -> DataFrame:
    """Adds ``chunk`` and ``copy`` for scoring in windows of ``words`` words.

    With ``duplicate_tail`` the last, partly filled window of a page that has at
    least one full window is scored and returned twice.
    """
    w = W.partitionBy(*keys).orderBy("seq")
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    numbered = tokens.withColumns({"_i": F.row_number().over(w) - 1, "_n": n}).withColumn("chunk", F.floor(F.col("_i") / words).cast("long"))
    if not duplicate_tail:
        return numbered.withColumn("copy", F.lit(0)).drop("_i", "_n")
    tail = (F.col("_n") >= words) & (F.col("chunk") == F.floor(F.col("_n") / words))
    return numbered.withColumn("copy", F.explode(F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_i", "_n")
