"""Training sets: rows grouped by image, joined with files, encoded to a fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.functions.geometry import box_issues
from quittance.functions.parse import basename


def group_by_image(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """One example for each run of rows of an image: words, boxes and tags in order.

    ``rows`` has image, word, box (array of four) and tag. Runs are numbered in
    file order; where a file name comes again later, its last run stays. Runs
    are found within a file (``source``), so files are read in parallel.
    """
    w = W.partitionBy("source").orderBy(order)
    new = F.coalesce(F.col("image") != F.lag("image").over(w), F.lit(True)).cast("int")
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w) - 1)
    own = F.sort_array(F.collect_list(F.struct(order, "word", "box", "tag")))
    grouped = runs.groupBy("source", "run", "image").agg(own.alias("own"))
    named = grouped.withColumn("name", basename(F.col("image")))
    last = named.groupBy("source", "name").agg(F.max_by(F.struct("run", "image", "own"), "run").alias("g"))
    return last.select(
        "source",
        "name",
        F.col("g.run").alias("run"),
        F.col("g.image").alias("image_path"),
        F.transform("g.own", lambda v: v["word"]).alias("words"),
        F.transform("g.own", lambda v: v["box"]).alias("bboxes"),
        F.transform("g.own", lambda v: v["tag"]).alias("ner_tags"),
    )


def last_runs(pages: DataFrame, order: str) -> DataFrame:
    """Of (source, ``order``, image) those in the last run of each file name, with ``name`` and ``run``, as group_by_image finds them.

    A page stands for its rows, which follow each other in a file under one
    image. Runs are told from pages alone, so only rows that stay need be moved.
    """
    w = W.partitionBy("source").orderBy(order)
    new = F.coalesce(F.col("image") != F.lag("image").over(w), F.lit(True)).cast("int")
    runs = pages.withColumn("_new", new).withColumn("run", F.sum("_new").over(w) - 1).withColumn("name", basename(F.col("image")))
    return runs.withColumn("_last", F.max("run").over(W.partitionBy("source", "name"))).where(F.col("run") == F.col("_last")).drop("_new", "_last")


def collect_runs(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """Rows of last runs (source, name, run, image, ``order``, word, box, tag) as the examples of group_by_image."""
    own = F.sort_array(F.collect_list(F.struct(order, "word", "box", "tag")))
    words = lambda c: F.col("own")[c]
    return rows.groupBy("source", "name", "run", F.col("image").alias("image_path")).agg(own.alias("own")).select(
        "source", "name", "run", "image_path", words("word").alias("words"), words("box").alias("bboxes"), words("tag").alias("ner_tags")
    )


def join_files(files: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples of the listed files, with their split; ``id`` numbers them in case-folded name order within a split.

    The numbering is a window over a split's file names, not over its examples.
    """
    numbered = files.select("split", basename(F.col("path")).alias("name")).withColumn(
        "id", (F.row_number().over(W.partitionBy("split").orderBy(F.lower("name"), "name")) - 1).cast("string")
    )
    return numbered.join(examples, "name")


def missing_files(files: DataFrame, examples: DataFrame) -> DataFrame:
    """Listed files that have no example."""
    return files.select("split", basename(F.col("path")).alias("name")).join(examples, "name", "left_anti")


def encode(examples: DataFrame, length: int = 512, pad: int = 1, ignore: int = -100) -> DataFrame:
    """Fixed-length features: attention mask, boxes and labels, cut or padded to ``length``."""
    def fit(c: str, fill: object) -> object:
        return F.slice(F.concat(c, F.array_repeat(fill, length)), 1, length)

    n = F.least(F.size("words"), F.lit(length))
    return examples.withColumns(
        {
            "attention_mask": F.concat(F.array_repeat(F.lit(1).cast("long"), n), F.array_repeat(F.lit(0).cast("long"), length - n)),
            "bbox": fit("bboxes", F.array(*[F.lit(0).cast("long")] * 4)),
            "labels": fit("ner_tags", F.lit(ignore)),
            "padded_words": fit("words", F.lit("")),
        }
    )


def box_quality(tokens: DataFrame, keys: tuple[str, ...] = ("receipt_id",)) -> DataFrame:
    """(key, n, n_bad): how many normalised boxes are thinner than 1 or leave the grid."""
    bad = box_issues(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("n_bad"))
