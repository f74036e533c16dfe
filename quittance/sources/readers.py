"""Readers: page images, PDF files, token CSV, label sets, gold files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.functions.geometry import percent_to_pixels
from quittance.functions.labels import LABEL_ID
from quittance.functions.parse import basename
from quittance.operators.images import exif_orientation, orient_pages

PAGE_SCHEMA = "receipt_id string, page_no int, filename string, height int, width int, n_channels int, data binary"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Page rows of image files; each file is a receipt of one page. Files that are no images are left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(path)
    origin = F.col("image.origin")
    return image.select(
        origin.alias("receipt_id"), F.lit(0).alias("page_no"), basename(origin).alias("filename"),
        F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"),
    )


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """Page rows of image files as their orientation tags say they are to be seen."""
    tag = F.udf(exif_orientation, "int")
    tags = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), tag("content").alias("orientation"))
    own = read_images(spark, path).withColumn("_path", F.regexp_replace("receipt_id", "^file:/+", "/"))
    return orient_pages(own.join(tags, "_path").drop("_path")).drop("orientation")


def pair_folders(spark: SparkSession, inputs: dict[str, str], outputs: dict[str, str]) -> DataFrame:
    """(split, name, path, out): the files of each split's input folder with where its output folder has them."""
    out = F.create_map(*[F.lit(x) for k, v in outputs.items() for x in (k, v.rstrip("/"))])
    files = list_splits(spark, {k: v for k, v in inputs.items() if k in outputs})
    return files.select("split", "name", "path", F.concat(out[F.col("split")], F.lit("/"), F.col("name")).alias("out"))


def read_pdfs(spark: SparkSession, path: str, rasterise: Callable[[bytes], list[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Page rows of PDF files. ``rasterise`` gives (height, width, n_channels, data) for each page of a file's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                name = p.rsplit("/", 1)[-1]
                yield pd.DataFrame(
                    [(p, i, f"{name}_{i}", *page) for i, page in enumerate(rasterise(content))],
                    columns=["receipt_id", "page_no", "filename", "height", "width", "n_channels", "data"],
                )

    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".pdf"))
    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def list_files(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(path, name, split) of files that do not begin with a dot; callers order by lower(name)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*").load(path)
    return files.select("path", basename(F.col("path")).alias("name"), F.lit(split).alias("split"))


def list_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files of several folders with the split of each."""
    out = None
    for split, path in paths.items():
        part = list_files(spark, path, split)
        out = part if out is None else out.unionByName(part)
    return out


def literal_quad(literal: Column) -> Column:
    """An array of points from its bracketed literal; null where it is none."""
    return F.from_json(F.translate(literal, "()", "[]"), "array<array<double>>")


def literal_pair(literal: Column) -> tuple[Column, Column]:
    """(text, thousandths) of ('text', 0.987); the text may be in either quotes, with backslash escapes."""
    pattern = r"(?s)^\s*\(\s*(['\"])(.*)\1\s*,\s*([0-9.eE+-]+)\s*\)\s*$"
    text = F.regexp_replace(F.regexp_extract(literal, pattern, 2), r"\\(['\"\\])", "$1")
    ok = literal.rlike(pattern)
    # as they are written: no quotes or escapes in the text, so the last mark ends it
    plain = literal.rlike(r"^\('[^'\\]*', \d{1,9}\.\d{3}\)(?!\s)$")
    number = F.substring_index(literal, "', ", -1)
    milli = lambda v: F.floor(v.try_cast("double") * 1000 + 0.5).cast("int")
    return (
        F.when(plain, F.substring(literal, F.lit(3), F.length(literal) - F.length(number) - 5)).when(ok, text),
        F.when(plain, milli(F.substring(number, F.lit(1), F.length(number) - 1))).when(ok, milli(F.regexp_extract(literal, pattern, 3))),
    )


TOKEN_CSV = "image string, quad_literal string, text_conf_literal string, label string"


def read_token_csv(spark: SparkSession, path: str) -> DataFrame:
    """(source, row_no, image, word, ocr_milli, quad, tag) of a quoted CSV with bracketed literals, which are parsed, never run.

    ``row_no`` grows with the position in a file; an empty label is tag 0.
    """
    raw = spark.read.csv(path, schema=TOKEN_CSV, quote='"', escape='"', multiLine=True).withColumn("source", F.col("_metadata.file_path"))
    return parse_token_rows(raw.withColumn("row_no", F.monotonically_increasing_id()))


def parse_token_rows(raw: DataFrame) -> DataFrame:
    word, milli = literal_pair(F.col("text_conf_literal"))
    return raw.select(
        "source", "row_no", "image", word.alias("word"), milli.alias("ocr_milli"), literal_quad(F.col("quad_literal")).alias("quad"),
        F.coalesce(F.nullif(F.trim("label"), F.lit("")).try_cast("int"), F.lit(0)).alias("tag"),
    )


COCO = "images array<struct<id:bigint,file_name:string>>, categories array<struct<id:bigint,name:string>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>"


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, category, x1, y1, x2, y2) of a detection set."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.id", "i.file_name")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("cid"), F.col("c.name").alias("category"))
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", "a.bbox")
    b = F.col("bbox")
    return boxes.join(images, F.col("image_id") == F.col("id")).join(names, F.col("category_id") == F.col("cid")).select(
        "file_name", "category", b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2")
    )


def read_segmentation_csv(spark: SparkSession, path: str) -> DataFrame:
    """(name, points): the first polygon of each image, in percent of the page."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    polygons = F.from_json("label", "array<struct<points:array<array<double>>>>")
    return raw.select(basename(F.col("image")).alias("name"), F.get(polygons, F.lit(0))["points"].alias("points"))


def polygon_pixels(labels: DataFrame) -> DataFrame:
    """Adds ``polygon`` in pixels to rows with points, width and height."""
    return labels.withColumn("polygon", percent_to_pixels(F.col("points"), F.col("width"), F.col("height")))


LABEL_STUDIO = (
    "file_upload string, annotations array<struct<result:array<struct<type:string,value:struct<x:double,y:double,width:double,height:double,text:array<string>,labels:array<string>>>>>>"
)


def read_label_studio(spark: SparkSession, path: str) -> DataFrame:
    """(name, texts, boxes, labels): an entry's values; ``name`` is the upload's name without its prefix of nine characters.

    Where several entries have a name, the first by upload name stays.
    """
    doc = spark.read.schema(LABEL_STUDIO).option("multiLine", True).json(path)
    result = F.col("annotations")[0]["result"]
    of = lambda kind: F.filter(result, lambda r: r["type"] == kind)
    rows = doc.select(
        F.col("file_upload"),
        F.expr("substring(file_upload, 10)").alias("name"),
        F.transform(of("textarea"), lambda r: F.get(r["value"]["text"], F.lit(0))).alias("texts"),
        F.transform(of("rectangle"), lambda r: F.array(r["value"]["x"], r["value"]["y"], r["value"]["x"] + r["value"]["width"], r["value"]["y"] + r["value"]["height"])).alias("boxes"),
        F.transform(of("labels"), lambda r: F.get(r["value"]["labels"], F.lit(0))).alias("labels"),
    )
    return rows.groupBy("name").agg(F.min_by(F.struct("texts", "boxes", "labels"), "file_upload").alias("e")).select("name", "e.*")


def label_ids(entries: DataFrame) -> DataFrame:
    """Adds ``label_ids``, the ids of an entry's label names; unknown names are null."""
    ids = F.create_map(*[F.lit(x) for pair in LABEL_ID.items() for x in pair])
    return entries.withColumn("label_ids", F.transform("labels", lambda x: F.try_element_at(ids, x)))


def label_studio_entry(entries: DataFrame, images: DataFrame) -> DataFrame:
    """The entry of each image by its name; an image without one is an error when the row is computed."""
    found = images.join(entries.withColumn("_has", F.lit(True)), "name", "left")
    must = F.assert_true(F.col("_has").isNotNull(), F.concat(F.lit("no entry for "), F.col("name")))
    return found.where(must.isNull()).drop("_has")


GOLD = "map<string,struct<vendor:string,address:string,date:string,articles:array<struct<description:string,quantity:double,tot_art_price:double,unit_price:double>>,total:double>>"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(file, vendor, address, date, articles, total) of a gold annotation file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", GOLD)).alias("file", "g")).select("file", "g.*")
