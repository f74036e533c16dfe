import json

import numpy as np
from pyspark.sql import functions as F

from quittance.functions import geometry as G
from quittance.operators import dataset, evaluate, images, pages, scorers
from quittance.operators.orientation import choose_upside, page_turns
from quittance.sources import readers, writers
from quittance.streaming import queue


def quad(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def test_skew_and_oblong(spark):
    rows = [quad((0, 10), (100, 0), (100, 20), (0, 30)), quad((0, 0), (100, 10), (100, 30), (0, 20)), quad((0, 0), (0, 9), (5, 9), (5, 0)), quad((0, 0), (10, 0), (10, 10), (0, 10)), quad((0, 0), (50, 0), (50, 0), (0, 0))]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "i int, q array<struct<x:double,y:double>>")
    got = df.select("i", G.skew_angle(F.col("q")).alias("a"), G.is_oblong(F.col("q")).alias("o")).orderBy("i").collect()
    assert [r.a for r in got[:3]] == [5.71, -5.71, 0.0]
    assert [r.o for r in got] == [True, True, False, False, False]


def test_page_without_boxes_is_not_turned(spark):
    df = spark.createDataFrame([("r", 0, quad((0, 0), (10, 0), (10, 10), (0, 10)))], "receipt_id string, page_no int, quad array<struct<x:double,y:double>>")
    row = page_turns(df).first()
    assert row.skew == 0.0 and row.sideways is False


def test_upside_needs_strictly_more(spark):
    rows = [("r", 0, "abcd", 500, False), ("r", 0, "abcd", 500, True), ("s", 0, "abcd", 500, False), ("s", 0, "abcd", 501, True), ("t", 0, "ab", 900, True)]
    got = {r.receipt_id: r.turned for r in choose_upside(spark.createDataFrame(rows, "receipt_id string, page_no int, text string, ocr_milli int, turned boolean")).collect()}
    assert got == {"r": False, "s": True, "t": False}


def test_gate(spark):
    df = spark.createDataFrame([("a.jpg", 100), ("a.jpg", 99), ("A.PDF_0", 500)], "f string, n int")
    assert [r[0] for r in df.select(pages.needs_preprocessing(F.col("f"), F.col("n"))).collect()] == [True, False, False]
    assert df.select(pages.needs_preprocessing(F.col("f"), F.col("n"), enabled=False)).first()[0] is False


def test_pixels():
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert images.distinct_colours(image) == 8
    assert (images.rotate(images.rotate(image, 180), 180) == image).all()
    assert images.rotate(image, 90).shape == (4, 2, 3)
    assert images.crop(image, -5, 0, 2, 99).shape == (2, 2, 3)
    mask = images.fill_polygon([(1, 1), (6, 1), (6, 4), (1, 4)], 8, 10)
    assert mask.max() == 255 and mask[0].sum() == 0
    mask[7, 9] = 255
    box = images.smallest_rectangle(images.largest_region(mask))
    assert box.min(0).round().tolist() == [1, 1] and box[:, 0].max() <= 6
    assert len(images.largest_region(np.zeros((3, 3), np.uint8))) == 0
    a, b = images.augment(np.full((20, 20, 3), 200, np.uint8), np.full((20, 20, 1), 255, np.uint8), seed=1, size=32)
    assert a.shape == (32, 32, 3) and set(np.unique(b)) <= {0, 255}


def test_pages_turn_and_crop(spark):
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    df = spark.createDataFrame([("r", 0, "f", 2, 4, 3, bytearray(image.tobytes()))], readers.PAGE_SCHEMA)
    row = images.turn_pages(df.withColumn("turn", F.lit(90.0))).first()
    assert (row.height, row.width) == (4, 2)
    cut = images.crop_pages(df.withColumns({"cx1": F.lit(1), "cy1": F.lit(0), "cx2": F.lit(3), "cy2": F.lit(1)})).first()
    assert (cut.height, cut.width) == (1, 2)


def test_fixture_scorer_and_pipelines(spark):
    tokens = spark.createDataFrame([("r", 0, i, f"t{i}") for i in range(12)], "receipt_id string, page_no int, seq int, text string")
    labels = tokens.select("receipt_id", "page_no", "seq", F.expr("array(named_struct('label_id', 34, 'label', 'I-item.price', 'prob_milli', 900))").alias("labels"))
    out = scorers.label_tokens(tokens, scorers.FixtureScorer(labels=labels), duplicate_tail=True)
    assert out.count() == 14 and out.agg(F.max("chunk")).first()[0] == 1
    seen = []
    e = tokens.withColumns({"x1": F.lit(0), "y1": F.col("seq") * 40, "x2": F.lit(9), "y2": F.col("seq") * 40 + 9, "ocr_milli": F.lit(900)}).join(labels, ["receipt_id", "page_no", "seq"])
    p = scorers.pipeline("default")
    p.dump = lambda name, df: seen.append(name)
    assert json.loads(p.run(e).first().json)["receipt"]["item_table"][0]["price"]["text"] == "t0"
    assert len(seen) == 3
    assert len(json.loads(scorers.pipeline("ocr_lilt").run(e).first().json)) == 12


def test_csv_round_trip(spark, tmp_path):
    rows = [("a.jpg", quad((1, 2), (3, 2), (3, 4), (1, 4)), 'it\'s "5", ok', 987, 34), ("a.jpg", quad((0, 0), (1, 0), (1, 1), (0, 1)), "x\\y", 5, None)]
    df = spark.createDataFrame(rows, "image string, quad array<struct<x:double,y:double>>, text string, ocr_milli int, label int")
    writers.write_token_csv(df, str(tmp_path / "c"))
    got = {r.word: r for r in readers.read_token_csv(spark, str(tmp_path / "c")).collect()}
    assert set(got) == {'it\'s "5", ok', "x\\y"}
    assert got['it\'s "5", ok'].ocr_milli == 987 and got['it\'s "5", ok'].quad[2] == [3.0, 4.0] and got["x\\y"].tag == 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"A.JPG": {"vendor": "v", "address": "a", "date": "d", "articles": [{"description": "x", "quantity": 1, "tot_art_price": -2.5, "unit_price": 1}], "total": 1.5}}))
    row = readers.read_gold(spark, str(tmp_path / "gold.json")).first()
    assert (row.file, row.articles[0].tot_art_price, row.total) == ("A.JPG", -2.5, 1.5)
    (tmp_path / "coco.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "f"}], "categories": [{"id": 3, "name": "receipt"}], "annotations": [{"image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}]}))
    assert tuple(readers.read_coco(spark, str(tmp_path / "coco.json")).first()) == ("f", "receipt", 1.0, 2.0, 4.0, 6.0)
    (tmp_path / "seg.csv").write_text('image,label\n/d/x.png,"[{""points"": [[10, 20], [30, 40]]}]"\n')
    seg = readers.read_segmentation_csv(spark, str(tmp_path / "seg.csv")).withColumns({"width": F.lit(200), "height": F.lit(100)})
    assert [tuple(p) for p in readers.polygon_pixels(seg).first().polygon] == [(20, 20), (60, 40)]
    (tmp_path / "ls.json").write_text(json.dumps([{"file_upload": "12345678-x.jpg", "annotations": [{"result": [{"type": "textarea", "value": {"text": ["hi"]}}, {"type": "labels", "value": {"labels": ["I-total.price"]}}]}]}]))
    assert readers.read_label_studio(spark, str(tmp_path / "ls.json")).first().texts == ["hi"]


def test_images_and_files(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00" + bytes([1, 2, 3, 4, 5, 6]))) + chunk(b"IEND", b"")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/B.png").write_bytes(png)
    (tmp_path / "d/a.png").write_bytes(png)
    row = readers.read_images(spark, str(tmp_path / "d")).orderBy("filename").first()
    assert (row.filename, row.height, row.width, bytes(row.data)) == ("B.png", 1, 2, bytes([3, 2, 1, 6, 5, 4]))
    assert [r.name for r in readers.list_files(spark, str(tmp_path / "d")).orderBy(F.lower("name")).collect()] == ["a.png", "B.png"]
    (tmp_path / "p.pdf").write_bytes(b"two")
    got = readers.read_pdfs(spark, str(tmp_path / "p.pdf"), lambda b: [(1, 1, 3, b"abc")] * 2).collect()
    assert [r.filename for r in got] == ["p.pdf_0", "p.pdf_1"]


def test_dataset_encoding(spark):
    df = spark.createDataFrame([(["a", "b"], [[1, 2, 3, 4], [5, 6, 7, 8]], [3, 4])], "words array<string>, bboxes array<array<bigint>>, ner_tags array<int>")
    row = dataset.encode(df, length=3).first()
    assert row.attention_mask == [1, 1, 0] and row.labels == [3, 4, -100] and row.bbox[2] == [0, 0, 0, 0]


def test_entity_counts(spark):
    rows = [("r", 0, "A", "A"), ("r", 1, "A", "A"), ("r", 2, "B", "O"), ("r", 3, "O", "B")]
    row = evaluate.entity_counts(spark.createDataFrame(rows, "receipt_id string, seq int, gold string, pred string")).first()
    assert (row.n_gold, row.n_pred, row.n_common, row.f1, row.accuracy) == (2, 2, 1, 0.5, 0.5)


def test_worker_is_idempotent_and_keeps_bad_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"id":"1","image":"x","filename":"f"}\n{"id":"1","image":"x","filename":"f"}\n{"id":"2","image":"none","filename":"f"}\nnonsense\n')
    process = lambda r: r.select("id", F.when(F.col("image") != "none", F.upper("image")).alias("result"))
    for _ in range(2):
        queue.start_worker(queue.read_requests(spark, str(tmp_path / "in")), process, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "state")).awaitTermination()
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ['{"id":"1","result":"X"}']
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == ["no result", "not a request"]


def test_artifact_name():
    assert ":" not in writers.artifact_name("/d", "f", "x", True).split("/", 2)[2]
