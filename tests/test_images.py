"""From images to receipts, and the small operators around them."""

import json
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quittance.functions.labels import LABEL_ID
from quittance.operators import evaluate, images, pages, preocr, scorers
from quittance.sources import readers, writers
from quittance.streaming import queue

QUAD = "array<struct<x:double,y:double>>"


def quad(x1, y1, x2, y2):
    return [{"x": float(x), "y": float(y)} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]


def photo(seed, h=60, w=80):
    return np.random.default_rng(seed).integers(0, 255, (h, w, 3)).astype(np.uint8)


@pytest.mark.parametrize("algorithm", ["detection", "segmentation", None])
def test_images_become_receipts(spark, tmp_path, algorithm):
    rows = [("a", 0, "a.jpg", photo(1)), ("b", 0, "b.pdf_0", photo(2)), ("c", 0, "c.jpg", np.zeros((60, 80, 3), np.uint8))]
    df = spark.createDataFrame([(i, n, f, 60, 80, 3, bytearray(x.tobytes())) for i, n, f, x in rows], readers.PAGE_SCHEMA)
    read = spark.createDataFrame([(i, 0, k, quad(5, 5 + 12 * k, 45, 14 + 12 * k), t, 900) for i in "abc" for k, t in enumerate(["Shop", "1.50"])], f"receipt_id string, page_no int, seq int, quad {QUAD}, text string, ocr_milli int")
    named = F.when(F.col("seq") == 0, F.lit(LABEL_ID["I-store.name"])).otherwise(F.lit(LABEL_ID["I-total.price"]))
    labels = read.select("receipt_id", "page_no", "seq", F.array(F.struct(named.alias("label_id"), F.lit("x").alias("label"), F.lit(900).alias("prob_milli"))).alias("labels"))
    found = spark.createDataFrame([("a", 0, 0, [0.99, 0.01], 0.5, 0.5, 0.5, 0.5, 80, 60)], "receipt_id string, page_no int, query int, probs array<double>, cx double, cy double, w double, h double, width int, height int")
    mask = np.zeros((60, 80), np.uint8)
    mask[10:50, 20:60] = 255
    masks = spark.createDataFrame([(i, 0, 60, 80, bytearray(mask.tobytes())) for i in "abc"], "receipt_id string, page_no int, height int, width int, mask binary")
    scorer = scorers.FixtureScorer(tokens=read, labels=labels, detections=found, masks=masks)
    seen = {}
    out = preocr.image_receipts(df, scorer, algorithm=algorithm, dump=lambda name, x: seen.setdefault(name, x.select("receipt_id", "width", "height").collect()))
    docs = {r.receipt_id: json.loads(r.json)["receipt"] for r in out.collect()}
    assert set(docs) == {"a", "b", "c"}
    assert all(d["store"]["name"]["text"] == "Shop" and d["total"]["price"]["corrected"] == "1.5" for d in docs.values())
    if algorithm == "detection":
        assert list(seen) == ["original", "rotated", "cropped", "rotated2", "after"]
        assert [tuple(r) for r in seen["cropped"]] == [("a", 40, 30)] and len(seen["after"]) == 3
    elif algorithm is None:
        assert seen == {}


def test_detection_leaves_pages_without_one(spark):
    df = spark.createDataFrame([("a", 0, "a.jpg", 60, 80, 3, bytearray(photo(1).tobytes()))], readers.PAGE_SCHEMA)
    row = scorers.crop_by_detection(df, scorers.FixtureScorer()).first()
    assert (row.height, row.width) == (60, 80)


def exif(orientation, order="<"):
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_orientation_tags(spark):
    for k in range(1, 9):
        assert images.exif_orientation(exif(k)) == images.exif_orientation(exif(k, ">")) == k
    assert [images.exif_orientation(x) for x in (b"", b"\xff\xd8", b"\x89PNG", exif(9), exif(3)[:20])] == [1] * 5
    x = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    assert {k: images.transposed(x, k)[:, :, 0].tolist() for k in want} == want


def test_photos_and_png_round_trip(spark, tmp_path):
    (tmp_path / "d").mkdir()
    x = photo(3, 4, 5)
    (tmp_path / "d/a.png").write_bytes(images.png(x))
    row = images.with_png(readers.read_photos(spark, str(tmp_path / "d"))).first()
    assert (images.pixels(row.height, row.width, row.n_channels, row.data) == x).all() and bytes(row.png) == images.png(x)


def test_folders_and_label_names(spark, tmp_path):
    for k in ("train", "test"):
        (tmp_path / k).mkdir()
        (tmp_path / k / f"{k}.png").write_bytes(b"x")
    pairs = readers.pair_folders(spark, {k: str(tmp_path / k) for k in ("train", "test")}, {"train": "/out/train/", "test": "/out/test"}).collect()
    assert {(r.split, r.out) for r in pairs} == {("train", "/out/train/train.png"), ("test", "/out/test/test.png")}
    e = spark.createDataFrame([("a.jpg", ["I-total.price", "none"])], "name string, labels array<string>")
    assert readers.label_ids(e).first().label_ids == [71, None]
    assert readers.label_studio_entry(e, spark.createDataFrame([("a.jpg",)], "name string")).count() == 1
    with pytest.raises(Exception, match="no entry for b.jpg"):
        readers.label_studio_entry(e, spark.createDataFrame([("b.jpg",)], "name string")).collect()


def test_measures(spark):
    assert tuple(evaluate.timings(spark.createDataFrame([(1.0,), (2.0,)], "seconds double")).first()) == (2, 3.0, 1.5)
    assert evaluate.epoch_loss(spark.createDataFrame([(1, 0.5), (1, 1.5)], "epoch int, loss double")).first().loss == 1.0
    s = spark.createDataFrame([(0, [1.0, -1.0, 2.0, 0.0], [1, 0, 0, 0])], "batch int, logits array<double>, mask array<int>")
    assert evaluate.pixel_accuracy(s).first().accuracy == 0.75
    assert images.mask_of(np.array([-1.0, 0.0, 0.1])).tolist() == [0, 0, 255]
    assert spark.range(1).select(evaluate.gold_key(F.lit("/d/IMG_1.jpeg")).alias("k")).first().k == "IMG_1.JPG"
    q = spark.createDataFrame([(1, 0, [0.95, 0.02, 0.03], 0.5, 0.5, 0.5, 0.5, 100, 100), (1, 1, [0.1, 0.2, 0.7], 0.5, 0.5, 1.0, 1.0, 100, 100)], "image int, query int, probs array<double>, cx double, cy double, w double, h double, width int, height int")
    assert [tuple(r)[2:] for r in pages.render_detections(q).collect()] == [(0, 25.0, 25.0, 75.0, 75.0, "0: 0.95")]
    g = spark.createDataFrame([("A.PDF_0", 500)], "f string, n int")
    assert [g.select(pages.needs_preprocessing(F.col("f"), F.col("n"), any_case=k)).first()[0] for k in (True, False)] == [False, True]


def test_stage_dumps_are_written(spark, tmp_path):
    config = scorers.Config(save_results=True, data_dir=str(tmp_path))
    e = spark.createDataFrame([("r", 0, 0, "t", 0, 0, 9, 9, 900, [(34, "I-item.price", 900)])], "receipt_id string, page_no int, seq int, text string, x1 long, y1 long, x2 long, y2 long, ocr_milli int, labels array<struct<label_id:int,label:string,prob_milli:int>>")
    scorers.pipeline("default", config).run(e)
    assert len(list(tmp_path.iterdir())) == 3
    assert writers.artifact_name("d", "f", "x", True).endswith("_f_x.json")


def _requests(spark, path, n=4):
    spark.range(n).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit("i").alias("image"))).alias("value")).coalesce(1).write.text(path)


def test_failed_batch_is_answered_after_restart(spark, tmp_path):
    _requests(spark, f"{tmp_path}/in")
    calls = []

    def process(requests):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("worker lost")
        return requests.select("id", F.lit("ok").alias("result"))

    for _ in range(2):
        worker = queue.start_worker(queue.read_requests(spark, f"{tmp_path}/in"), process, f"{tmp_path}/out", f"{tmp_path}/dead", f"{tmp_path}/state")
        try:
            worker.awaitTermination()
        except Exception as e:
            assert "worker lost" in str(e)
    assert len(calls) == 2
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["0", "1", "2", "3"]
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 0


def test_late_batch_goes_to_the_dead_letters(spark, tmp_path):
    _requests(spark, f"{tmp_path}/in")

    def process(requests):
        slow = F.udf(lambda x: __import__("time").sleep(15) or x, "string")
        return requests.select("id", slow("image").alias("result"))

    worker = queue.start_worker(queue.read_requests(spark, f"{tmp_path}/in"), process, f"{tmp_path}/out", f"{tmp_path}/dead", f"{tmp_path}/state", timeout=3)
    worker.awaitTermination()
    assert [r.reason for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == ["timed out"] * 4
    assert spark.read.parquet(f"{tmp_path}/out").count() == 0


def test_stop_and_liveness(spark, tmp_path):
    _requests(spark, f"{tmp_path}/in")
    worker = queue.start_worker(queue.read_requests(spark, f"{tmp_path}/in"), lambda r: r.select("id", F.lit("ok").alias("result")), f"{tmp_path}/out", f"{tmp_path}/dead", f"{tmp_path}/state", once=False)
    worker.processAllAvailable()
    assert queue.is_alive(worker) and not queue.is_alive(worker, -1)
    stop = threading.Event()
    stop.set()
    queue.run_until_signal(worker, stop)
    assert not worker.isActive and not queue.is_alive(worker)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
