import json

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quittance.operators import images, models, preocr, scorers
from quittance.plans import drawn

SF = "/root/testdata/sf0.001"


def test_a_worker_loads_a_model_once_for_all_its_tasks(spark, tmp_path):
    registry = models.ModelRegistry("cpu")
    log = str(tmp_path / "loads")

    def loader(device):
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()} {device}\n")
        return lambda x: x + 1

    registry.register("adder", loader)

    def run(batches):
        import os

        for b in batches:
            yield pd.DataFrame({"x": [registry.get("adder")(int(v)) for v in b["id"]], "pid": os.getpid()})

    seen = set()
    for _ in range(3):
        rows = spark.range(0, 8, 1, 8).mapInPandas(run, "x long, pid long").collect()
        assert sorted(r.x for r in rows) == list(range(1, 9))
        seen |= {r.pid for r in rows}
    loads = [line.split() for line in open(log)]
    # 24 tasks, one load for each worker process that had any
    assert sorted(int(pid) for pid, _ in loads) == sorted(seen)
    assert len(loads) < 24 and {d for _, d in loads} == {"cpu"}


def test_registries_do_not_travel_with_models():
    one, other = models.ModelRegistry("cpu"), models.ModelRegistry("cpu")
    for r, name in ((one, "a"), (other, "b")):
        r.register("reader", lambda device, name=name: [name, device])
    copy = cloudpickle.loads(cloudpickle.dumps(one))
    assert one.get("reader") == ["a", "cpu"]
    assert copy.get("reader") is one.get("reader")
    assert other.get("reader") == ["b", "cpu"]
    assert not any(isinstance(v, list) for v in vars(one).values())
    with pytest.raises(KeyError):
        one.get("other")
    assert models.task_device("cuda") == "cuda"
    assert models.device_profile("cpu") is None
    assert preocr.choose_device(("cpu", "cuda"), None) == "cuda"


def test_device_reaches_the_loader():
    config = scorers.Config(device="mps")
    registry = models.ModelRegistry(config.device)
    registry.register("reader", lambda device: device)
    assert registry.get("reader") == "mps"


def test_drawn_pages_are_turned_cropped_and_gated(spark):
    pages = drawn.drawn_pages(spark, SF).where("receipt_id < 40")
    n = pages.count()
    seen = {}
    done, tokens = preocr.read_pages(pages, drawn.drawn_scorer(), dump=lambda name, df: seen.__setitem__(name, df))
    sizes = {r.receipt_id: (r.height, r.width) for r in done.collect()}
    assert sizes == {k: (drawn.PHOTO,) * 2 if k % 7 == 0 else (drawn.PAPER,) * 2 for k in sizes}
    assert len(sizes) == n
    rotated = {r.receipt_id: bytes(r.data) for r in seen["rotated"].collect()}
    before = {r.receipt_id: bytes(r.data) for r in pages.collect()}
    turned = sum(rotated[k] != before[k] for k in rotated)
    assert len(rotated) > 0.8 * n and turned > 0.4 * len(rotated)
    raw = {(r.receipt_id, r.seq): r.text for r in drawn.drawn_scorer().read_text(pages).collect()}
    read = {(r.receipt_id, r.seq): r.text for r in tokens.collect()}
    assert set(raw) == set(read)
    # without the chain most photos read wrong
    assert sum(raw[k] != read[k] for k in read) > 0.5 * len(read)
    assert all(read[k, 0] == f"Store {k % 50}" for k in sizes)


def test_pipeline_from_images(spark):
    pages = drawn.drawn_pages(spark, SF).where("receipt_id < 6")
    docs = {r.receipt_id: json.loads(r.json)["receipt"] for r in scorers.pipeline("default", scorer=drawn.drawn_scorer()).run(pages).collect()}
    assert {k: d["store"]["name"]["text"] for k, d in docs.items()} == {k: f"Store {k % 50}" for k in docs} and len(docs) == pages.count()
    assert all(d["date"]["corrected"].startswith("2023-0") and d["total"]["price"]["text"] for d in docs.values())
    lists = scorers.pipeline("ocr_lilt", scorer=drawn.drawn_scorer()).run(pages).collect()
    assert all(len(json.loads(r.json)) == 3 for r in lists)


def test_text_boxes_and_segmenter(spark):
    ink = np.zeros((20, 30), bool)
    for x1, y1, x2, y2 in ((2, 1, 9, 4), (12, 1, 20, 4), (3, 8, 25, 12)):
        ink[y1:y2, x1:x2] = True
    assert drawn.text_boxes(ink) == [(2, 1, 9, 4), (12, 1, 20, 4), (3, 8, 25, 12)]
    assert drawn.text_boxes(ink[:1]) == []
    registry = models.ModelRegistry()
    registry.register("segmenter", lambda device: lambda image: (image[..., 0] >= drawn.SHEET) * 255)
    page = drawn.drawn_pages(spark, SF).where("receipt_id = 4")
    row = models.ModelScorer(registry).segment(page).first()
    corners = page.select(images.mask_corners(F.lit(row.height), F.lit(row.width), F.lit(row.mask)).alias("c")).first().c
    assert sorted({p.x for p in corners}) == [20, 83] and sorted({p.y for p in corners}) == [12, 75]
