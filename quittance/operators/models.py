"""Models on executors: loaded once for each worker process, on the device of its task, and called over batches of pages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quittance.operators.images import pixels
from quittance.sources.shared import small_batches

#: The models of this process. It is no part of any registry, so pickling a registry neither carries nor loses them, and a
#: worker that Spark uses for many tasks finds them again.
_LOADED: dict[tuple[str, str, str], object] = {}


def task_device(device: str) -> str:
    """The device with the address that Spark has given the running task, as cuda:1; as it is where none was given."""
    context = TaskContext.get()
    given = context.resources().get("gpu") if context is not None and device == "cuda" else None
    return f"{device}:{given.addresses[0]}" if given and given.addresses else device


class ModelRegistry:
    """Models by name, loaded by the worker process that first asks for them and kept for its life.

    Loaders travel to the workers, models never do. Copies of a registry share
    the models of their process; registries made apart do not, even if they use
    the same names.
    """

    def __init__(self, device: str = "cpu"):
        self.device = device
        self._id = uuid.uuid4().hex
        self._loaders: dict[str, Callable[[str], object]] = {}

    def register(self, name: str, loader: Callable[[str], object]) -> None:
        """``loader`` takes the device."""
        self._loaders[name] = loader

    def get(self, name: str) -> object:
        if name not in self._loaders:
            raise KeyError(f"no model {name!r}; there are {sorted(self._loaders)}")
        key = (self._id, name, task_device(self.device))
        if key not in _LOADED:
            _LOADED[key] = self._loaders[name](key[2])
        return _LOADED[key]


def device_profile(device: str, per_task: float = 1.0) -> ResourceProfile | None:
    """What tasks that call models ask for: a share of a GPU, or nothing special. Stages around them ask for nothing."""
    if device != "cuda":
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().resource("gpu", per_task)).build


#: What a page is read as, in one row: its tokens in order. And what is detected on it.
READING = "array<struct<seq:bigint,quad:array<struct<x:double,y:double>>,text:string,ocr_milli:bigint>>"
DETECTIONS = "array<struct<query:int,probs:array<double>,cx:double,cy:double,w:double,h:double>>"


def read_page(registry: ModelRegistry, image: np.ndarray, recognise: bool = True) -> list[dict]:
    """What the model "reader" finds on a page, as READING has it."""
    found = registry.get("reader")(image, recognise)
    quad = lambda corners: [{"x": float(x), "y": float(y)} for x, y in corners]
    return [{"seq": i, "quad": quad(c), "text": text if recognise else "", "ocr_milli": int(np.floor(p * 1000 + 0.5))} for i, (c, text, p) in enumerate(found)]


def detect_on_page(registry: ModelRegistry, image: np.ndarray) -> list[dict]:
    """What the model "detector" finds on a page, as DETECTIONS has it."""
    return [dict(zip(("query", "probs", "cx", "cy", "w", "h"), (k, list(map(float, probs)), *map(float, box)), strict=True)) for k, (probs, *box) in enumerate(registry.get("detector")(image))]


class ModelScorer:
    """A scorer that calls the registry's models "reader", "detector", "segmenter" and "labeler".

    What models take and give, with images as arrays of height x width x 3:
    reader(image, recognise): a list of (four corners (x, y), text, confidence);
    detector(image): a list of (class probabilities, cx, cy, w, h);
    segmenter(image): a mask of the image's size, 0 or 255;
    labeler(words, boxes): for each word three (label_id, label, probability), best first.
    """

    def __init__(self, registry: ModelRegistry, per_task: float = 1.0):
        self.registry = registry
        self.profile = device_profile(registry.device, per_task)

    def _pages(self, pages: DataFrame, schema: str, rows: Callable[[ModelRegistry, np.ndarray], Iterator[tuple]]) -> DataFrame:
        registry = self.registry
        kind = f"receipt_id {pages.schema['receipt_id'].dataType.simpleString()}, page_no int"
        names = ["receipt_id", "page_no", *[c.split()[0] for c in schema.split(", ")]]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(p.receipt_id, p.page_no, *r) for p in batch.itertuples(index=False) for r in rows(registry, pixels(p.height, p.width, p.n_channels, p.data))]
                yield pd.DataFrame(found, columns=names)

        return self._mapped(pages.select("receipt_id", "page_no", "height", "width", "n_channels", "data"), run, f"{kind}, {schema}")

    def _mapped(self, pages: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
        small_batches(pages.sparkSession)
        return pages.mapInPandas(run, schema, profile=self.profile) if self.profile else pages.mapInPandas(run, schema)

    def on_pages(self, pages: DataFrame, work: Callable[[ModelRegistry, np.ndarray, tuple], tuple[np.ndarray | None, list[list]]], **kinds: str) -> DataFrame:
        """A step that keeps each page in its row, so that pixels are neither joined nor stored.

        ``work(registry, image, row)`` gives the page's new image and the values of the
        columns ``kinds``; without an image the pixels go, and the size stays.
        """
        registry = self.registry
        schema = T.StructType([*pages.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False):
                    image, values = work(registry, pixels(row.height, row.width, row.n_channels, row.data), row)
                    size = (row.height, row.width, None) if image is None else (*image.shape[:2], image.tobytes())
                    out.append((*size, *values))
                made = pd.DataFrame(out, columns=["height", "width", "data", *kinds], index=batch.index)
                yield batch.assign(**{c: made[c] for c in made})

        return self._mapped(pages, run, schema)

    def read_text(self, pages: DataFrame, recognise: bool = True) -> DataFrame:
        def rows(registry: ModelRegistry, image: np.ndarray) -> Iterator[tuple]:
            return (tuple(t.values()) for t in read_page(registry, image, recognise))

        return self._pages(pages, "seq long, quad array<struct<x:double,y:double>>, text string, ocr_milli long", rows)

    def detect(self, pages: DataFrame) -> DataFrame:
        def rows(registry: ModelRegistry, image: np.ndarray) -> Iterator[tuple]:
            return ((*d.values(), image.shape[1], image.shape[0]) for d in detect_on_page(registry, image))

        return self._pages(pages, "query int, probs array<double>, cx double, cy double, w double, h double, width int, height int", rows)

    def segment(self, pages: DataFrame) -> DataFrame:
        def rows(registry: ModelRegistry, image: np.ndarray) -> Iterator[tuple]:
            yield image.shape[0], image.shape[1], np.asarray(registry.get("segmenter")(image), np.uint8).tobytes()

        return self._pages(pages, "height int, width int, mask binary", rows)

    def label(self, tokens: DataFrame) -> DataFrame:
        """Chunks are gathered as arrays, and a batch of them goes through the labeler one after the other."""
        registry = self.registry

        @F.pandas_udf("array<array<struct<label_id:int,label:string,prob_milli:int>>>")
        def labels(words: pd.Series, boxes: pd.Series) -> pd.Series:
            out = []
            for w, b in zip(words, boxes, strict=True):
                found = registry.get("labeler")(list(w), [[int(v) for v in box] for box in b])
                if len(found) != len(w):
                    raise ValueError(f"the labeler gave {len(found)} labels for {len(w)} words")
                out.append([[{"label_id": i, "label": name, "prob_milli": int(np.floor(p * 1000 + 0.5))} for i, name, p in three] for three in found])
            return pd.Series(out, dtype=object)

        keys = ["receipt_id", "page_no", "chunk"]
        rest = [c for c in tokens.columns if c not in (*keys, "seq")]
        own = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", *rest))).alias("_own"))
        box = lambda v: F.array(*[v[c].cast("long") for c in ("x1", "y1", "x2", "y2")])
        made = own.withColumn("_labels", labels(F.transform("_own", lambda v: v["text"]), F.transform("_own", box)))
        rows = made.select(*keys, F.explode(F.arrays_zip("_own", "_labels")).alias("_row"))
        return rows.select(*[F.col(c) if c in keys else F.col("_row")["_own"][c].alias(c) for c in tokens.columns], F.col("_row")["_labels"].alias("labels"))
