"""Detections against gold boxes: the assignment of least cost, its loss, and measures of the matched boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of class, distance and overlap in the cost of a pair and in the loss, and of the class "no object" in the loss.
CLASS, DISTANCE, OVERLAP, NO_OBJECT = 1.0, 5.0, 2.0, 0.1


def corners(boxes: np.ndarray) -> np.ndarray:
    """(x1, y1, x2, y2) of (cx, cy, w, h)."""
    centre, half = boxes[:, :2], boxes[:, 2:] / 2
    return np.concatenate([centre - half, centre + half], axis=1)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(IoU, generalised IoU) of every box of ``a`` with every one of ``b``, by corners; boxes without area overlap nothing."""
    area = lambda x: np.clip(x[:, 2] - x[:, 0], 0, None) * np.clip(x[:, 3] - x[:, 1], 0, None)
    inner = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None).prod(2)
    outer = np.clip(np.maximum(a[:, None, 2:], b[None, :, 2:]) - np.minimum(a[:, None, :2], b[None, :, :2]), 0, None).prod(2)
    union = area(a)[:, None] + area(b)[None, :] - inner
    share = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=y > 0)
    iou = share(inner, union)
    return iou, iou - share(outer - union, outer)


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the assignment of least total cost, of as many pairs as the shorter side has.

    Shortest augmenting paths with potentials: one row after another gets a
    column, by the cheapest chain of exchanges.
    """
    if cost.shape[0] > cost.shape[1]:
        columns, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    of_row, of_col = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # rows from 1; 0: free
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, came = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        done = np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            reduced = cost[owner[at] - 1] - of_row[owner[at]] - of_col[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            came[1:][better] = at
            open_cols = np.where(done, np.inf, least)
            open_cols[0] = np.inf
            nearest = int(np.argmin(open_cols))
            step = open_cols[nearest]
            of_row[owner[done]] += step
            of_col[done] -= step
            least[~done] -= step
            at = nearest
        while at:
            owner[at], at = owner[came[at]], came[at]
    taken = np.flatnonzero(owner[1:])
    rows = owner[1:][taken] - 1
    order = np.argsort(rows)
    return rows[order], taken[order]


def match(probs: np.ndarray, boxes: np.ndarray, classes: np.ndarray, gold: np.ndarray) -> dict[str, object]:
    """The pairs of one image and its losses. ``probs`` has the class "no object" last; boxes are shares of the page."""
    cost = -probs[:, classes] * CLASS
    distance = np.abs(boxes[:, None] - gold[None]).sum(2)
    iou, general = overlaps(corners(boxes), corners(gold))
    rows, cols = assign(cost + DISTANCE * distance - OVERLAP * general)
    target = np.full(len(probs), probs.shape[1] - 1)
    target[rows] = classes[cols]
    weight = np.where(target == probs.shape[1] - 1, NO_OBJECT, 1.0)
    surprise = -np.log(np.clip(probs[np.arange(len(probs)), target], 1e-12, None))
    n = max(1, len(gold))
    return {
        "rows": rows, "cols": cols, "iou": iou[rows, cols], "general": general[rows, cols],
        "class_loss": float((weight * surprise).sum() / weight.sum()) if len(probs) else 0.0,
        "box_loss": float(distance[rows, cols].sum() / n), "overlap_loss": float((1 - general[rows, cols]).sum() / n),
    }


MATCHED = "gold int, query int, iou double, general_iou double, class_loss double, box_loss double, overlap_loss double"


def match_detections(detections: DataFrame, gold: DataFrame, image: str = "image") -> DataFrame:
    """One row for each gold box, with the query assigned to it and the losses of its image.

    ``detections`` has query, probs (no object last), cx, cy, w, h; ``gold`` has
    gold (a number), class_id, cx, cy, w, h. Images are independent and small: the
    queries of one image, as a model gives them, are held in a task; the
    assignment takes the gold boxes times the square of the queries.

    Returns (image, gold, query, iou, general_iou, class_loss, box_loss,
    overlap_loss); a gold box beyond the number of queries has a null query.

    Edge cases: images without detections have all queries null and losses 0 but for what is
    missed, 1 a box in overlap; images without gold give no row; rows with
    nulls in box or probabilities are left out; ties go to the smaller query.
    """
    box = ["cx", "cy", "w", "h"]
    known = lambda df, *more: df.where(" AND ".join(f"{c} IS NOT NULL" for c in (image, *box, *more)))
    kind = gold.schema[image].dataType.simpleString()
    # names of their own: both sides may come from one table
    theirs = known(gold, "class_id").select(*[F.col(c).alias(f"g_{c}") for c in (image, "gold", "class_id", *box)])

    def run(key: tuple, found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if wanted.empty:
            return pd.DataFrame(columns=["image", "gold", "query", "iou", "general_iou", "class_loss", "box_loss", "overlap_loss"])
        wanted = wanted.rename(columns=lambda c: c.removeprefix("g_"))
        found, wanted = found.sort_values("query"), wanted.sort_values("gold")
        names = wanted["gold"].astype("int32").to_numpy()
        out = pd.DataFrame({"image": wanted[image].to_numpy(), "gold": names})
        if found.empty:
            return out.assign(query=None, iou=None, general_iou=None, class_loss=0.0, box_loss=0.0, overlap_loss=1.0)
        m = match(np.stack(found["probs"].to_numpy()), found[box].to_numpy(float), wanted["class_id"].to_numpy(int), wanted[box].to_numpy(float))
        query = pd.Series([None] * len(out), dtype="Int32")
        query.iloc[m["cols"]] = found["query"].to_numpy()[m["rows"]]
        iou, general = np.full(len(out), np.nan), np.full(len(out), np.nan)
        iou[m["cols"]], general[m["cols"]] = m["iou"], m["general"]
        return out.assign(query=query, iou=iou, general_iou=general, class_loss=m["class_loss"], box_loss=m["box_loss"], overlap_loss=m["overlap_loss"])

    pairs = known(detections, "probs").select(image, "query", "probs", *box).groupBy(image).cogroup(theirs.groupBy(f"g_{image}")).applyInPandas(run, f"image {kind}, {MATCHED}")
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("iou", "general_iou")]
    return pairs.select("image", "gold", "query", *clean, "class_loss", "box_loss", "overlap_loss")


def detection_measures(matched: DataFrame, least: float = 0.5) -> DataFrame:
    """One row over all images: gold boxes, those found with an IoU of ``least``, their share, and the mean IoU and losses."""
    hit = F.coalesce(F.col("iou") >= least, F.lit(False))
    by_image = F.struct("image", "class_loss", "box_loss", "overlap_loss")
    losses = matched.select(by_image.alias("i")).distinct().agg(*[F.avg(f"i.{c}").alias(c) for c in ("class_loss", "box_loss", "overlap_loss")])
    counts = matched.agg(F.count(F.lit(1)).alias("n_gold"), F.count_if(hit).alias("n_found"), F.avg("iou").alias("mean_iou"))
    return counts.withColumn("recall", F.col("n_found") / F.nullif(F.col("n_gold"), F.lit(0))).crossJoin(losses)  # one row each
