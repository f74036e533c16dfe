"""Text lines: order, segmentation, votes, conflicts, boxes.

Entries have receipt_id, page_no, seq, text, x1, y1, x2, y2, ocr_milli and
labels, an array of (label_id, label, prob_milli), the likeliest first. All
windows and aggregates begin with receipt_id, so one exchange on it serves them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.functions.labels import GROUP_NAMES, LABELS, group_of, group_ord_of
from quittance.sources.shared import sorted_aggregates

PAGE = ("receipt_id", "page_no")
LINE = (*PAGE, "line_no")


def _order(order: str) -> tuple[str, ...]:
    """Columns that order a page: recogniser order ("ocr"), or by upper left corner ("reading")."""
    return ("seq",) if order == "ocr" else ("y1", "x1", "seq")


def order_entries(entries: DataFrame, order: str = "ocr") -> DataFrame:
    """Numbers the entries of a page from 0 as ``pos``."""
    return entries.withColumn("pos", (F.row_number().over(W.partitionBy(*PAGE).orderBy(*_order(order))) - 1).cast("long"))


def starts_line(y1: Column, y2: Column, py1: Column, py2: Column) -> Column:
    """Whether an entry begins a line, given the one before it.

    It does where there is none before; where it lies clearly below; or where it
    reaches further down and overlaps by less than half of the common range.
    """
    return py1.isNull() | (y1 >= py2) | (~(y2 <= py2) & (2 * (py2 - y1) < (y2 - py1)))


def segment_lines(entries: DataFrame, order: str = "ocr") -> DataFrame:
    """Adds ``pos`` and ``line_no``, from 0 in each page."""
    w = W.partitionBy(*PAGE).orderBy(*_order(order))  # the order of pos itself, so that one sort serves all
    new = starts_line(F.col("y1"), F.col("y2"), F.lag("y1").over(w), F.lag("y2").over(w))
    return order_entries(entries, order).withColumn("_new", new.cast("int")).withColumn("line_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_new")


def slim(labels: Column) -> Column:
    """Candidates without their names, which label_of gives back: half the bytes where entries are collected."""
    return F.arrays_zip(labels["label_id"].alias("label_id"), labels["prob_milli"].alias("prob_milli"))


def rank_groups(top: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """A function of lines' label ids and confidences, in order, that gives the ``top`` groups of each as (grp, score_milli).

    Candidates are folded by group, in order; label 0, and what has no group or no
    confidence, has no vote. All groups take part, those without a vote at 0; ties
    in the order of groups. The lines of a batch are folded together, a vote of
    each group at a time.
    """
    ordinals = np.array([-1 if x[0] == 0 else x[3] for x in LABELS], np.int64)
    n_groups, names = len(GROUP_NAMES), pa.array(GROUP_NAMES)

    def rank(ids: pa.Array, probs: pa.Array) -> pa.Array:
        flat_ids, flat_probs = ids.flatten(), probs.flatten()
        of = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
        known = pc.and_(flat_ids.is_valid(), flat_probs.is_valid()).to_numpy(zero_copy_only=False)
        label, p = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (flat_ids, flat_probs))
        group = np.where(known & (label >= 0) & (label < len(ordinals)), ordinals[np.clip(label, 0, len(ordinals) - 1)], -1)
        votes = np.flatnonzero(group >= 0)
        key, p = of[votes] * n_groups + group[votes], p[votes]
        order = np.argsort(key, kind="stable")
        key, p = key[order], p[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(np.append(begin, len(key)))
        score = np.zeros(len(ids) * n_groups, np.int64)
        turn, at = 0, begin
        while len(at):
            m = score[key[at]]
            score[key[at]] = m + ((1000 - m) * p[at] + 500) // 1000
            turn += 1
            at = begin[size > turn] + turn
        score = score.reshape(len(ids), n_groups)
        best = np.argsort(-score, axis=1, kind="stable")[:, :top]
        rows = pa.StructArray.from_arrays([names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, 1).ravel())], names=["grp", "score_milli"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * best.shape[1], pa.int32()), rows)

    return rank


def _ranked(members: Column, top: int) -> Column:
    """The ``top`` groups of a line as (grp, score_milli) from its (pos, labels) in order of pos.

    It is called nondeterministic so that a condition on it is not pushed below, which would compute it twice.
    """
    votes = F.flatten(members["labels"])
    rank = F.arrow_udf(rank_groups(top), "array<struct<grp:string,score_milli:bigint>>").asNondeterministic()
    return rank(votes["label_id"], votes["prob_milli"])


def best_groups(lines: Column) -> Column:
    """The best group of each line in an array of lines that have ``members``."""
    rank = rank_groups(1)

    def best(ids: pa.Array, probs: pa.Array) -> pa.Array:
        of_line = rank(ids.flatten(), probs.flatten()).flatten().field("grp")
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), of_line)

    of = lambda c: F.transform(lines, lambda line: F.flatten(line["members"]["labels"])[c])
    return F.arrow_udf(best, "array<string>").asNondeterministic()(of("label_id"), of("prob_milli"))


def gather_lines(lines: DataFrame, keep: tuple[str, ...] = (), beside: Column | None = None) -> DataFrame:
    """One row per line: n_entries, conflict and box; ``members``, its entries in order, with pos, labels (slim) and the columns ``keep``.

    ``beside`` is a value of entries: a list of those that are not null comes as ``beside``, in no order.

    Conflict is set where the first candidates, but for label 0, are of several
    groups. All comes from one aggregate, so lines need no join with their entries.
    Members are made before they are sorted by line, where they lie, and gathered
    as they come: nothing is held but the line at hand.
    """
    sorted_aggregates(lines.sparkSession)
    first = F.get("labels", F.lit(0))["label_id"]
    made = lines.select(
        *LINE, F.struct("pos", slim(F.col("labels")).alias("labels"), *keep).alias("_member"), F.when(first != 0, group_ord_of(first)).alias("_group"),
        F.least("x1", "x2").alias("_x1"), F.least("y1", "y2").alias("_y1"), F.greatest("x1", "x2").alias("_x2"), F.greatest("y1", "y2").alias("_y2"),
        *([] if beside is None else [beside.alias("_beside")]),
    )
    return made.sortWithinPartitions(*LINE).groupBy(*LINE).agg(
        F.sort_array(F.collect_list("_member")).alias("members"), F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.min("_group") < F.max("_group"), F.lit(False)).alias("conflict"),
        F.min("_x1").alias("x1"), F.min("_y1").alias("y1"), F.max("_x2").alias("x2"), F.max("_y2").alias("y2"),
        *([] if beside is None else [F.collect_list("_beside").alias("beside")]),
    )


def build_lines(lines: DataFrame, top: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines as ``gather_lines`` gives them, and ``merged``, the ``top`` groups best first."""
    return gather_lines(lines, keep).withColumn("merged", _ranked(F.col("members"), top))


def merge_labels(lines: DataFrame, top: int = 3) -> DataFrame:
    """(line, merged): the ``top`` groups of each line as (grp, score_milli), best first, ties in the order of groups."""
    sorted_aggregates(lines.sparkSession)
    made = lines.select(*LINE, F.struct("pos", slim(F.col("labels")).alias("labels")).alias("_member")).sortWithinPartitions(*LINE)
    own = made.groupBy(*LINE).agg(F.sort_array(F.collect_list("_member")).alias("members"))
    return own.select(*LINE, _ranked(F.col("members"), top).alias("merged"))


def line_info(lines: DataFrame) -> DataFrame:
    """(line, n_entries, conflict, box): conflict is set where the first candidates, but for label 0, are of several groups."""
    first = F.get("labels", F.lit(0))["label_id"]
    group = F.when(first != 0, group_ord_of(first))
    return lines.groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.min(group) < F.max(group), F.lit(False)).alias("conflict"),
        F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"),
    )


def union_box_per_token(lines: DataFrame) -> DataFrame:
    """The line's box repeated on each of its entries."""
    w = W.partitionBy(*LINE)
    return lines.withColumns({"lx1": F.min(F.least("x1", "x2")).over(w), "ly1": F.min(F.least("y1", "y2")).over(w), "lx2": F.max(F.greatest("x1", "x2")).over(w), "ly2": F.max(F.greatest("y1", "y2")).over(w)})


def top_group(merged: Column) -> Column:
    return F.get(merged, F.lit(0))["grp"]


def search_in_line(labels: Column, target_id: int) -> Column:
    """The candidate of label ``target_id``, where no other label of its group ranks before it; else null."""
    own = F.filter(labels, lambda c: group_of(c["label_id"]) == group_of(F.lit(target_id)))
    first = F.get(own, F.lit(0))
    return F.when(first["label_id"] == target_id, first)
