"""Evaluation: predicted receipts against gold, and tag sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.functions.labels import LABEL_ID
from quittance.functions.parse import stem
from quittance.operators.lines import build_lines, top_group

#: Least confidence of a label that evaluation believes.
LEAST_MILLI = 700


def believed(entry: Column, label: str, least_milli: int = LEAST_MILLI) -> Column:
    """Whether an entry's first candidate is ``label`` with enough confidence."""
    top = F.get(entry["labels"], F.lit(0))
    return (top["label_id"] == LABEL_ID[label]) & (top["prob_milli"] >= least_milli)


def predicted(lines: DataFrame, least_milli: int = LEAST_MILLI) -> DataFrame:
    """(receipt_id, vendor, address, date, total, n_articles) from prepared entries.

    Vendor and total are the last believed ones; the address joins all, each
    after a space; the date is the last date with time, else the first date. An
    item line is an article if at least two of its four values are there, of
    which the description always is. A line gives its own last and first ones,
    and the receipt takes those of its lines, so entries are derived once.
    """
    own = build_lines(lines, 1, ("seq", "text", "corrected_num"))
    at = lambda e, c: F.struct(F.col("page_no").alias("page_no"), e["seq"].alias("seq"), e[c].alias(c))
    found = lambda x, c: F.transform(F.filter("members", lambda e: believed(e, x, least_milli)), lambda e: at(e, c))
    has = lambda x: F.exists("members", lambda e: F.coalesce(believed(e, x, least_milli), F.lit(False))).cast("int")
    values = 1 + has("I-item.quantity") + has("I-item.price") + has("I-item.unit_price")
    of_line = own.select(
        "receipt_id",
        F.array_max(found("I-store.name", "text")).alias("vendor"), found("I-store.address", "text").alias("address"), F.array_max(found("I-datetime", "text")).alias("moment"),
        F.array_min(found("I-date_value", "text")).alias("day"), F.array_max(found("I-total.price", "corrected_num")).alias("total"),
        (F.coalesce(top_group(F.col("merged")) == "item_table", F.lit(False)) & (values >= 2)).alias("article"),
    )
    parts = F.transform(F.sort_array(F.flatten(F.collect_list("address"))), lambda v: F.concat(F.lit(" "), v["text"]))
    return of_line.groupBy("receipt_id").agg(
        F.coalesce(F.max("vendor")["text"], F.lit("")).alias("vendor"),
        F.array_join(parts, "").alias("address"),
        F.coalesce(F.max("moment")["text"], F.min("day")["text"], F.lit("")).alias("date"),
        F.max("total")["corrected_num"].alias("total"),
        F.count_if("article").alias("n_articles"),
    )


def compare(gold: DataFrame, prediction: DataFrame, on: str = "receipt_id") -> DataFrame:
    """(key, date_ok, articles_ok, total_ok, n_ok) of the receipts that both have.

    ``gold`` has g_date, g_articles and g_total.
    """
    both = gold.join(prediction, on)
    ok = {
        "date_ok": F.coalesce(F.col("date") == F.col("g_date"), F.lit(False)),
        "articles_ok": F.coalesce(F.col("n_articles") == F.col("g_articles"), F.lit(False)),
        "total_ok": F.coalesce(F.col("total") == F.col("g_total"), F.lit(False)),
    }
    return both.withColumns(ok).select(on, *ok, (F.col("date_ok").cast("int") + F.col("articles_ok").cast("int") + F.col("total_ok").cast("int")).cast("long").alias("n_ok"))


def gold_key(filename: Column) -> Column:
    """The key that gold files give a receipt: its file's name with the ending .JPG."""
    return F.concat(stem(filename), F.lit(".JPG"))


def gold_values(gold: DataFrame) -> DataFrame:
    """(file, g_date, g_articles, g_total) of a gold file's rows."""
    return gold.select("file", F.col("date").alias("g_date"), F.size("articles").cast("long").alias("g_articles"), F.col("total").alias("g_total"))


def evaluate_gold(entries: DataFrame, files: DataFrame, gold: DataFrame, least_milli: int = LEAST_MILLI) -> DataFrame:
    """(file, date_ok, articles_ok, total_ok, n_ok) of prepared entries against a gold file's rows, as read_gold gives them.

    ``files`` has the receipt_id and filename of every receipt; gold files know a
    receipt by the stem of its file. Receipts without gold, and gold without a
    receipt, are left out.
    """
    named = files.select("receipt_id", gold_key(F.col("filename")).alias("file"))
    return compare(gold_values(gold), predicted(entries, least_milli).join(named, "receipt_id"), "file")


def timings(runs: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row: how many runs there were, their sum and their mean."""
    return runs.agg(F.count(seconds).alias("n"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_seconds"), F.avg(seconds).alias("mean_seconds"))


def epoch_loss(batches: DataFrame, keys: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """The mean loss of the batches of each epoch."""
    return batches.groupBy(*keys).agg(F.avg("loss").alias("loss"))


def pixel_accuracy(scores: DataFrame, keys: tuple[str, ...] = ("batch",)) -> DataFrame:
    """The share of pixels whose sigmoid is over one half, that is whose logit is over 0, where the mask is set.

    ``scores`` has arrays ``logits`` and ``mask`` of one length.
    """
    same = F.size(F.filter(F.zip_with("logits", "mask", lambda x, m: (x > 0) == (m > 0)), lambda v: v))
    return scores.groupBy(*keys).agg((F.sum(same) / F.sum(F.size("mask"))).alias("accuracy"))


def accuracy(compared: DataFrame) -> DataFrame:
    """One row: receipts, matches, and their share of three for each receipt."""
    return compared.agg(F.count(F.lit(1)).alias("n_receipts"), F.sum("n_ok").alias("n_matches"), (F.sum("n_ok") / (3 * F.count(F.lit(1)))).alias("accuracy"))


def entity_counts(tags: DataFrame, keys: tuple[str, ...] = ("receipt_id",), order: str = "seq", ignore: str | None = None) -> DataFrame:
    """One row: tokens, equal tokens, gold, predicted and common entities, and precision, recall, F1 and accuracy.

    ``tags`` has gold and pred, names like I-total.price; an entity is a run of one name other than O, and is right if both
    have the same run. Rows whose gold is ``ignore`` are left out first. Rows are
    read once, and are not moved where they lie by some of the ``keys``.
    """
    t = tags.where(F.col("gold") != ignore) if ignore else tags
    w = W.partitionBy(*keys).orderBy(order)
    t = t.withColumn("_i", F.row_number().over(w))
    begins = lambda c: F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(True))
    ends = lambda c: F.coalesce(F.col(c) != F.lead(c).over(w), F.lit(True))
    t = t.withColumns({f"_{k}_{c}": f(c) for c in ("gold", "pred") for k, f in (("begins", begins), ("ends", ends))})
    t = t.withColumns({f"_first_{c}": F.max(F.when(F.col(f"_begins_{c}"), F.col("_i"))).over(w.rowsBetween(W.unboundedPreceding, 0)) for c in ("gold", "pred")})
    # a run is counted where it begins, a common one where both end
    both = F.col("_ends_gold") & F.col("_ends_pred") & (F.col("_first_gold") == F.col("_first_pred")) & (F.col("gold") == F.col("pred"))
    named = lambda c: F.col(c) != "O"
    out = t.agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum((F.col("gold") == F.col("pred")).cast("long")).alias("n_equal"),
        F.count_if(F.col("_begins_gold") & named("gold")).alias("n_gold"), F.count_if(F.col("_begins_pred") & named("pred")).alias("n_pred"), F.count_if(both & named("gold")).alias("n_common"),
    )
    p, r = F.col("n_common") / F.nullif(F.col("n_pred"), F.lit(0)), F.col("n_common") / F.nullif(F.col("n_gold"), F.lit(0))
    return out.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0)), "accuracy": F.col("n_equal") / F.nullif(F.col("n_tokens"), F.lit(0))}).withColumn(
        "f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    )
