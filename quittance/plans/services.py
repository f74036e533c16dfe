"""Queries around the receipt tables: the request queue, training sets, written dates, detections against gold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.functions.dates import parse_written_date, written_date_sql
from quittance.functions.geometry import softmax
from quittance.functions.labels import label_of
from quittance.operators.evaluate import entity_counts
from quittance.operators.labeler import Chain, Checkpoints, page_sequences, path_tags, stored, train
from quittance.operators.matching import detection_measures, match_detections
from quittance.operators.receipt import prepare
from quittance.plans import derived as D
from quittance.plans.receipts import _RECEIPT_SQL as RECEIPT
from quittance.plans.receipts import receipt_answers
from quittance.sources.shared import cut, shared_dir, sorted_aggregates
from quittance.streaming.spool import publish, read_spool
from quittance.streaming.tracked import drain, start_tracked_worker

#: Message files that the events are published in, and those of a batch.
MESSAGE_FILES, PREFETCH = 8, 8


def q_queue_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests in an acknowledged queue: answered once, tried three times where there is no receipt.

    The requests of every seventh event are sent a second time after all others,
    so that they come in a later batch; every fiftieth is no request at all.
    """
    base = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    ev = D.table(spark, d, "events")
    good = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), (F.col("user_id") % 2000).cast("string").alias("image"), F.col("event_type").alias("filename")))
    messages = ev.select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).otherwise(good).alias("value"))
    publish(messages.repartition(MESSAGE_FILES, "event_id"), f"{base}/queue", "first")
    publish(messages.where("event_id % 7 = 0 AND event_id % 50 <> 0").coalesce(1), f"{base}/queue", "second")
    wanted = ev.select((F.col("user_id") % 2000).alias("receipt_id")).distinct()
    result = cut(receipt_answers(prepare(D.entries(spark, d, wanted))))
    worker = start_tracked_worker(
        read_spool(spark, f"{base}/queue", prefetch=PREFETCH),
        lambda requests: requests.join(result, "image", "left").select("id", "result"),
        f"{base}/out", f"{base}/dead", f"{base}/state", f"{base}/queue",
    )
    drain(worker)
    answered = spark.read.parquet(f"{base}/out").select("id", F.lit("answer").alias("kind"), F.get_json_object("value", "$.result").alias("result"), "tries")
    dead = spark.read.parquet(f"{base}/dead").select(F.coalesce("id", F.lit("?")).alias("id"), F.lit("dead").alias("kind"), F.col("reason").alias("result"), "tries")
    return answered.unionByName(dead)



def page_examples(spark: SparkSession, d: str) -> DataFrame:
    """A training example for each page: its words, boxes and first labels in order."""
    row = F.struct("seq", "text", F.array("x1", "y1", "x2", "y2").alias("box"), F.get("labels", F.lit(0))["label_id"].alias("tag"))
    sorted_aggregates(spark)
    page = ("receipt_id", "page_no")
    own = D.entries(spark, d).select(*page, row.alias("row")).sortWithinPartitions(*page).groupBy(*page).agg(F.sort_array(F.collect_list("row")).alias("own"))
    part = lambda c: F.transform("own", lambda v: v[c])
    return own.select("receipt_id", "page_no", part("text").alias("words"), part("box").alias("bboxes"), part("tag").alias("ner_tags"))


#: Tokens of a window and how many of them the next one repeats.
WINDOW, STRIDE = 64, 16


def q_encode_words(spark: SparkSession, d: str) -> DataFrame:
    """Sub-word features of all pages, in windows that overlap: sizes and a checksum of the ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quittance.operators.encoding import Rules, encode_words

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = tokenizer.token_to_id("<|endoftext|>")
    made = encode_words(page_examples(spark, d), tokenizer, Rules(special, special, special, WINDOW), ("receipt_id", "page_no"), STRIDE)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda m, x: m + x)
    return made.select(
        "receipt_id", "page_no", "window", "n_windows", total("attention_mask").alias("n_tokens"), F.size(F.filter("labels", lambda x: x >= 0)).alias("n_labels"),
        total(F.transform("bbox", total)).alias("box_sum"), F.crc32(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")).alias("ids_crc"),
    )


# Names of the months as they are written.
ENGLISH = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
GERMAN = ("Januar", "Februar", "Marz", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
DUTCH = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")
FRENCH = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
SPANISH = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def _written(month: object, text: object) -> list[object]:
    """Ways to write an order's date; ``month`` names it in a language, ``text`` joins its parts."""
    return [
        text("{d} ", month(ENGLISH), " {y}"), text("Mon, ", month(ENGLISH), " {d}th, {y} 10:15"), text("Datum: Freitag, {d}. ", month(GERMAN), " {y}"), text("le {d} ", month(FRENCH), " ''{yy}"),
        text(month(DUTCH), " {y}"), text("{d} de ", month(SPANISH), " de {y}"), text("vrijdag {d} ", month(DUTCH)), text("{y}-", month(ENGLISH), "-{d}"), text("31 ", month(ENGLISH), " {y}"),
        text(month(ENGLISH), " {d}"), text("may we {d} help"), text("{d}/{m}/{y}"),
    ]


def q_written_date(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written out in twelve ways, and read again."""
    at = F.col("o_orderdate")
    month = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month(at))
    parts = {"{d}": F.dayofmonth(at).cast("string"), "{m}": F.month(at).cast("string"), "{yy}": F.date_format(at, "yy"), "{y}": F.year(at).cast("string")}

    def text(*pieces: object) -> object:
        made = []
        for p in pieces:
            if isinstance(p, str):
                p = F.lit(p.replace("''", "'"))
                for k, v in parts.items():
                    p = F.replace(p, F.lit(k), v)
            made.append(p)
        return F.concat(*made)

    ways = _written(month, text)
    made = F.element_at(F.array(*ways), (F.col("o_orderkey") % len(ways) + 1).cast("int"))
    rows = D.table(spark, d, "orders").select("o_orderkey", made.alias("text")).withColumn("r", parse_written_date(F.col("text"), 2001))
    return rows.select("o_orderkey", "text", F.col("r.date").cast("string").alias("value"), F.col("r.precision").alias("precision"))


def _written_sql() -> str:
    month = lambda names: f"list_extract([{', '.join(map(repr, names))}], month(o_orderdate)::INT)"
    parts = {"{d}": "day(o_orderdate)::VARCHAR", "{m}": "month(o_orderdate)::VARCHAR", "{yy}": "strftime(o_orderdate, '%y')", "{y}": "year(o_orderdate)::VARCHAR"}

    def text(*pieces: str) -> str:
        made = []
        for p in pieces:
            if not p.startswith("list_extract"):
                p = f"'{p}'"
                for k, v in parts.items():
                    p = f"replace({p}, '{k}', {v})"
            made.append(p)
        return f"({' || '.join(made)})"

    ways = _written(month, text)
    date, precision = written_date_sql("text", "2001")
    return f"""WITH t AS (SELECT o_orderkey, list_extract([{', '.join(ways)}], (o_orderkey % {len(ways)} + 1)::INT) AS text FROM orders)
SELECT o_orderkey, text, ({date})::VARCHAR AS value, {precision} AS precision FROM t"""


#: Queries of an image, and one in so many of them that has a gold box close to it.
QUERIES_EACH, GOLD_EACH = 25, 5


def detections_and_gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Detections from vectors, as many for each image, and gold boxes beside some of them."""
    e = F.col("embedding")
    at = lambda i: F.abs(e[i].cast("double"))
    x = D.table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / QUERIES_EACH).alias("image"), (F.col("vec_id") % QUERIES_EACH).cast("int").alias("query"), softmax(F.transform(F.slice(e, 1, 4), lambda v: v.cast("double") * 8)).alias("probs"),
        (0.2 + at(4)).alias("cx"), (0.2 + at(5)).alias("cy"), (0.1 + at(6) / 2).alias("w"), (0.1 + at(7) / 2).alias("h"), e[8].cast("double").alias("off"),
    )
    gold = x.where(F.col("query") % GOLD_EACH == 0).select(
        "image", F.col("query").alias("gold"), (F.col("query") % 3).alias("class_id"), (F.col("cx") + F.col("off") / 4).alias("cx"), (F.col("cy") - F.col("off") / 4).alias("cy"), "w", "h"
    )
    return x.drop("off"), gold


def q_set_matching(spark: SparkSession, d: str) -> DataFrame:
    """The assignment of detections to gold boxes, with overlaps and losses."""
    made = match_detections(*detections_and_gold(spark, d))
    return made.select("image", "gold", "query", *[F.round(c, 6).alias(c) for c in ("iou", "general_iou", "class_loss", "box_loss", "overlap_loss")])


def q_set_measures(spark: SparkSession, d: str) -> DataFrame:
    """Gold boxes found with an overlap of a half, and mean losses, over all images."""
    found = detection_measures(match_detections(*detections_and_gold(spark, d)))
    return found.select("n_gold", "n_found", *[F.round(c, 6).alias(c) for c in ("mean_iou", "recall", "class_loss", "box_loss", "overlap_loss")])



#: One page in so many is held out, and one scores the labeler while it learns.
HELD_OUT = 5


def tagged(pages: DataFrame) -> DataFrame:
    """(receipt_id, page_no, seq, gold, pred) by label names, for entity_counts, from pages with their ``tags`` and a ``path`` of as many."""
    own = pages.select("receipt_id", "page_no", F.explode(F.arrays_zip("seqs", "tags", "path")).alias("t"))
    return own.select("receipt_id", "page_no", F.col("t.seqs").alias("seq"), label_of(F.col("t.tags")).alias("gold"), label_of(F.col("t.path")).alias("pred"))


def q_train_labeler(spark: SparkSession, d: str) -> DataFrame:
    """A labeler learned from four fifths of the pages, held against the majority label on the fifth that it has not seen.

    It is fitted on three fifths, and scored on one while it learns. Pages are
    derived once and stored; all is read from there, the majority label too.
    """
    base = f"{shared_dir(spark)}/labeler-{uuid.uuid4().hex}"
    page = ("receipt_id", "page_no")
    fold = F.pmod(F.xxhash64(*page), F.lit(HELD_OUT))
    pages = stored(page_sequences(D.entries(spark, d), F.get("labels", F.lit(0))["label_id"]), f"{base}/pages")
    held, some, own = pages.where(fold == 0), pages.where(fold == 1), pages.where(fold > 1)

    def score(chain: Chain) -> float:
        return entity_counts(tagged(path_tags(some, chain)), page).first().f1

    chain = train(own, Checkpoints(spark, f"{base}/chains"), score, steps=18)
    by_chain = entity_counts(tagged(path_tags(held, chain)), page)
    most = own.select(F.explode("tags").alias("most")).groupBy("most").count().orderBy(F.desc("count"), "most").limit(1).select("most")
    majority = held.crossJoin(F.broadcast(most)).withColumn("path", F.transform("tags", lambda t: F.col("most")))  # one row
    by_majority = entity_counts(tagged(majority), page)
    named = lambda df, name: df.select(F.lit(name).alias("labeler"), "n_tokens", "n_equal", "n_gold", "n_pred", "n_common", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])
    return named(by_chain, "chain").unionByName(named(by_majority, "majority"))


SQL = {
    "q_queue_receipts": f"""WITH rec AS ({RECEIPT}),
ans AS (SELECT receipt_id, concat_ws('|', store_name, date, total_text, n_items::VARCHAR) AS result FROM rec),
req AS (SELECT 'e' || event_id::VARCHAR AS id, user_id % 2000 AS receipt_id FROM events WHERE event_id % 50 <> 0)
SELECT id, CASE WHEN result IS NULL THEN 'dead' ELSE 'answer' END AS kind, coalesce(result, 'no result') AS result, CASE WHEN result IS NULL THEN 3 ELSE 1 END AS tries
FROM req LEFT JOIN ans USING (receipt_id)
UNION ALL SELECT '?', 'dead', 'not a request', 0 FROM events WHERE event_id % 50 = 0""",
    "q_written_date": _written_sql(),
}

QUERIES = {f.__name__: f for f in (q_queue_receipts, q_encode_words, q_written_date, q_set_matching, q_set_measures, q_train_labeler)}
