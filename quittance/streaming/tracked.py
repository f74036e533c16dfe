"""Requests tracked by id across batches: answered once, tried again a bounded number of times, then put aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quittance.streaming.queue import REQUEST, parse_requests, responses
from quittance.streaming.spool import publish

#: Files that the retries of a batch are published in, at most.
RETRY_FILES = 8
#: What a worker's query runs with: state on disk rather than in the heap, and a batch without messages where the
#: clock has moved on, in which ids are forgotten.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "true",
}


def track(requests: DataFrame, forget_ms: int) -> DataFrame:
    """The first delivery of each try of an id; later ones are dropped.

    ``requests`` has (id, body, tries). The state is the tries that were seen, by
    id, in Spark's own store, so no function is called for an id. A try is
    remembered for ``forget_ms`` at least, and twice that where messages keep
    coming; then it would be answered anew. Only the worker writes ``tries`` into
    messages, after the try before has failed.
    """
    dated = requests.withColumn("_at", F.current_timestamp()).withWatermark("_at", f"{forget_ms} milliseconds")
    return dated.dropDuplicatesWithinWatermark(["id", "tries"]).drop("_at")


def start_tracked_worker(
    messages: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    out: str,
    dead: str,
    checkpoint: str,
    retries: str,
    max_tries: int = 3,
    forget_seconds: float = 86_400.0,
    schema: str = REQUEST,
) -> StreamingQuery:
    """Answers each request id once, over all batches and restarts.

    ``messages`` is a stream with ``value``, as of read_spool. ``process`` turns
    requests into (id, result), or (id, result, reason). An id that was seen
    before is not processed again, whichever batch it came in, for
    ``forget_seconds``. A request without a result is published to the spool
    ``retries`` (as a rule the one it came from) with its number of tries; after
    ``max_tries`` it goes to ``dead`` with the reason of the last try, as do
    messages that do not parse, at once. Tables are written under the number of
    their batch, so a batch that runs again after a failure replaces them, and
    the state of ids is that of the batch before: no answer is lost or doubled.

    ``out`` has (id, value, tries), ``dead`` (id, value, reason, tries), both by batch.
    """
    spark = messages.sparkSession
    envelope = F.from_json("value", f"{schema}, tries int")
    body = F.to_json(F.from_json("value", schema))
    known = envelope["id"].isNotNull()
    # what does not parse has no id to be tracked by: it passes under a number of its own and is put aside in its batch
    keyed = messages.select(
        F.when(known, envelope["id"]).otherwise(F.concat(F.lit("?"), F.uuid())).alias("id"),
        F.when(known, body).otherwise(F.col("value")).alias("body"),
        F.when(known, F.coalesce(envelope["tries"], F.lit(0))).otherwise(F.lit(-1)).alias("tries"),
    )

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if batch.count() == 0:  # all of it is computed, so that the state is kept
                return
            _, rejects = parse_requests(batch.where("tries < 0").select(F.col("body").alias("value")), schema)
            fresh = batch.where("tries >= 0").select(F.from_json("body", schema).alias("r"), "body", (F.col("tries") + 1).alias("tries"))
            done = process(fresh.select("r.*"))
            if "reason" not in done.columns:
                done = done.withColumn("reason", F.lit(None).cast("string"))
            done = fresh.select(F.col("r.id").alias("id"), "body", "tries").join(done.select("id", "result", "reason"), "id", "left").persist()
            try:
                ok = F.col("result").isNotNull()
                answered = responses(done.where(ok)).join(done.where(ok).select("id", "tries"), "id")
                answered.write.mode("overwrite").parquet(f"{out}/batch={number}")
                failed = done.where(~ok).withColumn("reason", F.coalesce("reason", F.lit("no result")))
                lost = failed.where(F.col("tries") >= max_tries).select("id", F.col("body").alias("value"), "reason", "tries")
                bad = rejects.select(F.lit(None).cast("string").alias("id"), "value", "reason", F.lit(0).alias("tries"))
                lost.unionByName(bad).write.mode("overwrite").parquet(f"{dead}/batch={number}")
                again = failed.where(F.col("tries") < max_tries)
                if not again.isEmpty():
                    told = F.from_json("body", f"{schema}, tries int").withField("tries", F.col("tries"))
                    publish(again.select(F.to_json(told).alias("value")).coalesce(RETRY_FILES), retries, f"retry-{number:09d}")
            finally:
                done.unpersist()
        finally:
            batch.unpersist()

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        tracked = track(keyed, int(forget_seconds * 1000))
        return tracked.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(worker: StreamingQuery) -> None:
    """Waits until a worker has taken all that is ready, retries included, then stops it; its failure is raised."""
    try:
        worker.processAllAvailable()
    finally:
        worker.stop()
