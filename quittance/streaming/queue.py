"""Receipt requests as a stream: each micro-batch is processed and answered, failures go to a dead-letter table."""

from __future__ import annotations

import signal
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "id string, image string, filename string"


def read_requests(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Requests from files of JSON lines that arrive in a folder, as raw text."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def read_kafka_requests(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Requests from Kafka, where its package is on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def parse_requests(raw: DataFrame, schema: str = REQUEST) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects): rows that parse and have an id, and the raw text of the others."""
    parsed = raw.withColumn("r", F.from_json("value", schema))
    ok = F.col("r").isNotNull() & F.col("r.id").isNotNull()
    return parsed.where(ok).select("r.*"), parsed.where(~ok).select("value", F.lit("not a request").alias("reason"))


def responses(results: DataFrame) -> DataFrame:
    """(id, value): the answer as JSON, {id, result}."""
    return results.select("id", F.to_json(F.struct("id", "result")).alias("value"))


def start_worker(
    raw: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str, schema: str = REQUEST, once: bool = True, timeout: float | None = None
) -> StreamingQuery:
    """Answers requests at least once.

    ``process`` turns requests into (id, result). A batch writes under its own
    number, so a batch that is run again after a failure replaces what it wrote,
    and within a batch a repeated id is answered once. Requests without a result
    and rows that do not parse go to ``dead`` with a reason instead of coming
    back for ever. Where a batch takes over ``timeout`` seconds, its jobs are
    cancelled and its requests go to ``dead`` as timed out.
    """

    def bounded(batch: DataFrame, number: int, work: Callable[[], None]) -> bool:
        """Whether ``work`` was done in time."""
        if timeout is None:
            work()
            return True
        context, late = batch.sparkSession.sparkContext, threading.Event()
        group = f"requests-{number}-{uuid.uuid4().hex}"

        def expire() -> None:
            late.set()
            context.cancelJobGroup(group)

        context.setJobGroup(group, "receipt requests", interruptOnCancel=True)
        timer = threading.Timer(timeout, expire)
        timer.start()
        done = False
        try:
            work()
            done = True  # also where the timer goes off just now: what is written stays
        except Exception:
            if not late.is_set():
                raise
        finally:
            timer.cancel()
            context.setJobGroup(f"{group}-after", "receipt requests")
        return done

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            requests, rejects = parse_requests(batch, schema)
            requests = requests.dropDuplicates(["id"])

            def work() -> None:
                results = process(requests).select("id", "result")
                answered = responses(results.where(F.col("result").isNotNull()))
                answered.write.mode("overwrite").parquet(f"{out}/batch={number}")

            reason = "no result"
            if not bounded(batch, number, work):
                reason = "timed out"
                responses(requests.select("id", F.lit(None).cast("string").alias("result")).limit(0)).write.mode("overwrite").parquet(f"{out}/batch={number}")
            answered = batch.sparkSession.read.parquet(f"{out}/batch={number}")
            failed = requests.join(answered, "id", "left_anti").select(F.to_json(F.struct(*requests.columns)).alias("value"), F.lit(reason).alias("reason"))
            rejects.unionByName(failed).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            batch.unpersist()

    writer = raw.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stop_between_batches(worker: StreamingQuery, patience: float = 60.0) -> None:
    """Stops a worker when no batch is under way, or after ``patience`` seconds; what was cut off is answered after a restart."""
    until = time.monotonic() + patience
    while worker.isActive and worker.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.1)
    worker.stop()


def run_until_signal(worker: StreamingQuery, stop: threading.Event | None = None, signals: tuple[int, ...] = (signal.SIGTERM, signal.SIGINT)) -> None:
    """Waits for the worker's end or a signal, then stops it between batches. Handlers are put back after."""
    stop = stop or threading.Event()
    before = {s: signal.signal(s, lambda *_: stop.set()) for s in signals}
    try:
        while worker.isActive and not stop.is_set():
            worker.awaitTermination(1)
        if worker.isActive:
            stop_between_batches(worker)
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def is_alive(worker: StreamingQuery, longest: float = 600.0) -> bool:
    """Whether a worker runs and has told of its progress in the last ``longest`` seconds, if it has begun at all."""
    last = worker.lastProgress
    if not worker.isActive or not last:
        return worker.isActive
    at = datetime.fromisoformat(last["timestamp"].replace("Z", "+00:00"))
    return (datetime.now(timezone.utc) - at).total_seconds() <= longest
