import os
import time

import pytest
from pyspark.sql import functions as F

from quittance.streaming import deadline, spool, tracked


def ready(path, **files):
    os.makedirs(f"{path}/ready", exist_ok=True)
    for name, lines in files.items():
        with open(f"{path}/ready/{name}", "w") as f:
            f.write("\n".join(lines))


def test_spool_delivers_notes_and_acknowledges(tmp_path):
    ready(tmp_path, a=["1", "", "2"], b=["3"], c=["4"])
    r = spool.SpoolReader({"path": str(tmp_path), "prefetch": "2", "tasks": "4"})
    assert r.initialOffset() == {"delivery": 0}
    assert r.latestOffset() == {"delivery": 1}
    read = lambda a, b, by=r: sorted(row for p in by.partitions({"delivery": a}, {"delivery": b}) for row in by.read(p))
    assert read(0, 1) == [("1", "a", 1), ("2", "a", 1), ("3", "b", 1)] == read(0, 1)
    assert r.latestOffset() == r.latestOffset() == {"delivery": 2}
    assert spool.waiting(str(tmp_path)) == (3, 2)
    # another reader without a checkpoint begins before what was never acknowledged
    other = spool.SpoolReader({"path": f"file://{tmp_path}", "prefetch": "2"})
    assert other.initialOffset() == {"delivery": 0}
    assert read(0, 2, other) == [("1", "a", 1), ("2", "a", 1), ("3", "b", 1), ("4", "c", 2)]
    r.commit({"delivery": 1})
    r.commit({"delivery": 1})
    assert spool.waiting(str(tmp_path)) == (1, 1)
    assert other.initialOffset() == {"delivery": 1}
    r.commit({"delivery": 2})
    assert spool.waiting(str(tmp_path)) == (0, 0)
    assert r.latestOffset() == {"delivery": 2}  # numbers are not given twice
    ready(tmp_path, a=["5"])
    assert r.latestOffset() == {"delivery": 3}
    assert read(2, 3) == [("5", "a", 3)]
    with pytest.raises(ValueError):
        spool.SpoolReader({"path": "p", "prefetch": "0"})
    with pytest.raises(ValueError):
        spool.SpoolReader({})


def requests(spark, ids, **more):
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    return rows.select(F.to_json(F.struct("id", F.concat(F.lit("i"), "id").alias("image"), F.lit("f").alias("filename"), *[F.lit(v).alias(k) for k, v in more.items()])).alias("value"))


def run(spark, d, process, prefetch=100, **more):
    messages = spool.read_spool(spark, f"{d}/q", prefetch=prefetch, tasks=2)
    worker = tracked.start_tracked_worker(messages, process, f"{d}/out", f"{d}/dead", f"{d}/state", f"{d}/q", **more)
    tracked.drain(worker)


def test_killed_batch_comes_again_and_ids_are_answered_once(spark, tmp_path):
    d = str(tmp_path)
    spool.publish(requests(spark, ["1", "2", "2"]).coalesce(1), f"{d}/q", "a")
    spool.publish(requests(spark, ["2", "3"]).coalesce(1), f"{d}/q", "b")
    calls = []

    def process(r):
        calls.append(sorted(x.id for x in r.collect()))
        if len(calls) == 2:
            raise RuntimeError("worker lost")
        return r.select("id", F.upper("image").alias("result"))

    with pytest.raises(Exception, match="worker lost"):
        run(spark, d, process, prefetch=1)
    assert spool.waiting(f"{d}/q")[1] >= 1
    run(spark, d, process, prefetch=1)
    # the second batch failed and came again with the same messages; an id of an earlier batch is not processed
    assert calls == [["1", "2"], ["3"], ["3"]]
    # after another restart, answered ids are still known
    spool.publish(requests(spark, ["1", "3", "4"]).coalesce(1), f"{d}/q", "c")
    run(spark, d, process)
    assert calls[-1] == ["4"]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{d}/out").select("id", "value", "tries").collect()) == [(i, f'{{"id":"{i}","result":"I{i}"}}', 1) for i in "1234"]
    assert spark.read.parquet(f"{d}/dead").count() == 0


def test_failures_are_tried_again_then_put_aside(spark, tmp_path):
    d = str(tmp_path)
    seen = []
    spool.publish(requests(spark, ["1", "2", "3"]).unionByName(spark.createDataFrame([("{no",), ('{"id":null}',)], "value string")).coalesce(1), f"{d}/q", "a")

    def process(r):
        seen.append(sorted(x.id for x in r.collect()))
        # 2 succeeds when it is tried alone with 3, 3 never does
        ok = (F.col("id") == "1") | ((F.col("id") == "2") & F.lit(len(seen) > 1))
        return r.select("id", F.when(ok, F.lit("ok")).alias("result"), F.when(~ok, F.lit("too dark")).alias("reason"))

    run(spark, d, process, max_tries=3)
    assert seen == [["1", "2", "3"], ["2", "3"], ["3"]]
    assert sorted((r.id, r.tries) for r in spark.read.parquet(f"{d}/out").collect()) == [("1", 1), ("2", 2)]
    dead = {(r.id, r.reason, r.tries) for r in spark.read.parquet(f"{d}/dead").collect()}
    assert dead == {("3", "too dark", 3), (None, "not a request", 0)}
    assert spark.read.parquet(f"{d}/dead").count() == 3


def test_ids_are_forgotten_after_a_time(spark, tmp_path):
    d = str(tmp_path)
    process = lambda r: r.select("id", F.lit("ok").alias("result"))
    for tag, ids in (("a", ["1"]), ("b", ["2"]), ("c", ["1"])):
        spool.publish(requests(spark, ids).coalesce(1), f"{d}/q", tag)
        run(spark, d, process, forget_seconds=0.5)
        time.sleep(1)
    assert sorted(r.id for r in spark.read.parquet(f"{d}/out").collect()) == ["1", "1", "2"]


def maker():
    """The function that makes a worker's function, pickled by value: executors do not have this module."""

    def make():
        import os
        import time

        def work(row):
            if row["image"] == "slow":
                time.sleep(60)
            if row["image"] == "bad":
                raise ValueError("no page")
            if row["image"] == "crash":
                os._exit(9)
            return None if row["image"] is None else f"{row['image']}-{os.getpid()}"

        return work

    return make


def test_one_slow_row_costs_itself(spark):
    rows = [("1", "a"), ("2", "slow"), ("3", "b"), ("4", "bad"), ("5", "crash"), ("6", "c"), ("7", None)]
    df = spark.createDataFrame(rows, "id string, image string").coalesce(1)
    began = time.time()
    got = {r.id: (r.result, r.reason) for r in deadline.answer_rows(df, maker(), 2.0).collect()}
    assert time.time() - began < 40
    assert {i: w for i, (_, w) in got.items()} == {"1": None, "2": "timed out", "3": None, "4": "ValueError: no page", "5": "worker died", "6": None, "7": "no result"}
    pids = {i: got[i][0].split("-")[1] for i in "136"}
    # a child lives on through rows that fail, and is replaced after a late or a deadly one
    assert len(set(pids.values())) == 3


def test_watchdog_keeps_its_child():
    dog = deadline.Watchdog(maker(), 5.0)
    answers = [dog.run({"image": x}) for x in ("a", "bad", "b")]
    assert dog.begun == 1 and answers[0][0].split("-")[1] == answers[2][0].split("-")[1]
    dog.stop()
    slow = deadline.Watchdog(lambda: time.sleep(30), 1.0, start_seconds=0.5)
    with pytest.raises(TimeoutError):
        slow.run({})


def test_deadline_inside_the_queue(spark, tmp_path):
    d = str(tmp_path)
    spool.publish(requests(spark, ["1"]).unionByName(spark.createDataFrame([('{"id":"2","image":"slow"}',)], "value string")).coalesce(1), f"{d}/q", "a")
    run(spark, d, lambda r: deadline.answer_rows(r, maker(), 1.0), max_tries=2)
    assert [(r.id, r.tries) for r in spark.read.parquet(f"{d}/out").collect()] == [("1", 1)]
    assert [(r.id, r.reason, r.tries) for r in spark.read.parquet(f"{d}/dead").collect()] == [("2", "timed out", 2)]
