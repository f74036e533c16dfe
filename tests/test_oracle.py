import pytest

from oracle import connect, rows_of, rows_of_sql
from quittance.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = rows_of(registry.queries()[name](spark, DIR))
    want = rows_of_sql(duck, registry.oracle_sql()[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stream_answers_each_request_once(spark):
    rows = registry.queries()["q_stream_receipts"](spark, DIR).collect()
    ids = [r.id for r in rows if r.id != "?"]
    assert len(ids) == len(set(ids)) == 980 and len(rows) == 1000
    assert sum(r.result == "not a request" for r in rows) == 20


def test_stream_takes_every_event(spark):
    d = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{d}/events.parquet")
    n, broken = events.count(), events.where("event_id % 50 = 0").count()
    rows = registry.queries()["q_stream_receipts"](spark, d).collect()
    ids = [r.id for r in rows if r.id != "?"]
    assert n > 3000 and len(rows) == n and len(ids) == len(set(ids)) == n - broken
    assert sum(r.result == "not a request" for r in rows) == broken


def test_documents_are_json(spark):
    import json

    row = registry.queries()["q_receipt_json"](spark, DIR).first()
    doc = json.loads(row.json)["receipt"]
    assert list(doc) == ["date", "time", "tax_table", "store", "item_table", "sub_total", "total", "payment"]
    assert doc["time"] is None and doc["store"]["name"]["text"].startswith("Store ")
    assert doc["total"]["price"]["metadata"]
