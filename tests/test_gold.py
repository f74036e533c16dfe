import json

from pyspark.sql import functions as F

from quittance.operators import evaluate, scorers
from quittance.operators.receipt import prepare
from quittance.plans import derived, drawn
from quittance.sources import readers

SF = "/root/testdata/sf0.001"


def test_receipts_against_a_gold_file(spark, tmp_path):
    entries = prepare(derived.entries(spark, SF).where("receipt_id < 8"))
    found = {r.receipt_id: r for r in evaluate.predicted(entries).collect()}
    gold = {
        f"IMG_{k}.JPG": {"vendor": r.vendor, "address": "", "date": r.date if k % 2 else "1.1.1999", "articles": [{"description": "x", "quantity": 1, "tot_art_price": 1, "unit_price": 1}] * r.n_articles, "total": r.total}
        for k, r in found.items() if k != 3
    } | {"OTHER.JPG": {"vendor": "", "address": "", "date": "", "articles": [], "total": 1}}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    files = spark.createDataFrame([(k, f"/photos/IMG_{k}.jpeg") for k in found], "receipt_id long, filename string")
    out = evaluate.evaluate_gold(entries, files, readers.read_gold(spark, str(tmp_path / "gold.json")))
    rows = {r.file: r for r in out.collect()}
    assert set(rows) == {f"IMG_{k}.JPG" for k in found if k != 3} and len(rows) >= 6
    for k, r in found.items():
        if k != 3:
            got = rows[f"IMG_{k}.JPG"]
            assert (got.date_ok, got.articles_ok, got.total_ok) == (bool(k % 2), True, r.total is not None)
    total = evaluate.accuracy(out).first()
    assert total.n_receipts == len(rows) and total.n_matches == sum(r.n_ok for r in rows.values())


def test_steps_are_timed(spark):
    pages = drawn.drawn_pages(spark, SF).where("receipt_id < 4")
    docs, taken = scorers.pipeline("default", scorer=drawn.drawn_scorer()).run_timed(pages)
    rows = taken.orderBy("step").collect()
    n = pages.count()
    assert [r.n_rows for r in rows] == [3 * n, n] and docs.count() == n
    one = evaluate.timings(taken).first()
    assert one.n == 2 and one.total_seconds > 0 and all(r.seconds > 0 for r in rows)
    assert taken.agg(F.sum("seconds")).first()[0] == one.total_seconds
