from quittance.functions.labels import LABELS
from quittance.operators import lines as L
from quittance.operators import receipt as R
from quittance.operators.detection import chunks

SCHEMA = "receipt_id string, page_no int, seq int, text string, x1 int, y1 int, x2 int, y2 int, ocr_milli int, labels array<struct<label_id:int,label:string,prob_milli:int>>"


def entry(seq, text, y1, y2, cands, ocr=900, x1=0, page=0, rid="r"):
    return (rid, page, seq, text, x1, y1, x1 + 10, y2, ocr, [(i, LABELS[i][1], p) for i, p in cands])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


PRICE = [(34, 800), (0, 100), (50, 50)]


def test_segmentation_branches(spark):
    boxes = [(0, 20), (30, 50), (35, 45), (40, 60), (49, 69), (40, 90), (0, 5)]
    # below; inside; 5/25 overlap: new; 11/29 < half: new; 29/41: joins though it encloses; above but ends before: joins
    df = L.segment_lines(frame(spark, [entry(i, "t", a, b, PRICE) for i, (a, b) in enumerate(boxes)]))
    assert [r.line_no for r in df.orderBy("seq").collect()] == [0, 1, 1, 2, 3, 3, 3]


def test_half_overlap_is_no_new_line(spark):
    # overlap 10 of 20: exactly one half joins
    df = L.segment_lines(frame(spark, [entry(0, "a", 0, 15, PRICE), entry(1, "b", 5, 20, PRICE), entry(2, "c", 13, 28, PRICE)]))
    assert [r.line_no for r in df.orderBy("seq").collect()] == [0, 0, 1]


def test_reading_order(spark):
    df = L.order_entries(frame(spark, [entry(0, "b", 50, 60, PRICE), entry(1, "a", 0, 10, PRICE)]), "reading")
    assert [r.text for r in df.orderBy("pos").collect()] == ["a", "b"]


def merged(spark, cands):
    df = L.segment_lines(frame(spark, [entry(i, "t", 0, 20, c) for i, c in enumerate(cands)]))
    return [tuple(x) for x in L.merge_labels(df).first().merged]


def test_vote_empty_line_gives_o(spark):
    assert merged(spark, [[(0, 900), (0, 50), (0, 10)]]) == [("O", 0), ("datetime", 0), ("header", 0)]


def test_vote_order_and_ties(spark):
    got = merged(spark, [[(34, 500), (71, 500), (33, 100)]])
    # item_table: 500 then 500 + 0.5 * 100 = 550
    assert got[0] == ("item_table", 550) and got[1] == ("total", 500)
    assert merged(spark, [[(71, 400), (34, 400), (0, 1)]])[:2] == [("item_table", 400), ("total", 400)]


def test_conflict_ignores_o(spark):
    for cands, want in (([34, 33], False), ([0, 34], False), ([34, 71], True)):
        df = L.segment_lines(frame(spark, [entry(i, "t", 0, 20, [(c, 900), (1, 5), (2, 1)]) for i, c in enumerate(cands)]))
        assert L.line_info(df).first().conflict is want


def test_in_line_search_stops_at_own_group(spark):
    cands = [[(34, 5), (31, 3), (71, 1)], [(31, 5), (34, 3), (71, 1)], [(71, 5), (34, 3), (31, 1)]]
    df = frame(spark, [entry(i, "t", 0, 20, c) for i, c in enumerate(cands)])
    got = df.select("seq", L.search_in_line(df.labels, 34).alias("c")).orderBy("seq").collect()
    assert [r.c.prob_milli if r.c else None for r in got] == [5, None, 3]


def test_equal_texts_merge_and_last_value_stays(spark):
    rows = [entry(0, "1,00", 0, 10, [(71, 500), (0, 1), (1, 1)], 500), entry(1, "1,00", 50, 60, [(71, 500), (0, 1), (1, 1)], 500), entry(2, "9,00", 90, 99, [(85, 700), (0, 1), (1, 1)])]
    best = {r.field: r for r in R.best_fields(R.merged_texts(R.prepare(frame(spark, rows)))).collect()}
    total = best["total.price"]
    assert (total.text, total.ocr_milli, total.du_milli, len(total.boxes), total.corrected_num) == ("1,00", 750, 750, 2, 1.0)
    assert best["payment.other_price"].text == "9,00"


def test_union_of_three_labels_feeds_total(spark):
    rows = [entry(i, str(i), 40 * i, 40 * i + 9, [(c, p), (0, 1), (1, 1)]) for i, (c, p) in enumerate([(71, 500), (85, 900), (87, 700)])]
    best = {r.field: r.text for r in R.best_fields(R.merged_texts(R.prepare(frame(spark, rows)))).collect()}
    assert best["total.price"] == "1"


def test_first_seen_wins_ties(spark):
    rows = [entry(0, "b", 0, 9, [(20, 500), (0, 1), (1, 1)]), entry(1, "a", 50, 59, [(20, 500), (0, 1), (1, 1)])]
    assert R.best_fields(R.merged_texts(R.prepare(frame(spark, rows)))).first().text == "b"


def test_unmapped_label_has_no_value(spark):
    row = R.correct_entries(frame(spark, [entry(0, "1,00", 0, 9, [(79, 900), (0, 1), (1, 1)])])).first()
    assert row.corrected_kind is None and row.corrected_num is None


def test_tail_counts(spark):
    for n in (9, 10, 11, 20, 23):
        df = frame(spark, [entry(i, "t", 0, 9, PRICE) for i in range(n)])
        assert chunks(df, duplicate_tail=True).count() == n + (n % 10 if n >= 10 else 0)
        assert chunks(df).count() == n


def test_pages_follow_each_other_and_empty_input(spark):
    rows = [entry(0, "milk", 0, 9, [(32, 900), (0, 1), (1, 1)], page=1), entry(0, "bread", 0, 9, [(32, 900), (0, 1), (1, 1)])]
    t = R.table_lines(R.prepare(frame(spark, rows)), "item_table", R.ITEM_FIELDS)
    assert [r.description.text for r in t.orderBy("page_no", "line_no").collect()] == [["bread"], ["milk"]]
    assert R.receipt_documents(R.prepare(frame(spark, []))).count() == 0
