"""Steps that have to grow with the tables: what they read, move and call, and that results stay."""

import random

import numpy as np
from pyspark.sql import functions as F

from quittance.operators import evaluate, images, preocr, scorers

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """Exchanges of a plan, without those that are used again."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "ReusedExchange" not in line for line in text.splitlines())


def test_without_photos_no_chain_reads_scores(spark):
    calls = []

    class Reader(scorers.FixtureScorer):
        def read_text(self, pages, recognise=True):
            calls.append(recognise)
            return super().read_text(pages, recognise)

    kind = "receipt_id long, page_no int, seq long, quad array<struct<x:double,y:double>>, text string, ocr_milli long"
    tokens = spark.createDataFrame([(1, 0, 0, [(0.0, 0.0), (9.0, 0.0), (9.0, 5.0), (0.0, 5.0)], "Total", 900)], kind)
    pages = spark.createDataFrame([(1, 0, "a.jpg", 10, 10, 3, None)], "receipt_id long, page_no int, filename string, height int, width int, n_channels int, data binary")
    done, read = preocr.read_pages(pages, Reader(tokens=tokens))
    assert calls == [True]
    assert done.columns == pages.columns and done.collect() == pages.collect() and read.collect() == tokens.collect()


def test_colours_are_counted_by_a_page_at_a_time():
    rng = np.random.default_rng(3)
    for n, channels, size in ((4096, 3, 4096), (100, 3, 100), (3000, 3, 2000), (50, 1, 50), (2500, 4, 2500), (10, 3, 0)):
        data = rng.integers(0, 3, size * channels).astype(np.uint8).tobytes()
        order = sorted(range(n), key=lambda i: ((48271 * i + 17) % 2147483647, i))[:2000]
        assert images.colours_drawn(n, channels, data, 2000, 17) == len({data[i * channels : (i + 1) * channels] for i in order})
    assert images.drawn_pixels(4096, 2000, 17) is images.drawn_pixels(4096, 2000, 17)


def test_entities_are_counted_in_one_pass(spark):
    rng = random.Random(5)
    names = ["O", "O", "I-a", "I-b", None]
    rows = [(p, p % 2, s, rng.choice(names), rng.choice(names) if rng.random() < 0.4 else None) for p in range(60) for s in range(rng.randint(1, 9))]
    rows = [(p, k, s, g, g if q is None else q) for p, k, s, g, q in rows]

    def runs(p, c):
        own, out = [r[c] for r in rows if r[0] == p], []
        for i, name in enumerate(own):
            if i and name is not None and own[i - 1] == name:
                out[-1][2] = i
            else:
                out.append([name, i, i])
        return {tuple(x) for x in out if x[0] not in ("O", None)}

    df = spark.createDataFrame(rows, "receipt_id long, page_no int, seq int, gold string, pred string").repartition(3, "receipt_id")
    out = evaluate.entity_counts(df, ("receipt_id", "page_no"))
    gold, pred = ([runs(p, c) for p in range(60)] for c in (3, 4))
    got = out.first()
    assert (got.n_tokens, got.n_gold, got.n_pred) == (len(rows), sum(map(len, gold)), sum(map(len, pred)))
    assert got.n_common == sum(len(g & q) for g, q in zip(gold, pred, strict=True))
    assert got.n_equal == sum(r[3] is not None and r[3] == r[4] for r in rows)
    # the rows lie by receipt already: what moves beside them is one row of each task
    assert exchanges(out) == 2
    assert evaluate.entity_counts(df.limit(0)).first().n_tokens == 0


def test_no_function_is_called_for_an_id_of_the_queue(spark):
    from quittance.streaming import tracked

    rows = spark.readStream.format("rate").load().selectExpr("cast(value as string) id", "'{}' body", "0 tries")
    plan = tracked.track(rows, 1000)._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in plan and "Pandas" not in plan
    assert tracked.track(rows, 1000).columns == ["id", "body", "tries"]


def test_only_wanted_receipts_are_derived(spark):
    from quittance.plans import derived

    wanted = spark.createDataFrame([(3,), (7,), (1 << 40,)], "receipt_id long")
    every = derived.entries(spark, SF)
    got, want = derived.entries(spark, SF, wanted), every.join(wanted, "receipt_id", "left_semi")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) != []


def test_pages_are_dealt_out_before_they_are_drawn(spark):
    from quittance.plans import drawn

    assert drawn.drawn_pages(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_labels_of_chunks_in_order_of_tokens(spark):
    from quittance.operators import models

    registry = models.ModelRegistry()
    registry.register("labeler", lambda device: lambda words, boxes: [[(k, f"{w}{b[0]}", 0.5 + k / 100)] * 3 for k, (w, b) in enumerate(zip(words, boxes, strict=True))])
    rows = [(r, 0, c, s, None if s == 2 else f"w{s}", s, 1, 2, 3) for r in range(5) for c in range(2) for s in (7, 2, 5)]
    tokens = spark.createDataFrame(rows, "receipt_id long, page_no int, chunk long, seq long, text string, x1 long, y1 long, x2 long, y2 long")
    out = models.ModelScorer(registry).label(tokens)
    assert out.columns == [*tokens.columns, "labels"] and "FlatMapGroupsInPandas" not in out._jdf.queryExecution().analyzed().toString()
    got = out.collect()
    assert sorted(tuple(r)[:9] for r in got if r.text) == sorted(r for r in rows if r[4]) and len(got) == len(rows)
    for r in got:
        k = sorted((7, 2, 5)).index(r.seq)
        assert r.labels[0].label_id == k and r.labels[0].label == f"{r.text}{r.x1}" and r.labels[0].prob_milli == 500 + 10 * k
    image = np.arange(5 * 8 * 3, dtype=np.uint8).reshape(5, 8, 3)
    for k in range(-3, 5):
        near = images.rotate(image, 90 * k + 1e-9)  # the general way
        assert (images.rotate(image, 90.0 * k) == near).all()


def test_a_word_is_cut_once():
    from quittance.operators import encoding

    calls = []

    class Plain:
        def encode_batch(self, words, is_pretokenized, add_special_tokens):
            calls.extend(w for (w,) in words)
            return [type("E", (), {"ids": list(map(ord, w))}) for (w,) in words]

    known = {}
    for words in (["a", "b", "a", ""], ["b", "c", ""], ["a"]):
        encoding.learn_words(Plain(), words, known)
    assert calls == ["a", "b", "", "c"] and known == {"a": [97], "b": [98], "": [], "c": [99]}


def test_a_turn_is_worked_out_once_for_all_corners(spark):
    from quittance.functions import geometry as G

    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    df = spark.range(400).withColumns({"deg": (F.col("id") * 3 % 91).cast("double"), "c": F.array(*[at(float(x), float(y)) for x, y in ((300, 400), (310.5, 390), (290, 420), (-7, 2100))])})
    r = G.rotate(F.col("c"), F.lit(640), F.lit(2000), F.col("deg"))
    # two of the turn and two for each side of the canvas, whatever the number of corners
    assert r._jc.toString().count("cos(") == 3
    w, h = G.canvas(F.lit(640), F.lit(2000), F.col("deg"))
    df = df.withColumns({"r": r, "w": w, "h": h})
    six = F.transform("r", lambda p: F.struct(F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y")))
    box = lambda made: F.struct(*[v.alias(k) for k, v in made.items()])
    rows = df.select(box(G.crop_window(F.col("r"), F.col("w"), F.col("h"), 6)).alias("a"), box(G.crop_window(six, F.col("w"), F.col("h"))).alias("b")).collect()
    assert len(rows) == 400 and all(x.a == x.b for x in rows)


def test_plain_literals_need_no_format_and_one_pattern(spark):
    from quittance.functions.parse import pair_literal
    from quittance.sources.readers import literal_pair
    from quittance.sources.writers import one_decimal

    numbers = [0.0, -0.0, 1.0, -3.0, 2.5, 0.04, -0.04, 1e14, 1e16, 9.3e18, 1e300, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    assert all(r.a == r.b for r in df.select(one_decimal(F.col("v")).alias("a"), F.format_string("%.1f", "v").alias("b")).collect())
    # format strings are the exception, not what every number passes
    assert "ELSE format_string" in one_decimal(F.col("v"))._jc.toString()
    texts = [("a", 0), ("", 7), ("it's", 987), ("back\\slash", 1000), ("x', 0.5", 12), ("two\nlines", 999_999), ("é🙂", 1_000_000), ('"', 5), ("end'", 1)]
    lit = spark.createDataFrame(texts, "t string, m long").withColumn("l", pair_literal(F.col("t"), F.col("m")))
    word, milli = literal_pair(F.col("l"))
    assert [(r.w, r.n) for r in lit.select(word.alias("w"), milli.alias("n")).collect()] == texts
    odd = ["('a', 0.987)\n", " ( \"b\" , 1e-1 ) ", "('c', 0.9)", "('d', x)", "('e' 0.987)", "", None]
    got = spark.createDataFrame([(x,) for x in odd], "l string").select(*[c.alias(n) for c, n in zip(literal_pair(F.col("l")), "wn")]).collect()
    assert [tuple(r) for r in got] == [("a", 987), ("b", 100), ("c", 900), (None, None), (None, None), (None, None), (None, None)]


def test_only_pages_of_last_runs_are_gathered(spark):
    from quittance.operators import dataset

    rng = random.Random(11)
    pages = [(p, p % 3, f"d{p % 2}/img_{rng.randint(0, 2)}.jpg") for p in range(200)]
    rows = [(p, s, i, p * 1000 + k, f"w{k}", [k, 1, 2, 3], k % 5) for p, s, i in pages for k in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "page long, source int, image string, row_no long, word string, box array<int>, tag int")
    last = dataset.last_runs(spark.createDataFrame(pages, "page long, source int, image string"), "page")
    got = dataset.collect_runs(df.drop("source", "image").join(last, "page"))
    want = dataset.group_by_image(df)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 0 < last.count() < len(pages)


def test_receipts_with_tokens_are_told_from_keys(spark):
    from quittance.plans import derived

    ids = derived.receipt_ids(spark, SF)
    assert sorted(ids.collect()) == sorted(derived.entries(spark, SF).select("receipt_id").distinct().collect()) != []
    assert "p_name" not in ids._jdf.queryExecution().executedPlan().toString()


def test_labels_are_a_condition_before_texts_are_made(spark):
    from quittance.operators import receipt
    from quittance.plans import derived

    plan = receipt.merged_texts(derived.prepared(spark, SF))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Generate explode" in x)
    assert "Filter" in plan[at - 1]
    # amounts are rounded below, once for a line
    assert not any("round(" in x for x in plan[:at]) and sum("round(" in x for x in plan[at:]) == 1


def test_plain_forms_pass_no_general_pattern(spark):
    from quittance.functions import parse as P

    texts = ["12,50", "0.5", "1.234,5", "12,5\n", "5.", ",5", "1O,2l", "-3.5", "a 12", "12 x", "12O", "9" * 30, "17", "", None, "31/12/2024", "12.31.2024", "13-13-2024", "30/02/2024", "01/02/0050", "01.02.24", "2024-2-3", "05/06/2021\n"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    t = F.col("t")
    got = df.select("t", P.parse_price(t).alias("p"), P.parse_int(t).alias("i"), P.parse_date(t).cast("string").alias("d"), P.parse_date(t, day_first=True).cast("string").alias("f")).collect()
    # a mark before each text keeps it off the plain forms and changes no value
    marked = df.select(P.parse_price(F.concat(F.lit(" "), t)).alias("p"), P.parse_int(F.concat(F.lit(" "), t)).alias("i"), P.parse_date(F.concat(F.lit(" "), t)).cast("string").alias("d"), P.parse_date(F.concat(F.lit(" "), t), day_first=True).cast("string").alias("f")).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(r) for r in marked]
    assert [r.d for r in got if r.t in ("31/12/2024", "12.31.2024", "30/02/2024")] == ["2024-12-31", "2024-12-31", None]
    assert "d+[.,]" in P.parse_price(t)._jc.toString()


def test_the_chain_by_page_gives_what_the_chain_by_tables_gives(spark):
    from quittance.operators import models
    from quittance.plans import drawn

    # a skewed page, a page with nothing on it, a PDF page in many colours, and the drawn ones
    drawn_own = drawn.drawn_pages(spark, SF).where("receipt_id < 30")
    tilt = lambda x: images.rotate(images.pixels(drawn.PHOTO, drawn.PHOTO, 3, x), 7.0)
    one = {r.receipt_id: bytes(r.data) for r in drawn_own.where("receipt_id in (1, 2, 3)").collect()}
    blank = np.random.default_rng(1).integers(0, 150, (20, 30, 3)).astype(np.uint8)
    odd = [(100, 0, "x.jpg", *tilt(one[1]).shape, bytearray(tilt(one[1]).tobytes())), (101, 0, "x.jpg", *blank.shape, bytearray(blank.tobytes())), (102, 1, "x.PDF_1", drawn.PHOTO, drawn.PHOTO, 3, bytearray(one[2]))]
    pages = drawn_own.unionByName(spark.createDataFrame(odd, drawn_own.schema))

    def reader(image, recognise):
        return [*drawn.read(image, recognise), ([(1.5, 2), (9, 3.25), (9, 7), (1, 7)], "wide word", image.shape[0] / 2000)]

    registry = models.ModelRegistry()
    detect = lambda image: drawn.detect(image) if (image[..., 0] >= drawn.SHEET).any() else []
    for name, model in (("reader", reader), ("detector", detect), ("labeler", drawn.label)):
        registry.register(name, lambda device, model=model: model)
    scorer = models.ModelScorer(registry)
    by_page = preocr.labelled_entries(pages, scorer)
    by_tables = preocr.labelled_entries(pages, scorer, dump=lambda name, df: None)
    plan = by_page._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "checkpoint" not in plan.lower() and "MapInPandas" in plan
    columns = sorted(by_tables.columns)
    got, want = (sorted(map(str, x.select(columns).collect())) for x in (by_page, by_tables))
    assert got == want and len(want) > 120 and by_page.schema[columns[0]] == by_tables.schema[columns[0]]


def test_drawn_pages_come_in_small_batches(spark):
    import pandas as pd

    from quittance.plans import drawn

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [sum(map(len, b["data"]))]})

    drawn.drawn_scorer().detect(drawn.drawn_pages(spark, SF))  # sets the limit
    assert max(r.n for r in drawn.drawn_pages(spark, SF).coalesce(1).mapInPandas(sizes, "n long").collect()) <= 3 << 20


def test_entries_are_gathered_as_they_lie(spark, monkeypatch):
    from quittance.operators import receipt
    from quittance.plans import derived

    made = receipt.entry_documents(derived.entries(spark, SF))
    plan = made._jdf.queryExecution().executedPlan().toString()
    # what is hashed is sorted again, with all its columns, when a task has more than 128 receipts
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan and "Exchange hashpartitioning(receipt_id" not in plan
    want = sorted(map(tuple, made.collect()))
    monkeypatch.setattr(derived, "PART_BYTES", 1 << 10)
    many = derived.entries(spark, SF)
    n = int(derived.table(spark, SF, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >> 10
    assert n > 8 and many.rdd.getNumPartitions() == n
    assert sorted(map(tuple, receipt.entry_documents(many).collect())) == want


def test_lines_are_not_moved_to_their_receipts(spark):
    from quittance.operators import receipt
    from quittance.plans import derived, receipts

    for made in (receipt.receipt_documents, receipts.receipt_rows):
        plan = made(derived.prepared(spark, SF))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(l_orderkey" in plan and "Exchange hashpartitioning(receipt_id" not in plan
        # what is hashed spills; of a sort by receipt alone nothing is left
        assert "ObjectHashAggregate" not in plan and not any("Sort [receipt_id" in x and "page_no" not in x for x in plan.splitlines())


def test_best_groups_of_whole_receipts(spark):
    from quittance.operators import lines

    e = "struct<pos:long,labels:array<struct<label_id:int,prob_milli:int>>>"
    rows = [(1, [([(0, [(31, 600), (71, 500)]), (1, [(71, 400)])],), ([(0, [(0, 900)])],), ([(0, [])],)]), (2, []), (3, [([(0, [(12, 300)])],)])]
    df = spark.createDataFrame(rows, f"r long, lines array<struct<members:array<{e}>>>")
    got = {x.r: x.g for x in df.select("r", lines.best_groups(F.col("lines")).alias("g")).collect()}
    assert got == {1: ["total", "O", "O"], 2: [], 3: ["tax_table"]}


def test_tables_need_no_typed_values_and_no_names(spark):
    from quittance.operators import lines, receipt
    from quittance.plans import derived, receipts

    plan = receipts.q_item_table(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan and "RLIKE" not in plan and "metadata" not in plan and "ObjectHashAggregate" not in plan
    whole = receipt.table_lines(derived.prepared(spark, SF), "item_table", receipt.ITEM_FIELDS)
    bare = receipt.table_lines(derived.segmented(spark, SF), "item_table", receipt.ITEM_FIELDS, metadata=False)
    key = lambda r: (r.receipt_id, r.page_no, r.line_no)
    full, few = ({key(r): r for r in x.collect()} for x in (whole, bare))
    assert full.keys() == few.keys() and len(few) > 3000
    assert all(len(full[k].metadata) == r.n_entries and (r.price and r.price.text) == (full[k].price and full[k].price.text) for k, r in few.items())
    # a member's candidate of a group is that of each of its fields, or none
    own, _ = receipt._with_own(derived.entries(spark, SF), receipt.ITEM_FIELDS)
    for f in receipt.ITEM_FIELDS[:4]:
        target = receipt.LABEL_ID[f.labels[0]]
        mine = F.when(F.col("_own_item_table.label_id") == target, F.col("_own_item_table.prob_milli"))
        assert own.where(~mine.eqNullSafe(lines.search_in_line(F.col("labels"), target)["prob_milli"].cast(own.schema["_own_item_table"].dataType["prob_milli"].dataType))).count() == 0


def test_windows_of_a_batch_are_filled_together(spark):
    import pyarrow as pa

    from quittance.operators import encoding
    from quittance.plans import services

    known = {"": [], "a": [7], "bc": [8, 9], "def": [1, 2, 3]}
    rows = [(["a", "bc", "def"], [[1, 1, 1, 1], [2, 2, 2, 2], [3, 3, 3, 3]], [5, 6, 7]), (None, None, None), (["", None, "a"], [[4, 4, 4, 4]] * 3, [1, 2, 3])]
    kinds = {"words": pa.list_(pa.string()), "bboxes": pa.list_(pa.list_(pa.int64())), "ner_tags": pa.list_(pa.int32())}
    batch = pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})
    example, made = encoding.windows(batch, known, encoding.Rules(100, 101, 102, 6), 1, True)
    got = {k: v.to_pylist() for k, v in made.items()}
    assert example.tolist() == [0, 0, 1, 2] and got["window"] == [0, 1, 0, 0] and got["n_windows"] == [2, 2, 1, 1]
    assert got["input_ids"] == [[100, 7, 8, 9, 1, 101], [100, 1, 2, 3, 101, 102], [100, 101, 102, 102, 102, 102], [100, 7, 101, 102, 102, 102]]
    assert got["words"] == [[-1, 0, 1, 1, 2, -1], [-1, 2, 2, 2, -1, -1], [-1] * 6, [-1, 2, -1, -1, -1, -1]]
    assert got["labels"] == [[-100, 5, 6, -100, 7, -100], [-100, 7, -100, -100, -100, -100], [-100] * 6, [-100, 3, -100, -100, -100, -100]]
    assert [sum(x) for x in got["attention_mask"]] == [6, 5, 2, 3] and got["bbox"][3] == [[0] * 4, [4] * 4, [0] * 4, [0] * 4, [0] * 4, [0] * 4]
    # a part of a batch is its own
    assert encoding.windows(batch.slice(2), known, encoding.Rules(100, 101, 102, 6), 1, True)[1]["words"].to_pylist() == got["words"][3:]
    plan = services.q_encode_words(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ObjectHashAggregate" not in plan


def test_tokens_of_images_are_derived_once(spark):
    from quittance.plans import receipts

    plan = receipts.q_image_receipts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "SortMergeJoin" not in plan
    kind = "receipt_id long, page_no int, chunk long, seq long, text string, labels array<struct<label_id:int,label:string,prob_milli:int>>"
    tokens = spark.createDataFrame([(1, 0, 0, 0, "a", [(5, "x", 900)])], kind)
    assert scorers.FixtureScorer(tokens=tokens).label(tokens).collect() == tokens.collect()
    assert scorers.FixtureScorer(labels=tokens).label(tokens.drop("labels")).collect()[0].labels == tokens.first().labels


def test_boxes_around_quads(spark):
    from quittance.functions.geometry import bounds

    q = "array<struct<x:double,y:double>>"
    rows = [([(3.0, 4.0), (1.0, 9.0), (2.0, -1.0), (7.0, 0.5)],), ([(None, 1.0), (2.0, None), (float("nan"), 3.0), (1.0, 2.0)],), ([(1.0, 2.0)],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"q {q}")
    plain = lambda f, c: getattr(F, f)(F.transform("q", lambda p: p[c]))
    for got, want in zip(bounds(F.col("q")), (plain("array_min", "x"), plain("array_min", "y"), plain("array_max", "x"), plain("array_max", "y")), strict=True):
        assert df.where(~got.eqNullSafe(want)).count() == 0
