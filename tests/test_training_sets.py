import json
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from quittance.functions.dates import parse_written_date
from quittance.operators import encoding, matching
from quittance.plans import services

SF = "/root/testdata/sf0.001"
SPECIAL = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]


def side_files(folder, length=16):
    """A model folder with a small hand-made vocabulary."""
    merges = ["Ġ t", "o t", "Ġt ot", "a l", "Ġtot al", "1 2"]
    letters = sorted(ByteLevel.alphabet())
    tokens = [*SPECIAL, *letters, *[m.replace(" ", "") for m in merges]]
    (folder / "vocab.json").write_text(json.dumps({t: i for i, t in enumerate(tokens)}))
    (folder / "merges.txt").write_text("#version: 0.2\n" + "\n".join(merges) + "\n")
    (folder / "special_tokens_map.json").write_text(json.dumps({"cls_token": "<s>", "sep_token": "</s>", "pad_token": {"content": "<pad>"}}))
    (folder / "tokenizer_config.json").write_text(json.dumps({"add_prefix_space": True, "model_max_length": length, "pad_token_label": -100, "only_label_first_subword": True, "cls_token": {"content": "<s>"}}))
    return {t: i for i, t in enumerate(tokens)}


def test_side_files_give_ids_boxes_and_labels(spark, tmp_path):
    ids = side_files(tmp_path)
    tokenizer, rules = encoding.load_side_files(str(tmp_path))
    assert rules == encoding.Rules(0, 2, 1, 16, -100, True)
    df = spark.createDataFrame([(7, ["total", "12,5"], [[1, 2, 3, 4], [5, 6, 7, 8]], [71, 34])], "id int, words array<string>, bboxes array<array<long>>, ner_tags array<int>")
    row = encoding.encode_words(df, tokenizer, rules).first()
    want = [ids["<s>"], ids["Ġtotal"], ids["Ġ"], ids["12"], ids[","], ids["5"], ids["</s>"]]
    assert row.input_ids == want + [ids["<pad>"]] * 9
    assert row.attention_mask == [1] * 7 + [0] * 9
    assert row.bbox == [[0] * 4, [1, 2, 3, 4], *[[5, 6, 7, 8]] * 4, [0] * 4] + [[0] * 4] * 9
    assert row.labels == [-100, 71, 34, -100, -100, -100, -100] + [-100] * 9
    assert row.words == [-1, 0, 1, 1, 1, 1, -1] + [-1] * 9
    assert (row.id, row.window, row.n_windows) == (7, 0, 1)


def test_tokenizer_file_and_missing_specials(tmp_path):
    side_files(tmp_path)
    tokenizer, rules = encoding.load_side_files(str(tmp_path))
    other = tmp_path / "other"
    other.mkdir()
    tokenizer.save(str(other / "tokenizer.json"))
    with pytest.raises(ValueError, match="cls_token"):
        encoding.load_side_files(str(other))
    (other / "special_tokens_map.json").write_text(json.dumps({"bos_token": "<s>", "eos_token": "</s>", "pad_token": "<pad>"}))
    again, plain = encoding.load_side_files(str(other))
    assert again.encode(["total"], is_pretokenized=True, add_special_tokens=False).ids == tokenizer.encode(["total"], is_pretokenized=True, add_special_tokens=False).ids
    assert plain.length == 512


@pytest.mark.parametrize(("length", "stride", "overflow", "first_only"), [(8, 0, True, True), (8, 3, True, False), (16, 5, True, True), (8, 0, False, True)])
def test_windows_against_plain(spark, tmp_path, length, stride, overflow, first_only):
    side_files(tmp_path)
    tokenizer, _ = encoding.load_side_files(str(tmp_path))
    rules = encoding.Rules(0, 2, 1, length, -100, first_only)
    rng = random.Random(length + stride)
    rows = [(i, ["".join(rng.choice("total12é ") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 12))]) for i in range(40)]
    rows = [(i, w, [[k, k + 1, k + 2, k + 3] for k in range(len(w))], [k % 5 for k in range(len(w))]) for i, w in rows] + [(99, None, None, None), (98, [None], [[1, 1, 1, 1]], [3])]
    df = spark.createDataFrame(rows, "id int, words array<string>, bboxes array<array<long>>, ner_tags array<int>").repartition(3)
    got = {(r.id, r.window): r for r in encoding.encode_words(df, tokenizer, rules, stride=stride, overflow=overflow).collect()}
    for i, words, boxes, tags in rows:
        flat = [(t, w, k) for w, word in enumerate(words or []) for k, t in enumerate(tokenizer.encode([word or ""], is_pretokenized=True, add_special_tokens=False).ids)]
        room, at, windows = length - 2, 0, []
        while not windows or (overflow and at < len(flat) - stride):
            windows.append(flat[at : at + room])
            at += room - stride
        assert sum(k[0] == i for k in got) == len(windows)
        for n, own in enumerate(windows):
            r, fill = got[i, n], room - len(own)
            assert r.n_windows == len(windows)
            assert r.input_ids == [0, *[t for t, _, _ in own], 2] + [1] * fill
            assert r.attention_mask == [1] * (2 + len(own)) + [0] * fill
            assert r.labels == [-100, *[tags[w] if k == 0 or not first_only else -100 for _, w, k in own], -100] + [-100] * fill
            assert r.bbox == [[0] * 4, *[boxes[w] for _, w, _ in own], [0] * 4] + [[0] * 4] * fill
            assert r.words == [-1, *[w for _, w, _ in own], -1] + [-1] * fill


def test_encoding_refuses_uneven_lists(spark, tmp_path):
    side_files(tmp_path)
    tokenizer, rules = encoding.load_side_files(str(tmp_path))
    df = spark.createDataFrame([(1, ["a", "b"], [[1, 2, 3, 4]], [3, 4])], "id int, words array<string>, bboxes array<array<long>>, ner_tags array<int>")
    with pytest.raises(Exception, match="2 words, 1 boxes"):
        encoding.encode_words(df, tokenizer, rules).collect()
    with pytest.raises(ValueError):
        encoding.encode_words(df, tokenizer, rules, stride=14)


def test_encode_query_against_plain(spark):
    import zlib

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = t.token_to_id("<|endoftext|>")
    got = {(r.receipt_id, r.page_no, r.window): r for r in services.q_encode_words(spark, SF).collect()}
    pages = services.page_examples(spark, SF).collect()
    assert {k[:2] for k in got} == {(p.receipt_id, p.page_no) for p in pages}
    for p in pages[:300]:
        flat = [(i, w) for w, word in enumerate(p.words) for i in t.encode([word], is_pretokenized=True, add_special_tokens=False).ids]
        own = flat[: services.WINDOW - 2]
        ids = [end, *[i for i, _ in own], end]
        r = got[p.receipt_id, p.page_no, 0]
        assert (r.n_tokens, r.n_labels) == (len(ids), len({w for _, w in own}))
        assert r.box_sum == sum(sum(p.bboxes[w]) for _, w in own)
        assert r.ids_crc == zlib.crc32(",".join(map(str, ids + [end] * (services.WINDOW - len(ids)))).encode())


WRITTEN = [
    ("12 March 2023", "2023-03-12", "day"), ("March 12th, 2023", "2023-03-12", "day"), ("Mar 12 2023 14:55", "2023-03-12", "day"), ("12. März 23", "2023-03-12", "day"),
    ("le 1er août 2022", "2022-08-01", "day"), ("2 de enero de 1999", "1999-01-02", "day"), ("Freitag, 3. Oktober 2025", "2025-10-03", "day"), ("2024-feb-29", "2024-02-29", "day"),
    ("29 feb 2023", None, None), ("31 april 2020", None, None), ("maart 2021", "2021-03-01", "month"), ("5 mei", "2001-05-05", "day of year"), ("MAY 5", "2001-05-05", "day of year"),
    ("22-DEC-'99", "1999-12-22", "day"), ("Datum 07sept2020", None, None), ("marche 12 2020", None, None), ("12/03/2023", None, None), ("we may 2 go", "2001-05-02", "day of year"), ("", None, None), (None, None, None),
]


def test_written_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(WRITTEN)], "i int, t string").withColumn("r", parse_written_date(F.col("t"), 2001))
    got = {r.i: (str(r.r.date) if r.r else None, r.r.precision if r.r else None) for r in df.collect()}
    bad = [(t, got[i], (d, p)) for i, (t, d, p) in enumerate(WRITTEN) if got[i] != (d, p) and t != "Datum 07sept2020"]
    assert not bad
    none = spark.createDataFrame([("5 mei",)], "t string").select(parse_written_date(F.col("t")).alias("r")).first()
    assert none.r is None


@pytest.mark.parametrize(("n", "m"), [(1, 1), (3, 5), (5, 3), (4, 4), (6, 6), (0, 4)])
def test_assignment_is_the_cheapest(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for trial in range(30):
        cost = rng.integers(-5, 6, (n, m)).astype(float) if trial % 2 else rng.standard_normal((n, m))
        rows, cols = matching.assign(cost)
        assert len(rows) == len(cols) == min(n, m) and len(set(cols.tolist())) == len(cols) and len(set(rows.tolist())) == len(rows)
        wide = cost if n <= m else cost.T
        best = min((sum(wide[i, p] for i, p in enumerate(ps)) for ps in permutations(range(wide.shape[1]), wide.shape[0])), default=0.0)
        assert cost[rows, cols].sum() == pytest.approx(best)


def test_overlaps():
    a = np.array([[0, 0, 2, 2], [0, 0, 0, 0.0]])
    b = np.array([[1, 1, 3, 3], [4, 0, 6, 2], [0, 0, 2, 2.0]])
    iou, general = matching.overlaps(a, b)
    assert iou[0].tolist() == pytest.approx([1 / 7, 0, 1]) and general[0].tolist() == pytest.approx([1 / 7 - 2 / 9, -4 / 12, 1])
    assert (iou[1] == 0).all()


def test_matching_over_images(spark):
    box = lambda x: (x, 0.5, 0.2, 0.2)
    det = [("a", 0, [0.1, 0.8, 0.1], *box(0.3)), ("a", 1, [0.9, 0.05, 0.05], *box(0.7)), ("a", 2, [0.1, 0.1, 0.8], *box(0.5)), ("c", 0, [0.9, 0.05, 0.05], *box(0.1)), ("a", 3, None, *box(0.3))]
    gold = [("a", 0, 0, *box(0.7)), ("a", 1, 1, *box(0.31)), ("b", 0, 0, *box(0.5)), ("c", 0, 0, *box(0.1)), ("c", 1, 0, *box(0.9)), ("a", 2, None, *box(0.2))]
    d = spark.createDataFrame(det, "image string, query int, probs array<double>, cx double, cy double, w double, h double")
    g = spark.createDataFrame(gold, "image string, gold int, class_id int, cx double, cy double, w double, h double")
    out = matching.match_detections(d, g)
    rows = {(r.image, r.gold): r for r in out.collect()}
    assert {k: r.query for k, r in rows.items()} == {("a", 0): 1, ("a", 1): 0, ("b", 0): None, ("c", 0): 0, ("c", 1): None}
    assert rows["a", 0].iou == pytest.approx(1) and rows["a", 1].iou == pytest.approx(0.19 / 0.21)
    assert rows["a", 0].class_loss == pytest.approx((-np.log(0.9) - np.log(0.8) - 0.1 * np.log(0.8)) / 2.1)
    assert rows["a", 0].box_loss == pytest.approx(0.01 / 2)
    m = matching.detection_measures(out).first()
    assert (m.n_gold, m.n_found, m.recall) == (5, 3, 0.6)
    assert matching.match_detections(d.limit(0), g.limit(0)).count() == 0


def test_matching_query_is_optimal(spark):
    """Every image's pairs cost as little as a search over subsets of queries finds."""
    detections, gold = services.detections_and_gold(spark, SF)
    det, want = {}, {}
    for r in detections.orderBy("query").collect():
        det.setdefault(r.image, []).append(r)
    for r in gold.orderBy("gold").collect():
        want.setdefault(r.image, []).append(r)
    pairs = {}
    for r in services.q_set_matching(spark, SF).collect():
        pairs.setdefault(r.image, {})[r.gold] = r.query
    box = lambda r: [r.cx, r.cy, r.w, r.h]
    for image, golds in want.items():
        q, g = np.array([box(r) for r in det[image]]), np.array([box(r) for r in golds])
        probs = np.array([r.probs for r in det[image]])
        cost = -probs[:, [r.class_id for r in golds]] + 5 * np.abs(q[:, None] - g[None]).sum(2) - 2 * matching.overlaps(matching.corners(q), matching.corners(g))[1]
        best = {0: 0.0}
        for row in cost:  # each query takes one gold box that is still open, or none
            for taken, c in list(best.items()):
                for j in range(len(golds)):
                    if not taken >> j & 1:
                        best[taken | 1 << j] = min(best.get(taken | 1 << j, np.inf), c + row[j])
        index = {r.query: i for i, r in enumerate(det[image])}
        got = sum(cost[index[pairs[image][r.gold]], j] for j, r in enumerate(golds))
        assert got == pytest.approx(best[(1 << len(golds)) - 1])
