from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quittance.operators import labeler
from quittance.plans import services

SF = "/root/testdata/sf0.001"


def random_chain(rng, n=3, buckets=11):
    return labeler.Chain(tuple(range(10, 10 + n)), rng.standard_normal((buckets, n)), rng.standard_normal((n, n)), rng.standard_normal(n), rng.standard_normal(n))


def all_paths(emit, c):
    size, n = emit.shape
    for path in product(range(n), repeat=size):
        yield path, c.begin[path[0]] + c.end[path[-1]] + sum(emit[t, p] for t, p in enumerate(path)) + sum(c.pairs[a, b] for a, b in zip(path, path[1:]))


def test_sums_and_best_path_against_all_paths():
    rng = np.random.default_rng(1)
    c = random_chain(rng)
    emits = [rng.standard_normal((size, 3)) * 3 for size in (1, 2, 5, 4)]
    padded, real = labeler._pad(emits)
    log_sum, unary, pairs = labeler.forward_backward(padded, real, c)
    want_pairs = np.zeros((3, 3))
    for i, emit in enumerate(emits):
        paths = list(all_paths(emit, c))
        z = np.logaddexp.reduce([s for _, s in paths])
        assert log_sum[i] == pytest.approx(z)
        marginal = np.zeros_like(emit)
        for path, s in paths:
            p = np.exp(s - z)
            for t, y in enumerate(path):
                marginal[t, y] += p
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += p
        assert unary[i, : len(emit)] == pytest.approx(marginal)
        assert tuple(labeler.viterbi(emit, c)) == max(paths, key=lambda x: x[1])[0]
    assert pairs == pytest.approx(want_pairs)


def test_long_pages_do_not_overflow():
    rng = np.random.default_rng(2)
    emit = rng.standard_normal((1, 3000, 3)) * 50
    log_sum, unary, _ = labeler.forward_backward(emit, np.ones((1, 3000), bool), random_chain(rng))
    assert np.isfinite(log_sum).all() and unary.sum(2) == pytest.approx(1)


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    c = random_chain(rng)
    features = [rng.integers(0, 11, (size, 4)) for size in (3, 1, 6)] + [np.zeros((0,), np.int64)]
    tags = [rng.integers(0, 3, len(f)) for f in features]
    x = c.flat()
    loss, grad = labeler.loss_and_gradient(c, features, tags)
    for i in range(0, len(x), 3):
        step = np.zeros_like(x)
        step[i] = 1e-5
        up, down = (labeler.loss_and_gradient(c.moved(x + s), features, tags)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-5, abs=1e-4)
    assert loss > 0


def test_minimiser_finds_the_bottom():
    a = np.diag([1.0, 10.0, 100.0])
    seen = []
    x = labeler.minimise(np.array([5.0, -3.0, 2.0]), lambda v: (v @ a @ v / 2, a @ v), 40, lambda k, v: seen.append(k))
    assert np.abs(x).max() < 1e-4 and seen[0] == 1


def test_gradient_over_tasks_is_that_of_one(spark):
    rng = np.random.default_rng(4)
    c = random_chain(rng)
    rows = [(i, 0, list(range(n)), rng.integers(0, 11, (n, 4)).tolist(), rng.integers(10, 13, n).tolist()) for i, n in enumerate([1, 4, 7, 2, 30, 3, 5])]
    df = spark.createDataFrame(rows, "receipt_id long, page_no int, seqs array<long>, features array<array<int>>, tags array<int>").repartition(5)
    loss, grad, tokens = labeler.corpus_gradient(df, c)
    one, all_of_it = labeler.loss_and_gradient(c, [np.array(r[3]) for r in rows], [np.array(r[4]) - 10 for r in rows])
    assert loss == pytest.approx(one) and grad == pytest.approx(all_of_it) and tokens == 52
    assert labeler.corpus_gradient(df.limit(0), c)[2] == 0


def test_the_best_two_checkpoints_stay(spark, tmp_path):
    rng = np.random.default_rng(5)
    kept = labeler.Checkpoints(spark, f"{tmp_path}/run")
    chains = [random_chain(rng) for _ in range(4)]
    for step, (score, c) in enumerate(zip((0.5, 0.9, 0.7, 0.9), chains, strict=True)):
        kept.save(step, score, c)
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["step=1", "step=3"]
    best = kept.best()
    assert best.tags == chains[1].tags and (best.flat() == chains[1].flat()).all()


def test_pages_without_tags_and_odd_texts(spark):
    rows = [("r", 0, 0, "Total", 10, 5), ("r", 0, 1, None, 400, 7), ("s", 1, 0, "", -20, 7)]
    entries = spark.createDataFrame(rows, "receipt_id string, page_no int, seq long, text string, x1 long, tag int")
    pages = labeler.page_sequences(entries, F.col("tag"), buckets=50)
    kept = labeler.Checkpoints(spark, "/nowhere")
    with pytest.raises(ValueError):
        labeler.train(pages.limit(0), kept, lambda c: 0.0)
    chain = labeler.Chain.zeros((5, 7), 50)
    got = {(r.receipt_id, r.seq): r for r in labeler.label_pages(labeler.page_sequences(entries, buckets=50), chain).collect()}
    assert set(got) == {("r", 0), ("r", 1), ("s", 0)}
    assert [x.prob_milli for x in got["r", 0].labels] == [500, 500] and got["r", 0].labels[0].label == "I-datetime"


def test_learned_labels_beat_the_majority_on_held_out_pages(spark):
    got = {r.labeler: r for r in services.q_train_labeler(spark, SF).collect()}
    assert got["chain"].n_tokens == got["majority"].n_tokens > 1000
    assert got["chain"].f1 > 0.8 and got["chain"].f1 > got["majority"].f1 + 0.3
    assert got["chain"].accuracy > 0.75


def test_best_paths_of_pages_together():
    rng = np.random.default_rng(6)
    c = random_chain(rng)
    emits = [rng.standard_normal((size, 3)) * 3 for size in (1, 2, 9, 4, 9, 1)]
    for got, emit in zip(labeler.best_paths(emits, c), emits, strict=True):
        assert got.tolist() == labeler.viterbi(emit, c).tolist()


def test_paths_lie_beside_the_tags_of_their_pages(spark):
    rng = np.random.default_rng(7)
    c = random_chain(rng)
    rows = [(i, 0, list(range(n)), rng.integers(0, 11, (n, 4)).tolist(), rng.integers(10, 13, n).tolist()) for i, n in enumerate([1, 4, 30, 0, 3])]
    df = spark.createDataFrame(rows, "receipt_id long, page_no int, seqs array<long>, features array<array<int>>, tags array<int>").repartition(2)
    got = {r.receipt_id: r for r in labeler.path_tags(df, c).collect()}
    want = {}
    for r in labeler.label_pages(df.where("size(seqs) > 0"), c).collect():
        want.setdefault(r.receipt_id, {})[r.seq] = r.tag
    for i, _, seqs, _, tags in rows:
        assert (got[i].seqs, got[i].tags) == (seqs, tags) and got[i].path == [want.get(i, {})[s] for s in seqs]


def test_the_labeler_learns_from_all_pages_that_are_not_held_out(spark, monkeypatch):
    seen = {"train": [], "score": []}
    train, path_tags = services.train, services.path_tags

    def watched(pages, checkpoints, score, **kw):
        seen["train"].append(sorted((r.receipt_id, r.page_no) for r in pages.select("receipt_id", "page_no").collect()))
        return train(pages, checkpoints, score, **(kw | {"steps": 1}))

    def labelled(pages, chain):
        seen["score"].append(sorted((r.receipt_id, r.page_no) for r in pages.select("receipt_id", "page_no").collect()))
        return path_tags(pages, chain)

    monkeypatch.setattr(services, "train", watched)
    monkeypatch.setattr(services, "path_tags", labelled)
    rows = {r.labeler: r for r in services.q_train_labeler(spark, SF).collect()}
    every = services.D.entries(spark, SF).select("receipt_id", "page_no").distinct()
    folds = [[], [], []]
    for r in every.select("*", F.expr("pmod(xxhash64(receipt_id, page_no), 5)").alias("h")).collect():
        folds[min(r.h, 2)].append((r.receipt_id, r.page_no))
    held, some, own = map(sorted, folds)
    assert seen["train"] == [own] and len(own) > 1700
    assert seen["score"] == [some, held]
    assert rows["majority"].n_tokens == rows["chain"].n_tokens


def test_sums_by_bucket_and_label():
    rng = np.random.default_rng(8)
    f, delta, weights = rng.integers(0, 7, (40, 3)), rng.standard_normal((40, 4)), rng.standard_normal((7, 4))
    want = np.zeros((7, 4))
    np.add.at(want, f.ravel(), np.repeat(delta, 3, axis=0))
    assert labeler.bucket_sums(f, delta, 7) == pytest.approx(want)
    chain = labeler.Chain((0, 1, 2, 3), weights, np.zeros((4, 4)), np.zeros(4), np.zeros(4))
    assert labeler.emissions(chain, f.reshape(5, 8, 3)) == pytest.approx(weights[f.reshape(5, 8, 3)].sum(2))
