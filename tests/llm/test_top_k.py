import math
import random

import numpy as np
import pytest
from oracle import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from quittance.llm import top_k


def plain(rows, k, asked=lambda i: True, scale=256):
    """Sorted (query_id, rank, vec_id, score), by scoring every pair in whole numbers."""
    use = {(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    use = {(i, v) for i, v in use if max((x * x for x in v), default=0) * max(1, len(v)) <= 2**62}
    out = []
    for i, v in use:
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in use if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in top_k.top_k(df, k=k, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert rows_of(top_k.query(spark, d)) == rows_of_sql(connect(d), top_k.ORACLE_SQL)


@pytest.mark.parametrize(("size", "scale", "dims"), [(300, 1.0, 64), (300, 1e5, 20), (200, 2.0**20, 9), (60, 1.0, 1)])
def test_blocks_and_parts_against_all_pairs(spark, size, scale, dims):
    """Every width of arithmetic, several blocks and parts, copies and ties."""
    rng = np.random.default_rng(size)
    x = rng.standard_normal((size, dims)) * scale / 4
    x[:20] = x[0]
    x[20:40] = -x[0]
    rows = [(int(i), [float(y) for y in v]) for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    got = run(spark, rows, queries=F.pmod("id", F.lit(3)) == 0, most_block=40, query_part=30)
    assert got == plain(rows, 5, lambda i: i % 3 == 0)


def test_pruning_leaves_few_and_loses_none():
    """Where a few candidates stand out, nearly all others go after the first steps."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.standard_normal((4000, 64)) * 20 * 0.9 ** np.arange(64)).astype(np.int64)
    block = top_k.Block(np.arange(4000), x)
    for q in range(0, 4000, 400):
        ids, scores = block.best(q, x[q], 5)
        all_scores = (x @ x[q]).tolist()
        want = sorted((j for j in range(4000) if j != q), key=lambda j: (-all_scores[j], j))[:5]
        assert ids.tolist() == want
        assert scores.tolist() == [all_scores[j] for j in want]
    assert len(block.steps) == 8
    assert block.scored < 0.5 * 10 * 8 * 4000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [-1.0, 0.25]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]),
        (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 0.0]), (8, [1.0]), (9, [0.1]), (10, []), (11, []), (12, [1e300, 1.0]), (13, [1e7, -1e7]), (-50, [0.0, -0.001]),
    ]
    assert run(spark, rows) == plain(rows, 5)
    assert run(spark, rows, k=2) == plain(rows, 2)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_hot_vector_and_extra_columns(spark):
    rows = [(i, [0.25, 0.5, -1.0], i % 3, i, "x") for i in range(600)] + [(600 + i, [i / 50, 0.1, 0.2], None, 0, "y") for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score long, id string")
    got = sorted(tuple(r) for r in top_k.top_k(df, F.pmod("id", F.lit(50)) == 0, most_block=100).collect())
    assert got == plain([(r[0], [float(np.float32(x)) for x in r[1]]) for r in rows], 5, lambda i: i % 50 == 0)
