"""Groups of a line: the fold over arrays against one vote after the other; the plan that makes tokens moves none."""

import random

import pyarrow as pa
import pytest

from quittance.functions.labels import GROUP_NAMES, GROUP_ORD, LABELS
from quittance.operators.lines import rank_groups
from quittance.plans import derived as D


def plainly(ids, probs, top):
    score = dict.fromkeys(GROUP_NAMES, 0)
    for i, p in zip(ids or [], probs or [], strict=True):
        if i and p is not None and 0 < i < len(LABELS):
            g = LABELS[i][2]
            score[g] += ((1000 - score[g]) * p + 500) // 1000
    return [{"grp": g, "score_milli": score[g]} for g in sorted(score, key=lambda g: (-score[g], GROUP_ORD[g]))[:top]]


@pytest.mark.parametrize("top", [1, 3])
def test_groups_equal_a_plain_fold(top):
    r = random.Random(3)
    lines = [[(r.choice([0, 31, 32, 12, 71, 85, 120, -1, None]), r.choice([0, 1, 333, 999, 1000, None])) for _ in range(n)] for n in [0, 1, 2, 3, 12, 400] * 20]
    ids, probs = [[i for i, _ in x] for x in lines] + [None], [[p for _, p in x] for x in lines] + [None]
    got = rank_groups(top)(pa.array(ids, pa.list_(pa.int32())), pa.array(probs, pa.list_(pa.int64()))).to_pylist()
    assert got == [plainly(i, p, top) for i, p in zip(ids, probs, strict=True)]
    assert rank_groups(top)(pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.int64()))).to_pylist() == []


def test_tokens_are_not_moved(spark):
    d = "/root/testdata/sf0.001"
    plan = D.prepared(spark, d).groupBy("receipt_id", "page_no", "line_no").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "Exchange hashpartitioning(receipt_id" not in plan


def test_documents_read_entries_once(spark):
    from quittance.operators.receipt import receipt_documents
    from quittance.plans.receipts import receipt_rows

    d = "/root/testdata/sf0.001"
    for made in (receipt_documents, receipt_rows):
        plan = made(D.prepared(spark, d))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "Scan ExistingRDD" not in plan
