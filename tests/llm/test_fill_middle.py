import hashlib
import random
import re

import numpy as np
import pytest
from oracle import connect, rows_of, rows_of_sql

from quittance.llm import fill_middle

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, percent=100, spm=50, seed=7, marks=("<P>", "<S>", "<M>")):
    """(n, form, prefix_chars, middle_chars, output), by lists of units."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if not text or any(x in text for x in marks) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return len(units), "psm", len(pre), len(mid), p + pre + s + suf + m + mid


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 8, 511, 512, 513, 4096, 5000):
        for share in (0.0, 0.01, 0.5, 1.0):
            flags = rng.random(size) < share
            bits = fill_middle.BitVector(flags)
            before = np.concatenate([[0], np.cumsum(flags)])
            assert len(bits) == before[-1]
            assert (bits.rank(np.arange(size + 1)) == before).all()
            assert (bits.select(np.arange(1, len(bits) + 1)) == np.flatnonzero(flags)).all()


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    assert rows_of(fill_middle.query(spark, d)) == rows_of_sql(connect(d), fill_middle.ORACLE_SQL)


@pytest.mark.parametrize(("percent", "spm"), [(100, 50), (30, 0), (60, 100), (0, 50)])
def test_against_units(spark, percent, spm):
    rng = random.Random(percent)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "é\nü", "a\r\nb c\n", "x<P>y\n", "<S>", "a\n<M>", "<\nP>\n", "<P\n>", "日本\n語", "𝄞\n𝄞x"]
    texts += ["".join(rng.choice("ab<PSM>\n\né日𝄞 ") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    texts += ["line of text é\n" * 40_000, "no newline " * 30_000]
    rows = [(i if i != 4 else None, t, f"s{i}", i, "old") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long, output string")
    made = fill_middle.fill_in_middle(docs, percent=percent, spm_percent=spm)
    assert made.columns == ["doc_id", "text", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = {r.source: r for r in made.withColumn("back", fill_middle.restore("output", "form")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[f"s{i}"]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(i if i != 4 else None, t, percent, spm)
        assert (r.text, r.back) == (t, t or "")


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "d")], "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs).collect()
    assert sorted(r.output for r in out) == sorted(plain(1, t)[-1] for t in ("a\nb\nc", "a\nb\nc", "d"))
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, text_col="body")


def test_markers(spark):
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    docs = spark.createDataFrame([(i, "ab\n|>\n<|\nfim" * i) for i in range(30)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs, markers=marks).withColumn("back", fill_middle.restore("output", "form", marks))
    for r in out.collect():
        assert r.output == plain(r.doc_id, r.text, marks=marks)[-1]
        assert r.back == r.text
    for bad in (("<a>", "<a>", "b"), ("aa", "b", "c"), ("abc", "b", "x"), ("ab", "bc", "x"), ("", "b", "c"), ("é", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, markers=bad)
