from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quittance.functions import folds, labels
from quittance.functions.parse import is_json, pair_literal, parse_date, parse_int, parse_price, parse_price_strict, stem


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_label_dimension():
    assert len(labels.LABELS) == 90 and len(labels.GROUPS) == 13
    assert sum(x[4] is not None for x in labels.LABELS) == 62
    assert [sum(x[4] == f for x in labels.LABELS) for f in ("PRICE", "TEXT", "MIXED", "NUMBER")] == [21, 17, 17, 3]
    assert labels.LABEL_ID["I-total.price"] == 71 and labels.groups([0, 34, 99]) == ["O", "item_table", None]


def test_price(spark):
    got = column(spark, ["2,99", "1.234,56", "EUR 12", "-3", "-3,50", "l2,5O", "3.-", "abc.de", "", "3.d", "12 .50", None, "x"], parse_price)
    assert got == [2.99, 234.56, 12.0, 3.0, -3.5, 12.5, 0.0, 0.0, None, 0.0, 0.0, None, None]


def test_price_strict(spark):
    assert column(spark, ["1.234,56", "-3", "xyz", "2,99"], parse_price_strict) == [1234.56, -3.0, None, 2.99]


def test_int(spark):
    assert column(spark, ["2 x", "0.088", "-3", "x", None], parse_int) == [2, 0, 3, None, None]


def test_date(spark):
    got = column(spark, ["12-08-2023 11:44:40", "21/10/2023 13:48", "09/08/2023", "2023-08-09", "Datum: 12.03.24", "10", "junk", "31-02-2023", "01/01/80", None], parse_date)
    assert [None if d is None else d.isoformat() for d in got] == ["2023-12-08", "2023-10-21", "2023-09-08", "2023-08-09", "2024-12-03", None, None, None, "1980-01-01", None]


def test_day_first(spark):
    assert column(spark, ["09/08/2023"], lambda c: parse_date(c, day_first=True))[0].isoformat() == "2023-08-09"


def test_small_functions(spark):
    assert column(spark, ["{}", "{"], is_json) == [True, False]
    assert column(spark, ["/a/b.c.JPG", "x"], stem) == ["b.c", "x"]
    assert column(spark, ["it's"], lambda c: pair_literal(c, F.lit(987))) == ["('it\\'s', 0.987)"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_folds_stay_in_range(spark, values):
    a = F.array(*[F.lit(v).cast("bigint") for v in values])
    row = spark.range(1).select(folds.noisy_or(a).alias("o"), folds.product(a).alias("p")).first()
    o, p = 0, 1000
    for v in values:
        o, p = o + ((1000 - o) * v + 500) // 1000, (p * v + 500) // 1000
    assert (row.o, row.p) == (o, p)
    assert max(values) <= row.o <= 1000 and 0 <= row.p <= min(values)
