"""Receipt tables derived from orders and their lines, in Spark and as DuckDB SQL.

An order is a receipt, each of its lines a text line of four tokens, with a
header (store, date) and a footer (totals). Positions, confidences and label
candidates follow from the keys by whole-number arithmetic, so both engines get
the same rows. Lines from the ninth on, and the footer, are on a second page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.functions.labels import LABELS, label_of
from quittance.operators.lines import segment_lines
from quittance.operators.receipt import correct_entries
from quittance.sources.shared import compiled_code

PAGE_LINES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(i: object, values: list[int]) -> object:
    return F.get(F.array(*map(F.lit, values)), i)


def _money(cents: object) -> object:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


COLUMNS = ["receipt_id", "page_no", "seq", "text", "x1", "y1", "x2", "y2", "ocr_milli", "h", "c1", "p1", "c2", "p2", "c3", "p3"]


#: Bytes of lineitem's files, about, whose tokens make a partition: they are some 30 times as many bytes, and are sorted in memory.
PART_BYTES = 512 << 10


def _parts(lines: DataFrame) -> int | None:
    """Partitions that keep the tokens of each in memory; None where Spark's own number does, since there are not more than tasks."""
    n = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // PART_BYTES
    return n if n > lines.sparkSession.sparkContext.defaultParallelism else None


def candidates(spark: SparkSession, sf_dir: str, receipts: DataFrame | None = None) -> DataFrame:
    """Tokens with three label candidates in columns, of all receipts or of those whose receipt_id is in ``receipts``.

    Orders and their lines are moved once, while they are narrow; tokens are made
    where the lines lie, by receipt_id, so what is grouped by it moves no token.
    """
    compiled_code(spark)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name").hint("shuffle_hash")
    o = table(spark, sf_dir, "orders")
    if receipts is not None:
        li, o = (x.join(receipts, F.col(c) == F.col("receipt_id"), "left_semi") for x, c in ((li, "l_orderkey"), (o, "o_orderkey")))
    both = li.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").withColumn("is_line", F.lit(True)).unionByName(
        o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_totalprice", F.lit(False).alias("is_line")), allowMissingColumns=True
    )
    if receipts is None and (n := _parts(li)):
        both = both.repartition(n, "l_orderkey")
    is_line = F.col("is_line")
    w = W.partitionBy("l_orderkey").orderBy((~is_line).alias("head"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    rows = both.withColumn("ln", F.row_number().over(w).cast("long") - 1)
    # amounts are rounded once for a line and not for its tokens: rounding a double goes by its decimal digits
    rows = rows.withColumn("cents", F.round(F.when(is_line, F.col("l_extendedprice")).otherwise(F.col("o_totalprice")) * 100).cast("long"))
    own = F.when(is_line, F.array(*map(F.lit, range(4)))).otherwise(F.array(*map(F.lit, range(5))))
    key, cents = F.col("l_orderkey"), F.col("cents")
    rows = rows.withColumn("k", F.explode(own)).withColumn("h", F.when(is_line, (F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("k") * 7) % 1009).otherwise(key % 1009))
    ln, k, h = F.col("ln"), F.col("k"), F.col("h")
    base = 40 * ln - F.when(ln % 3 == 2, 18).otherwise(0) - F.when(ln % 5 == 4, 30).otherwise(0)
    unit = F.floor(cents / F.greatest(F.col("l_quantity").cast("long"), F.lit(1))).cast("long")
    money = lambda c: F.when(h % 3 == 0, F.translate(_money(c), "015", "OlS")).otherwise(_money(c))
    qty = F.col("l_quantity").cast("long").cast("string")
    tax = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 10 == 9
    first = F.when(h % 13 == 0, F.lit(0)).otherwise(F.when(tax, _pick(k, [12, 11, 13, 14])).otherwise(31 + k))
    third = F.when(tax, _pick(k, [13, 12, 14, 11])).otherwise(35 + (h % 3)).cast("int")
    line = {
        "page_no": F.when(ln < PAGE_LINES, 0).otherwise(1),
        "seq": 4 * ln + k + 10,
        "text": F.when(k == 0, F.when(h % 5 == 0, F.concat(qty, F.lit(" x"))).otherwise(qty)).when(k == 1, F.col("p_name")).when(k == 2, money(unit)).otherwise(money(cents)),
        "x1": (10 + 120 * k).cast("long"), "y1": base + h % 7, "x2": (110 + 120 * k).cast("long"), "y2": base + h % 7 + 24 + h % 5,
        "ocr_milli": 700 + h % 300,
        "c1": F.when(h % 17 == 0, third).otherwise(first), "p1": 600 + h % 250,
        "c2": (50 + h % 20).cast("int"), "p2": 100 + h % 100,
        "c3": F.when(h % 17 == 0, first).otherwise(third), "p3": 20 + h % 60,
    }
    # by k: store, date, two totals and a tenth of the total
    at = lambda values: _pick(k, values)
    head = {
        "page_no": F.when(k < 2, 0).otherwise(1),
        "seq": at([0, 1, 1_000_000, 1_000_001, 1_000_002]),
        "text": F.when(k == 0, F.concat(F.lit("Store "), (F.col("o_custkey") % 50).cast("string"))).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(k == 4, _money(F.floor(cents / 10).cast("long"))).otherwise(_money(cents)),
        "x1": F.lit(10), "y1": at([-200, -150, 1_000_000, 1_000_040, 1_000_080]), "x2": F.lit(200), "y2": at([-200, -150, 1_000_000, 1_000_040, 1_000_080]) + 24,
        "ocr_milli": 900 + key % 100,
        "c1": at([20, 2, 71, 71, 85]), "p1": F.when(k == 0, 800 + key % 200).when(k == 2, 700 + key % 200).when(k == 3, 650 + key % 100).otherwise(600 + key % 300),
        "c2": at([6, 20, 81, 81, 71]), "p2": F.lit(90),
        "c3": at([21, 5, 73, 73, 81]), "p3": F.lit(50),
    }
    kinds = {"page_no": "int", "text": "string", "c1": "int", "c2": "int", "c3": "int"}
    made = {c: F.when(is_line, line[c]).otherwise(head[c]).cast(kinds.get(c, "long")).alias(c) for c in line}
    return rows.select(key.alias("receipt_id"), *[made.get(c, F.col(c)) for c in COLUMNS[1:]])


def receipt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receipt_id) of all receipts that have tokens: orders, and lines whose part is there."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"))
    return o.union(li.select("l_orderkey")).distinct()


def labelled(tokens: DataFrame) -> DataFrame:
    """Candidates in columns as the labels array that the operators take."""
    cand = lambda i: F.struct(F.col(f"c{i}").alias("label_id"), label_of(F.col(f"c{i}")).alias("label"), F.col(f"p{i}").alias("prob_milli"))
    return tokens.withColumn("labels", F.array(cand(1), cand(2), cand(3))).drop("c1", "p1", "c2", "p2", "c3", "p3")


def entries(spark: SparkSession, sf_dir: str, receipts: DataFrame | None = None) -> DataFrame:
    """Tokens with the labels array, of all receipts or of those in ``receipts``."""
    return labelled(candidates(spark, sf_dir, receipts))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their lines; labels come after the sort, which is of narrow rows."""
    return labelled(segment_lines(candidates(spark, sf_dir)))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with lines and typed values."""
    return correct_entries(segmented(spark, sf_dir))


def with_quads(tokens: DataFrame) -> DataFrame:
    """Adds ``quad``: the box with its upper right corner moved up or down by up to three."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return tokens.withColumn("quad", F.array(p(x1, y1), p(x2, y1 + F.col("h") % 7 - 3), p(x2, y2), p(x1, y2)))


def _sql_text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


#: The label dimension as a DuckDB table expression.
LAB = "lab(label_id, label, grp, grp_ord, format, colour) AS (VALUES " + ", ".join(f"({i}, {_sql_text(a)}, {_sql_text(g)}, {k}, {_sql_text(f)}, {_sql_text(c)})" for i, a, g, k, f, c in LABELS) + ")"

_MONEY = "({0} // 100)::VARCHAR || ',' || lpad(({0} % 100)::VARCHAR, 2, '0')"


def _made(page: int, seq: int, text: str, y: int, c1: int, p1: str, c2: int, c3: int) -> str:
    return f"SELECT o_orderkey, {page}, {seq}::BIGINT, {text}, 10::BIGINT, {y}::BIGINT, 200::BIGINT, {y + 24}::BIGINT, 900 + o_orderkey % 100, o_orderkey % 1009, {c1}, {p1}, {c2}, 90::BIGINT, {c3}, 50::BIGINT FROM orders"


_TOTAL = "round(o_totalprice * 100)::BIGINT"

#: The tokens as DuckDB table expressions.
TOK = f"""
li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, round(l_extendedprice * 100)::BIGINT AS cents, p_name,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS ln
  FROM lineitem JOIN part ON l_partkey = p_partkey),
lk AS (SELECT *, (l_partkey * 31 + l_suppkey * 17 + k * 7) % 1009 AS h, (l_partkey * 7 + l_suppkey) % 10 = 9 AS tax,
  40 * ln - CASE WHEN ln % 3 = 2 THEN 18 ELSE 0 END - CASE WHEN ln % 5 = 4 THEN 30 ELSE 0 END AS base,
  cents // greatest(l_quantity::BIGINT, 1) AS unit FROM li, (VALUES (0), (1), (2), (3)) v(k)),
lc AS (SELECT *, CASE WHEN h % 13 = 0 THEN 0 WHEN tax THEN ([12, 11, 13, 14])[k + 1] ELSE 31 + k END AS own,
  CASE WHEN tax THEN ([13, 12, 14, 11])[k + 1] ELSE 35 + (h % 3) END AS third,
  {_MONEY.format('unit')} AS mu, {_MONEY.format('cents')} AS mc FROM lk),
tok(receipt_id, page_no, seq, text, x1, y1, x2, y2, ocr_milli, h, c1, p1, c2, p2, c3, p3) AS (
  SELECT l_orderkey, CASE WHEN ln < {PAGE_LINES} THEN 0 ELSE 1 END, 4 * ln + k + 10,
    CASE k WHEN 0 THEN l_quantity::BIGINT::VARCHAR || CASE WHEN h % 5 = 0 THEN ' x' ELSE '' END WHEN 1 THEN p_name
      WHEN 2 THEN CASE WHEN h % 3 = 0 THEN translate(mu, '015', 'OlS') ELSE mu END ELSE CASE WHEN h % 3 = 0 THEN translate(mc, '015', 'OlS') ELSE mc END END,
    (10 + 120 * k)::BIGINT, base + h % 7, (110 + 120 * k)::BIGINT, base + h % 7 + 24 + h % 5, 700 + h % 300, h,
    CASE WHEN h % 17 = 0 THEN third ELSE own END, 600 + h % 250, 50 + h % 20, 100 + h % 100, CASE WHEN h % 17 = 0 THEN own ELSE third END, 20 + h % 60 FROM lc
  UNION ALL {_made(0, 0, "'Store ' || (o_custkey % 50)::VARCHAR", -200, 20, '800 + o_orderkey % 200', 6, 21)}
  UNION ALL {_made(0, 1, "strftime(o_orderdate, '%d/%m/%Y')", -150, 2, '600 + o_orderkey % 300', 20, 5)}
  UNION ALL {_made(1, 1_000_000, _MONEY.format(_TOTAL), 1_000_000, 71, '700 + o_orderkey % 200', 81, 73)}
  UNION ALL {_made(1, 1_000_001, _MONEY.format(_TOTAL), 1_000_040, 71, '650 + o_orderkey % 100', 81, 73)}
  UNION ALL {_made(1, 1_000_002, _MONEY.format(f'({_TOTAL} // 10)'), 1_000_080, 85, '600 + o_orderkey % 300', 71, 81)})"""

#: Tokens with their text line.
SEG = f"""{TOK},
lg AS (SELECT *, lag(y1) OVER w AS py1, lag(y2) OVER w AS py2 FROM tok WINDOW w AS (PARTITION BY receipt_id, page_no ORDER BY seq)),
seg AS (SELECT *, row_number() OVER w - 1 AS pos, (sum(CASE WHEN py1 IS NULL OR y1 >= py2 OR (NOT y2 <= py2 AND 2 * (py2 - y1) < y2 - py1) THEN 1 ELSE 0 END) OVER w)::BIGINT - 1 AS line_no
  FROM lg WINDOW w AS (PARTITION BY receipt_id, page_no ORDER BY seq))"""

NOISY_OR = "list_reduce({0}, lambda m, x: m + ((1000 - m) * x + 500) // 1000, 0::BIGINT)"
PRODUCT = "list_reduce({0}, lambda m, x: (m * x + 500) // 1000, 1000::BIGINT)"

#: Candidates in rows, and each line's groups from best to worst.
VOTE = f"""{SEG}, {LAB},
cand AS (SELECT receipt_id, page_no, line_no, pos, u.r AS rank, u.c AS label_id, u.p AS prob FROM seg,
  LATERAL (SELECT unnest([0, 1, 2]) AS r, unnest([c1, c2, c3]) AS c, unnest([p1, p2, p3]) AS p) u),
lines AS (SELECT DISTINCT receipt_id, page_no, line_no FROM seg),
votes AS (SELECT receipt_id, page_no, line_no, grp_ord, {NOISY_OR.format('list(prob::BIGINT ORDER BY pos, rank)')} AS score FROM cand JOIN lab USING (label_id) WHERE label_id <> 0 GROUP BY ALL),
grps AS (SELECT DISTINCT grp, grp_ord FROM lab),
ranked AS (SELECT l.*, g.grp, coalesce(v.score, 0) AS score, row_number() OVER (PARTITION BY l.receipt_id, l.page_no, l.line_no ORDER BY coalesce(v.score, 0) DESC, g.grp_ord) AS k
  FROM lines l CROSS JOIN grps g LEFT JOIN votes v ON l.receipt_id = v.receipt_id AND l.page_no = v.page_no AND l.line_no = v.line_no AND g.grp_ord = v.grp_ord)"""


def price_sql(t: str) -> str:
    p = f"replace(translate({t}, 'lIoOSbGB', '11005668'), ',', '.')"
    f, g = f"regexp_extract({p}, '^(.*)\\.([^.]*)$', 1, 's')", f"regexp_extract({p}, '^(.*)\\.([^.]*)$', 2, 's')"
    q = f"(coalesce(nullif(regexp_extract({f}, '-?\\d+$'), ''), {f}) || '.' || coalesce(nullif(regexp_extract({g}, '^\\d+'), ''), {g}))"
    return (
        f"CASE WHEN instr({p}, '.') = 0 THEN TRY_CAST(nullif(regexp_extract({p}, '\\d+'), '') AS DOUBLE) "
        f"WHEN regexp_full_match({q}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN TRY_CAST(trim({q}) AS DOUBLE) WHEN {t} IS NULL THEN NULL ELSE 0.0 END"
    )


def int_sql(t: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(translate({t}, 'lIoOSbGB', '11005668'), '\\d+'), '') AS BIGINT)"


def date_sql(t: str) -> str:
    time = "(?: \\d{1,2}:\\d{2}(?::\\d{2})?)?"
    day = f"^\\s*(\\d{{1,2}})[./-](\\d{{1,2}})[./-](\\d{{4}}|\\d{{2}}){time}\\s*$"
    iso = f"^\\s*(\\d{{4}})[-./](\\d{{1,2}})[-./](\\d{{1,2}}){time}\\s*$"
    inside = f"regexp_extract({t}, '\\d{{2}}[./-]\\d{{2}}[./-]\\d{{2,4}}')"
    src = f"CASE WHEN regexp_matches({t}, '{day}') THEN {t} WHEN length({inside}) IN (8, 10) THEN {inside} END"
    a, b, y = (f"TRY_CAST(regexp_extract({src}, '{day}', {i}) AS INT)" for i in (1, 2, 3))
    year = f"CASE WHEN {y} >= 1000 THEN {y} WHEN {y} >= 76 THEN {y} + 1900 ELSE {y} + 2000 END"
    month, d = f"CASE WHEN {a} > 12 THEN {b} ELSE {a} END", f"CASE WHEN {a} > 12 THEN {a} ELSE {b} END"
    parts = [f"regexp_extract({t}, '{iso}', {i})" for i in (1, 2, 3)]
    made = "lpad(({0})::VARCHAR, 4, '0') || '-' || lpad(({1})::VARCHAR, 2, '0') || '-' || lpad(({2})::VARCHAR, 2, '0')"
    return f"CASE WHEN regexp_matches({t}, '{iso}') THEN TRY_CAST({made.format(*parts)} AS DATE) ELSE TRY_CAST({made.format(year, month, d)} AS DATE) END"
