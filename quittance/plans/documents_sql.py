"""DuckDB SQL that gives the JSON documents as text, letter by letter.

Objects are written one member a line, arrays in one line; an object inside
another is indented by moving its lines to the right, so no depth is counted.
"""

from __future__ import annotations

from collections.abc import Iterable

from quittance.functions.labels import LABEL_ID
from quittance.operators import receipt as R
from quittance.plans.derived import LAB, LABELS, NOISY_OR, PRODUCT, TOK, VOTE
from quittance.plans.receipts import _FIX


def _text(value: str) -> str:
    return f"to_json({value})::VARCHAR"


def _object(members: Iterable[tuple[str, str]]) -> str:
    """An object of SQL expressions for the texts of its members; null is written out."""
    own = " || ',' || ".join(f"""chr(10) || '"{k}" : ' || coalesce({v}, 'null')""" for k, v in members)
    return f"('{{' || replace({own}, chr(10), chr(10) || '  ') || chr(10) || '}}')"


def _array(value: str, order: str, where: str = "") -> str:
    return f"coalesce('[ ' || string_agg({value}, ', ' ORDER BY {order}) {where} || ' ]', '[ ]')"


def _numbers(*names: str) -> list[tuple[str, str]]:
    return [(n, f"{n}::VARCHAR") for n in names]


_BOX = _object(_numbers("x1", "y1", "x2", "y2"))
_LABELS = "'[ ' || " + " || ', ' || ".join(_object([("label_id", f"c{i}::VARCHAR"), ("label", _text(f"l{i}.label")), ("prob_milli", f"p{i}::VARCHAR")]) for i in (1, 2, 3)) + " || ' ]'"
_ENTRIES = f"""ent AS (SELECT fix.*, {_BOX} AS box, {_LABELS} AS labels,
  CASE WHEN fix.format IN ('DATE', 'DATETIME') THEN 'date' WHEN fix.format = 'PRICE' THEN 'num' WHEN fix.format = 'NUMBER' THEN 'int' END AS kind
  FROM fix LEFT JOIN lab l1 ON c1 = l1.label_id LEFT JOIN lab l2 ON c2 = l2.label_id LEFT JOIN lab l3 ON c3 = l3.label_id)"""


def _fields_sql() -> str:
    """Document fields in rows: (receipt_id, field, doc)."""
    rows = ", ".join(f"({LABEL_ID[x]}, '{R.key_of(f)}', '{f.selector}')" for f in R.FIELDS for x in f.labels)
    meta = _object([*_numbers("page_no", "seq"), ("text", _text("text")), ("ocr_milli", "ocr_milli::VARCHAR"), ("labels", "labels")])
    share = lambda c: f"({c}::DOUBLE / 1000)::VARCHAR"
    value = "CASE kind WHEN 'date' THEN day::VARCHAR WHEN 'num' THEN num::VARCHAR WHEN 'int' THEN whole::VARCHAR END"
    best = _object([("text", _text("text")), ("corrected", _text(value)), ("bbox", "boxes"), ("ocr_confidence", share("ocr")), ("du_confidence", share("du")), ("metadata", "meta")])
    every = _object([("text", _array(_text("text"), "place")), ("bbox", _array("boxes", "place")), *[(n, share(PRODUCT.format(f"list({c} ORDER BY place)"))) for n, c in (("ocr_confidence", "ocr"), ("du_confidence", "du"))], ("metadata", "meta")])
    return f"""fld(c, field, selector) AS (VALUES {rows}),
fe AS (SELECT * FROM ent JOIN fld ON c1 = c),
meta AS (SELECT receipt_id, field, {_array(meta, 'page_no, seq')} AS meta FROM fe GROUP BY receipt_id, field),
mrg AS (SELECT receipt_id, field, selector, text, {NOISY_OR.format('list(ocr_milli::BIGINT ORDER BY page_no, seq)')} AS ocr, {NOISY_OR.format('list(p1::BIGINT ORDER BY page_no, seq)')} AS du,
  {_array('box', 'page_no, seq')} AS boxes, min(page_no * 10000000 + seq) AS place, last(kind ORDER BY page_no, seq) AS kind,
  last(corrected_date ORDER BY page_no, seq) AS day, last(corrected_num ORDER BY page_no, seq) AS num, last(corrected_int ORDER BY page_no, seq) AS whole
  FROM fe GROUP BY receipt_id, field, selector, text),
best AS (SELECT *, row_number() OVER (PARTITION BY receipt_id, field ORDER BY du DESC, place) AS k FROM mrg WHERE selector = 'best'),
docs AS (SELECT receipt_id, field, {best} AS doc FROM best JOIN meta USING (receipt_id, field) WHERE k = 1
  UNION ALL SELECT receipt_id, field, {every} FROM mrg JOIN meta USING (receipt_id, field) WHERE selector = 'all' GROUP BY receipt_id, field, meta)"""


def _table_sql(group: str, fields: tuple[R.Field, ...]) -> str:
    """(receipt_id, rows) of a table, as the relation named ``group``."""
    ids = {f.name: LABEL_ID[f.labels[0]] for f in fields}
    own = f"(SELECT list(label_id) FROM lab WHERE grp = '{next(x[2] for x in LABELS if x[0] == ids[fields[0].name])}')"
    first = lambda v: "CASE " + " ".join(f"WHEN list_contains(o, c{i}) THEN {v}{i}" for i in (1, 2, 3)) + " END"
    members = [*_numbers("page_no", "line_no")]
    for f in fields:
        m, where = f"m_{f.name}", f"FILTER (WHERE m_{f.name} IS NOT NULL)"
        if f.selector == "best":
            typed = [("text", _text("text")), ("corrected_date", _text("corrected_date")), ("corrected_num", "corrected_num::VARCHAR"), ("corrected_int", "corrected_int::VARCHAR"), ("corrected_kind", _text("kind"))]
            row = _object([*typed, ("box", "box"), ("ocr_milli", "ocr_milli::VARCHAR"), ("du_milli", f"{m}::VARCHAR")])
            members.append((f.name, f"first({row} ORDER BY {m} DESC, pos) {where}"))
        else:
            folds = [(n, PRODUCT.format(f"coalesce(list({c}::BIGINT ORDER BY pos) {where}, [])") + "::VARCHAR") for n, c in (("ocr_milli", "ocr_milli"), ("du_milli", m))]
            members.append((f.name, f"CASE WHEN count({m}) > 0 THEN {_object([('text', _array(_text('text'), 'pos', where)), ('box', _array('box', 'pos', where)), *folds])} END"))
    meta = _object([("pos", "pos::VARCHAR"), ("text", _text("text")), ("labels", "labels"), ("ocr_milli", "ocr_milli::VARCHAR")])
    members.append(("metadata", _array(meta, "pos")))
    marks = ", ".join(f"CASE WHEN f = {i} THEN p END AS m_{n}" for n, i in ids.items())
    return f"""{group}_m AS (SELECT *, {marks} FROM (SELECT *, {first('c')} AS f, {first('p')} AS p FROM (SELECT ent.*, {own} AS o FROM ent JOIN top USING (receipt_id, page_no, line_no) WHERE top.grp = '{group}'))),
{group}_l AS (SELECT receipt_id, page_no, line_no, {_object(members)} AS line FROM {group}_m GROUP BY receipt_id, page_no, line_no),
{group} AS (SELECT receipt_id, {_array('line', 'page_no, line_no')} AS lines FROM {group}_l GROUP BY receipt_id)"""


def _receipt_sql() -> str:
    key = lambda f: f"max(CASE WHEN field = '{R.key_of(f)}' THEN doc END)"
    columns = ", ".join(f'{key(f)} AS "{R.key_of(f)}"' for f in R.FIELDS)
    section = lambda s: (s, _object([(f.name, f'"{R.key_of(f)}"') for f in R.FIELDS if f.section == s]))
    table = lambda g: (g, f"coalesce({g}.lines, '[ ]')")
    whole = _object([("date", '"date"'), ("time", '"time"'), table("tax_table"), section("store"), table("item_table"), section("sub_total"), section("total"), section("payment")])
    return f"""WITH {_FIX}, {_ENTRIES}, {_fields_sql()},
head AS (SELECT receipt_id, {columns} FROM docs GROUP BY receipt_id),
{VOTE.split(LAB + ',', 1)[1]},
top AS (SELECT receipt_id, page_no, line_no, grp FROM ranked WHERE k = 1 AND grp IN ('item_table', 'tax_table')),
{_table_sql('item_table', R.ITEM_FIELDS)},
{_table_sql('tax_table', R.TAX_FIELDS)}
SELECT receipt_id, {_object([('receipt', whole)])} AS json
FROM (SELECT DISTINCT receipt_id FROM fix) LEFT JOIN head USING (receipt_id) LEFT JOIN item_table USING (receipt_id) LEFT JOIN tax_table USING (receipt_id)"""


def _entries_sql() -> str:
    label = lambda i: f"{{'label_id': c{i}, 'label': l{i}.label, 'prob_milli': p{i}}}"
    row = "{" + ", ".join(f"'{c}': {c}" for c in ("page_no", "seq", "text", "x1", "y1", "x2", "y2", "ocr_milli")) + f", 'labels': [{label(1)}, {label(2)}, {label(3)}]}}"
    return f"""WITH {TOK}, {LAB}
SELECT receipt_id, to_json(list({row} ORDER BY page_no, seq))::VARCHAR AS json
FROM tok LEFT JOIN lab l1 ON c1 = l1.label_id LEFT JOIN lab l2 ON c2 = l2.label_id LEFT JOIN lab l3 ON c3 = l3.label_id WHERE page_no = 0 GROUP BY receipt_id"""


SQL = {"q_receipt_json": _receipt_sql(), "q_entry_json": _entries_sql()}

QUERIES: dict = {}
