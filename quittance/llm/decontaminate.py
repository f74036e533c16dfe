"""Benchmark decontamination: one Aho-Corasick automaton of test windows, run once over each text.

The automaton goes to every Python worker, so what it is made from has a checked
size. A larger benchmark is cut into parts, each with an automaton of its own that
is run over the texts; only what they hit is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quittance.llm.common import bounded_batches, cut, table

#: Words of a window.
WINDOW = 10
#: Most words that become one automaton (about 1 KB of a worker's memory each); a larger benchmark becomes several.
BLOCK_WINDOWS = 250_000

#: What parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of a piece of an item; longer items are cut, so that parts can be filled evenly.
_STEP = 1 << 12
#: A-Z to a-z, other ASCII than letters and digits to a space; bytes beyond ASCII stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same words in an unfolded text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The automaton over word numbers; words that no window has are 0."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if ids else 0):
                owners.setdefault(tuple(ids[i : i + n]), set()).update([] if item is None else [item])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in owners.items():
            self.automaton.add_word(key, (len(key), own))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Merged runs [first, last] of hit words in order, and the items that occur."""
        runs: list[list[int]] = []
        items: set[int] = set()
        if self.empty or not words:
            return runs, items
        get = self.number.get
        for end, (n, own) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            items |= own
            first = end - n + 1
            while runs and runs[-1][0] >= first:
                runs.pop()
            if runs and runs[-1][1] >= first - 1:
                runs[-1][1] = end
            else:
                runs.append([first, end])
        return runs, items


def _merged(found: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(found):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _spans(text: str, runs: list[list[int]]) -> list[list[int]]:
    """Runs of words as character offsets of the original text."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [[at[a][0], at[b][1]] for a, b in runs]


#: Per Python worker: the automata of the benchmarks that its tasks name.
_BUILT: dict[tuple, Windows] = {}


def _digest(items: list[tuple[int | None, str]]) -> str:
    return hashlib.sha256(repr(items).encode()).hexdigest()


def _ordered(rows: list[Row]) -> list[tuple[int | None, str]]:
    return sorted(((r.item, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _windows(items: list[tuple[int | None, str]], window: int, digest: str) -> Windows:
    key = (digest, window)
    if key not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.clear()
        _BUILT[key] = Windows(items, window)
    return _BUILT[key]


_NEW = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)
_ARROW = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64())]


def _added(docs: DataFrame, judge: Callable[[pa.RecordBatch], list[tuple]], also: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns ``also``, plus the four new ones that ``judge`` finds for each row of a batch."""
    names = _NEW.fieldNames()
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in also], *_NEW.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = judge(batch)
            kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in also]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in kept], *made], names=[*[n for _, n in kept], *names])

    return docs.mapInArrow(run, schema)


def _scan(docs: DataFrame, items: list[tuple[int | None, str]], text_col: str, window: int) -> DataFrame:
    digest = _digest(items)

    def judge(batch: pa.RecordBatch) -> list[tuple]:
        w = _windows(items, window, digest)
        rows = []
        for text in batch.column(text_col).to_pylist():
            words = words_of(text)
            runs, found = w.scan(words)
            rows.append((len(words), runs, _spans(text or "", runs), sorted(found)))
        return rows

    return _added(docs, judge)


def _pieces(items: DataFrame, window: int, step: int) -> DataFrame:
    """(item, text, n): items in pieces of up to ``step`` windows, so that each window is whole in one of them; n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                made = [words[i : i + step + window - 1] for i in range(0, max(1, len(words) - window + 1), step)] if words else []
                columns = [[item] * len(made), [b" ".join(w).decode() for w in made], [len(w) for w in made]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["item", "text", "n"])

    return items.select("item", "text").mapInArrow(run, "item long, text string, n long").distinct()


def _parts(items: DataFrame, total: int, window: int) -> tuple[DataFrame, int]:
    """(pieces with their part, number of parts): parts of up to BLOCK_WINDOWS words, counted; more of them where one has more."""
    block = max(BLOCK_WINDOWS, 4 * window)
    pieces = cut(_pieces(items, window, min(_STEP, block // 8)))
    n = -(-5 * total // (4 * block))
    while True:
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        if (dealt.groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= block:
            return dealt, n
        n += 1 + n // 4


def _hits(texts: DataFrame, items: list[tuple[int | None, str]], window: int) -> DataFrame:
    """(k, runs, found) of the texts (k, text) that hold a window of ``items``."""
    digest = _digest(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _windows(items, window, digest)
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs, found = w.scan(words_of(text))
                if runs:
                    rows.append((k, runs, sorted(found)))
            kinds = [pa.binary(), _ARROW[1], _ARROW[3]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["k", "runs", "found"])

    return texts.mapInArrow(run, "k binary, runs array<array<int>>, found array<long>")


def _scan_in_parts(docs: DataFrame, items: DataFrame, total: int, text_col: str, window: int) -> DataFrame:
    """The same as _scan for a benchmark of any size: an automaton for each part of it, one after the other.

    The texts are read once for each part and stay where they are. Only what a
    part hits is written, under the text's digest; copies of a text fall together
    before the shuffle. The texts then meet their hits in one join, whose key is
    a struct so that adaptive execution can split a text of many copies.
    """
    dealt, n = _parts(items, total, window)
    key = F.unhex(F.sha2(F.col(text_col), 256))
    texts = docs.select(key.alias("k"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    met = []
    for part in range(n):
        rows = _ordered(dealt.where(F.col("part") == part).select("item", "text").collect())  # BLOCK_WINDOWS words at most
        if rows:
            met.append(cut(_hits(texts, rows, window)))
    if not met:
        return _scan(docs, [], text_col, window)
    hits = reduce(DataFrame.unionByName, met).groupBy("k").agg(F.flatten(F.collect_set("runs")).alias("__dc_at"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("__dc_items"))
    hits = hits.select(F.struct("k").alias("__dc_key"), "__dc_at", "__dc_items")
    both = docs.withColumn("__dc_k", F.struct(key.alias("k"))).join(hits, F.col("__dc_k") == F.col("__dc_key"), "left")

    def judge(batch: pa.RecordBatch) -> list[tuple]:
        rows = []
        for text, at, found in zip(*[batch.column(c).to_pylist() for c in (text_col, "__dc_at", "__dc_items")], strict=True):
            runs = _merged(at or [])
            rows.append((len(words_of(text)), runs, _spans(text or "", runs), sorted(found or [])))
        return rows

    return _added(both, judge, ("__dc_k", "__dc_key", "__dc_at", "__dc_items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Marks the words of texts that lie inside a window of a benchmark item.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window. The windows become one automaton in each
    Python worker, and each text is scanned once. The benchmark is counted
    first: up to ``BLOCK_WINDOWS`` words are one automaton; a larger one becomes
    several, for each of which the texts are read again, with the same result.

    Returns all columns of ``docs`` plus ``n_words``, ``hit_words`` (runs
    [first, last] of hit words), ``hit_spans`` (the same runs as [start, end) in
    characters of the original text) and ``items`` (the items with occurring
    windows); input columns of these names are replaced.

    Edge cases: null and empty texts have no words, in documents and in the
    benchmark; an item id that is null hits but is not listed; repeated items
    count once; an empty benchmark hits nothing; an empty table gives an empty
    table; repeated rows stay; very long texts are scanned whole.
    """
    bounded_batches(docs.sparkSession)
    rest = docs.drop(*_NEW.fieldNames())
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.size(F.split("text", SEPARATORS)).cast("long"))).first()[0] or 0
    if total > BLOCK_WINDOWS:
        return _scan_in_parts(rest, items, total, text_col, window)
    return _scan(rest, _ordered(items.collect()), text_col, window)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to what find_contamination returns."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0] + 1)
    as_text = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(as_text, 256), "contaminated": n_hit > 0})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(find_contamination(docs, table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM b, LATERAL (SELECT unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, ns.n, i, array_to_string(w[i:i + ns.n - 1], ' ') AS win
       FROM d, ns, LATERAL (SELECT unnest(generate_series(1, len(w) - ns.n + 1)) AS i) WHERE len(w) >= ns.n),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS p) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
