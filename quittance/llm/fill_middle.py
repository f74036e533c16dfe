"""Fill-in-middle transformation: unit boundaries as packed bits, cuts by rank and select."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quittance.llm.common import bounded_batches, table

#: Bytes of a block of the popcount directory.
BLOCK = 64
MARKERS = ("<P>", "<S>", "<M>")
#: Columns that the transformation adds.
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


class BitVector:
    """Packed bits with the count of ones before each block; rank and select answer many positions at once."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        blocks = len(packed) // BLOCK + 1  # the last block is never full, so every position has a block
        self.words = np.zeros((blocks, BLOCK), np.uint8)
        self.words.reshape(-1)[: len(packed)] = packed
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64), out=self.before[1:])

    def __len__(self) -> int:
        """The total popcount."""
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, np.int64)
        block, byte = np.divmod(at >> 3, BLOCK)
        words = self.words[block]
        whole = np.where(np.arange(BLOCK) < byte[:, None], np.bitwise_count(words), 0).sum(1, dtype=np.int64)
        last = words[np.arange(len(at)), byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return self.before[block] + whole + np.bitwise_count(last)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th ones, k from 1 to the total."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, side="left") - 1
        rows = np.arange(len(k))
        left = k - self.before[block]
        upto = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        byte = np.argmax(upto >= left[:, None], axis=1)
        left -= np.where(byte > 0, upto[rows, byte - 1], 0)
        bits = np.cumsum(np.unpackbits(self.words[block, byte][:, None], axis=1, bitorder="little"), axis=1)
        return (block * BLOCK + byte) * 8 + np.argmax(bits >= left[:, None], axis=1)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends), without a copy."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _strings(parts: list[bytes], kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(parts) + 1, np.int64 if pa.types.is_large_string(kind) else np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return pa.Array.from_buffers(kind, len(parts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(b"".join(parts))])


def cuts(data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, first cut, second cut, code points of prefix and of middle) of each text; cuts are byte positions in ``data``.

    A text's units end at each newline and at its end. One bit vector holds the
    ends of all texts of a batch and another the bytes that begin a code point.
    """
    ends = data == 0x0A
    full = at[1:] > at[:-1]
    ends[at[1:][full] - 1] = True
    boundaries, points = BitVector(ends), BitVector((data & 0xC0) != 0x80)
    base = boundaries.rank(at)
    n = np.diff(base)
    a, b = h1 % (n + 1), h2 % (n + 1)
    found = []
    for units in (np.minimum(a, b), np.maximum(a, b)):
        cut = at[:-1].copy()
        some = units > 0
        cut[some] = boundaries.select(base[:-1][some] + units[some]) + 1
        found.append(cut)
    counts = [points.rank(x) for x in (at[:-1], *found)]
    return n, *found, counts[1] - counts[0], counts[2] - counts[1]


def _check(markers: tuple[str, str, str]) -> None:
    """Markers that overlap neither themselves nor each other stand in the output just where they were put."""
    if len(set(markers)) != 3 or not all(m and m.isascii() for m in markers):
        raise ValueError("three different markers of ASCII are needed")
    for x in markers:
        for y in markers:
            if (x != y and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"markers {x!r} and {y!r} overlap")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """Cuts every text at two unit boundaries and moves its middle to the end.

    Units are lines with their newline, and what follows the last newline. The
    cuts are drawn from the SHA-256 of seed and id, so a document is cut alike
    in every run and on every executor. ``percent`` of the documents are
    transformed, ``spm_percent`` of these with the suffix first (form "spm"),
    the others with the prefix first ("psm"); the rest is "plain". Rows never
    leave their partition; a batch of texts is held at a time.

    Returns all columns of ``docs`` plus ``n`` (units), ``form``,
    ``prefix_chars`` and ``middle_chars`` (code points, null where plain) and
    ``output``; input columns of these names are replaced.

    Edge cases: a null text is an empty one; an empty text, and one that holds a
    marker, is plain, its output is itself; a null id is drawn like an empty id;
    rows that repeat an id are cut each on its own; very long texts need memory
    for themselves and an eighth of it for each bit vector; an empty table gives
    an empty table.
    """
    _check(markers)
    spark = docs.sparkSession
    bounded_batches(spark)
    rest = docs.drop(*ADDED)
    if id_col not in rest.columns or text_col not in rest.columns:
        raise ValueError(f"documents need {id_col!r} and {text_col!r}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    held = F.lit(False)
    for m in markers:
        held = held | F.contains(text, F.lit(m))
    drawn = rest.withColumns(
        {
            "__fim_text": text,
            "__fim_held": held,
            **{f"__fim_h{i + 1}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)},
        }
    )
    own = [f.name for f in rest.schema.fields if not f.name.startswith("__fim_")]
    schema = T.StructType([rest.schema[c] for c in own] + T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in ADDED.items())).fields)
    p, s, m = (x.encode() for x in markers)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__fim_text")
            data, at = _bytes_of(texts)
            h1, h2, h3, h4 = (batch.column(f"__fim_h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5))
            n, one, two, prefix, middle = cuts(data, at, h1, h2)
            plain = batch.column("__fim_held").to_numpy(zero_copy_only=False) | (n == 0) | (h3 % 100 >= percent)
            spm = h4 % 100 < spm_percent
            view, out, forms = memoryview(data), [], []
            for i in range(len(texts)):
                a, b, c, d = at[i], one[i], two[i], at[i + 1]
                if plain[i]:
                    out.append(bytes(view[a:d]))
                    forms.append("plain")
                elif spm[i]:
                    out.append(b"".join((s, view[c:d], p, view[a:b], m, view[b:c])))
                    forms.append("spm")
                else:
                    out.append(b"".join((p, view[a:b], s, view[c:d], m, view[b:c])))
                    forms.append("psm")
            made = [pa.array(n), pa.array(forms, texts.type), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), _strings(out, texts.type)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *made], names=[*own, *ADDED])

    return drawn.select(*own, "__fim_text", "__fim_held", *[f"__fim_h{i}" for i in range(1, 5)]).mapInArrow(transform, schema)


def restore(output: str | Column, form: str | Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` made an output from; null where output or form is."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = markers
    head = lambda x, mark: F.substring_index(x, mark, 1)
    tail = lambda x, mark: F.substring_index(x, mark, -1)
    bare = lambda x, mark: F.substring(x, len(mark) + 1, 1 << 30)
    psm = F.concat(bare(head(output, s), p), tail(output, m), head(tail(output, s), m))
    spm = F.concat(head(tail(output, p), m), tail(output, m), bare(head(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form == "plain", output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore("output", "form"), 256).alias("restored_sha256")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
             ('0x' || substr(g, 1, 8))::BIGINT AS h1, ('0x' || substr(g, 9, 8))::BIGINT AS h2,
             ('0x' || substr(g, 17, 8))::BIGINT AS h3, ('0x' || substr(g, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid,
             coalesce(array_to_string(units[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
