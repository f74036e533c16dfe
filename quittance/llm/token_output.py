"""Token-ID output: Re-Pair grammar compression per shard, with random access.

A shard holds whole documents in ascending order and is one binary record:

====================  =========================================================
magic                 ``QRP1``
counts                unsigned 32-bit: base symbols, rules, symbols, documents
rules                 pairs of symbols, packed; a rule names earlier ones
expansion lengths     unsigned 32-bit per rule: the ids that it stands for
sequence              symbols, packed
documents             signed 64-bit ids, a null-id byte each, unsigned 32-bit lengths
====================  =========================================================

All is little-endian. Packed symbols take as many bits as the largest symbol
needs, so neither the vocabulary nor the number of rules has a bound (symbols
stay under 2^31). The lengths let a reader find and expand just the symbols
that cover one document. Shards are rows of a Parquet table, since only Spark's
own writers reach every store.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm.bpe import codec
from quittance.llm.common import bounded_batches, shared_dir, table

MAGIC = b"QRP1"
#: Ids of a shard before it is closed; its last document may go beyond.
SHARD_IDS = 1 << 20
#: Least count of a pair that gets a rule: a rule takes 4 bytes and two symbols, each replaced pair gives one symbol back.
LEAST_COUNT = 8
#: Least share by which a round must shorten a shard for another round. Rounds to the very end give shards that are about 1 % smaller.
LEAST_GAIN = 0.01
_BINS = 1 << 18
#: Bytes of text that a writing task sorts and encodes, about.
TASK_BYTES = 128 << 20
#: Pieces that a writing worker keeps encoded; it runs alone in its task.
WRITER_PIECES = 450_000


def _frequent_pairs(seq: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of pairs, the hash bin of each, and by bin the pair's key and count.

    One pair stands for each bin; those that share a bin with it have another
    chance in the next round, whose ``salt`` deals the bins anew.
    """
    a, b = seq[:-1], seq[1:]
    bins = (a * np.int32(40503 + 2 * salt) + b * np.int32(9973 + 6 * salt) + (a >> np.int32(5))) & np.int32(_BINS - 1)
    heavy = np.bincount(bins, minlength=_BINS) >= LEAST_COUNT
    at = np.flatnonzero(heavy[bins])
    bins, key = bins[at], a[at].astype(np.int64) << 32 | b[at]
    keys = np.zeros(_BINS, np.int64)
    keys[bins] = key
    same = keys[bins] == key
    at, bins = at[same], bins[same]
    return at, bins, keys, np.bincount(bins, minlength=_BINS)


def repair(ids: np.ndarray, n_base: int, max_rules: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (rules, expansion lengths, sequence) of one shard.

    A round counts all pairs, then gives rules to the frequent ones, the most
    frequent first, as long as no symbol is the left of one pair and the right
    of another; so no two occurrences overlap and a round replaces all of them
    at once. A symbol paired with itself has no other pair in that round, and
    every other pair of a run is replaced. Rounds go on while pairs repeat
    LEAST_COUNT times and a round shortens the sequence by LEAST_GAIN;
    ``max_rules`` bounds the rules only where a caller asks for it.
    """
    seq = ids.astype(np.int32)
    room = (1 << 31) - 1 - n_base if max_rules is None else max_rules
    rules: list[np.ndarray] = []
    n_rules = 0
    salt = 0
    while len(seq) > 1 and n_rules < room:
        at, index, keys, counts = _frequent_pairs(seq, salt)
        salt += 1
        order = np.flatnonzero(counts >= LEAST_COUNT)
        order = order[np.argsort(-counts[order], kind="stable")]
        role: dict[int, int] = {}
        chosen = []
        lefts, rights = (keys[order] >> 32).tolist(), (keys[order] & 0xFFFFFFFF).tolist()
        for k, left, right in zip(order.tolist(), lefts, rights, strict=True):
            if left == right:
                if left in role:
                    continue
                role[left] = 3
            elif role.get(left, 1) == 1 and role.get(right, 2) == 2:
                role[left], role[right] = 1, 2
            else:
                continue
            chosen.append(k)
            if n_rules + len(chosen) >= room:
                break
        if not chosen:
            break
        symbol = np.full(len(keys), -1, np.int32)
        symbol[chosen] = n_base + n_rules + np.arange(len(chosen), dtype=np.int32)
        put = symbol[index]
        hit = put >= 0
        where, put = at[hit], put[hit]
        twin = np.flatnonzero(seq[where] == seq[where + 1])
        if len(twin):
            # in a run of one symbol every other pair is replaced
            at_twin = where[twin]
            begins = np.flatnonzero(np.diff(at_twin, prepend=-2) > 1)
            within = np.arange(len(twin)) - np.repeat(begins, np.diff(np.append(begins, len(twin))))
            free = np.ones(len(where), bool)
            free[twin[within % 2 == 1]] = False
            where, put = where[free], put[free]
        seq[where] = put
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        before, seq = len(seq), seq[keep]
        picked = keys[chosen]
        rules.append(np.stack([picked >> 32, picked & 0xFFFFFFFF], 1))
        n_rules += len(chosen)
        if before - len(seq) < LEAST_GAIN * before:
            break
    table_ = np.concatenate(rules).astype(np.int64) if rules else np.empty((0, 2), np.int64)
    lengths = np.ones(n_base + len(table_), np.int64)
    for i, (x, y) in enumerate(table_.tolist()):
        lengths[n_base + i] = lengths[x] + lengths[y]
    return table_, lengths[n_base:], seq


def _width(n_symbols: int) -> int:
    return max(1, (n_symbols - 1).bit_length())


def _packed(symbols: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(symbols.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _unpacked(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def pack(doc_ids: list[int | None], ids: list[bytes], n_base: int) -> bytes:
    """The record of one shard."""
    rules, lengths, seq = repair(np.frombuffer(b"".join(ids), "<u4"), n_base)
    width = _width(n_base + len(rules))
    return b"".join(
        [
            MAGIC,
            struct.pack("<4I", n_base, len(rules), len(seq), len(ids)),
            _packed(rules.ravel(), width),
            lengths.astype("<u4").tobytes(),
            _packed(seq, width),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array([len(x) // 4 for x in ids], "<u4").tobytes(),
        ]
    )


class Shard:
    """Reads a packed shard."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a shard")
        self.n_base, n_rules, n_seq, n_docs = struct.unpack_from("<4I", raw, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        def symbols(n: int) -> np.ndarray:
            width = _width(self.n_base + n_rules)
            return _unpacked(take("u1", -(-n * width // 8)), n, width)

        self.rules = symbols(2 * n_rules).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(self.n_base, np.int64), take("<u4", n_rules).astype(np.int64)])
        self.seq = symbols(n_seq)
        ids, null = take("<i8", n_docs), take("<u1", n_docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.n_ids = take("<u4", n_docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_ids)])[:-1].astype(np.int64)
        self._pool: np.ndarray | None = None
        self._ends: np.ndarray | None = None

    def _pooled(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of all symbols in a row, and where each begins."""
        begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        if self._pool is None:
            pool = np.empty(int(self.lengths.sum()), np.uint32)
            pool[: self.n_base] = np.arange(self.n_base)
            b, n = begins.tolist(), self.lengths.tolist()
            for i, (x, y) in enumerate(self.rules.tolist(), self.n_base):
                o = b[i]
                pool[o : o + n[x]] = pool[b[x] : b[x] + n[x]]
                pool[o + n[x] : o + n[i]] = pool[b[y] : b[y] + n[y]]
            self._pool = pool
        return self._pool, begins

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        pool, begins = self._pooled()
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        at = np.repeat(begins[symbols] - (ends - n), n) + np.arange(int(n.sum()))
        return pool[at]

    def all_ids(self) -> np.ndarray:
        return self.expand(self.seq)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, expanding only the symbols that cover it."""
        if self._ends is None:
            self._ends = np.cumsum(self.lengths[self.seq])
        first, last = int(self.starts[k]), int(self.starts[k] + self.n_ids[k])
        if first == last:
            return np.empty(0, np.uint32)
        i, j = np.searchsorted(self._ends, [first, last - 1], side="right")
        before = int(self._ends[i - 1]) if i else 0
        return self.expand(self.seq[i : j + 1])[first - before : last - before]


SHARD_SCHEMA = "part int, shard int, part_start long, n_ids long, n_docs int, data binary"


def write_shards(docs: DataFrame, path: str, vocabulary: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encodes texts, appends ``end_id`` to each document and writes Re-Pair shards in ascending order of ``id_col``.

    Documents are dealt out by ranges of ids, so that every task writes a run of
    the global order; a task holds one open shard at a time. There are as many
    tasks as TASK_BYTES of text need, and spark.sql.shuffle.partitions at least.

    Edge cases: a null or empty text is its end id alone; null ids come first;
    rows that share an id follow each other in the order of their texts; a
    document longer than a shard makes a shard of its own size; an empty table
    writes an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern, WRITER_PIECES)
        n_base = len(c.token_bytes)
        part = TaskContext.get().partitionId()
        open_docs: list = []
        open_ids: list[bytes] = []
        shard = begun = held = 0
        names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]

        def close() -> pa.RecordBatch:
            data = pack(open_docs, open_ids, n_base)
            row = [part, shard, begun, held, len(open_docs), data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
            for d, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                open_docs.append(d)
                open_ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= shard_ids:
                    yield close()
                    shard, begun, held, open_docs, open_ids = shard + 1, begun + held, 0, [], []
        if open_docs:
            yield close()

    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).repartitionByRange(n, "doc").sortWithinPartitions("doc", "text")
    dealt.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the shards alone: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and
    ``ids`` (binary, little-endian unsigned 32-bit).

    Only the totals of the writing tasks, as many as they were, come to the driver to place the shards.
    """
    bounded_batches(spark)
    shards = spark.read.parquet(path)
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, part_offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(raw)
                ids = s.all_ids().astype("<u4")
                out = [ids[a : a + n].tobytes() for a, n in zip(s.starts.tolist(), s.n_ids.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(s.starts + begun, pa.int64()), pa.array(s.n_ids, pa.int64()), pa.array(out, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    placed = shards.join(F.broadcast(offsets), "part").select((F.col("part_start") + F.col("part_offset")).alias("begun"), "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), path, P.path("byte_bpe_50k.json"), P.PATTERN)
    return read_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
