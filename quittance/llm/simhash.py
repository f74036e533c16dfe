"""SimHash near-dedup by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm.common import bounded_batches, cut, shuffled, table
from quittance.llm.components import connected_components

#: Words of a shingle and differing bits of a link, unless a caller says otherwise.
SHINGLE_WORDS = 5
MAX_BITS = 3
#: Seed of the shingle hashes.
SEED = 42
#: Fingerprints under one node of the tries' top that a task joins at once; fuller nodes are opened further.
NODE_ROWS = 1000
#: How often a fuller node is opened.
DEPTH = 3
#: Node pairs that a traversal holds at once.
FRONTIER = 1 << 20
#: Shingles hashed at once, so that a very long text is not held as shingles.
_STEP = 1 << 16

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle_words: int) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        part = words[i : i + _STEP + shingle_words - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(shingle_words)], strict=False)) if len(words) >= shingle_words else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, fp): the id and the fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, fp long")


def _blocks(mask: int, parts: int) -> list[int]:
    """The unset bits of a mask in ``parts`` runs, each joined to the mask."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fixed(col: Column, masks: list[int]) -> Column:
    """A row for each mask, with the bits of the fingerprint under it."""
    return F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), col.bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in masks]))


def _trie_pairs(bucket: np.ndarray, fp: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one bucket whose fingerprints differ in at most ``budget`` bits.

    ``bucket`` and ``fp`` are sorted together; the fingerprints of a bucket are
    a trie whose nodes are runs of rows. All buckets' root pairs go down
    together, four bits at a time: the children of a pair of nodes are paired,
    the bits in which they differ are added up, and pairs over the budget are
    pruned. A frontier that grows too wide is traversed in parts.
    """
    n = len(fp)
    # level k: the node of each row after 4 k bits, and the first row of each node
    first: list[np.ndarray] = []
    node: list[np.ndarray] = []
    for level in range(17):
        prefix = fp >> np.uint64(64 - 4 * level) if level else np.zeros(n, np.uint64)
        new = np.ones(n, bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (prefix[1:] != prefix[:-1])
        first.append(np.flatnonzero(new))
        node.append(np.cumsum(new) - 1)
    ones = np.array([bin(x).count("1") for x in range(16)], np.int8)
    roots = np.arange(len(first[0]))
    stack = [(0, roots, roots, np.zeros(len(roots), np.int8))]
    while stack:
        level, a, b, err = stack.pop()
        if level == 16:
            yield first[16][a], first[16][b]
            continue
        below = level + 1
        begin = node[below][first[level]]
        size = np.diff(np.append(begin, len(first[below])))
        nibble = (fp[first[below]] >> np.uint64(60 - 4 * level) & np.uint64(15)).astype(np.int64)
        made = size[a] * size[b]
        ends = np.cumsum(made)
        done = 0
        parts = []
        while done < len(a):
            base = int(ends[done - 1]) if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, base + FRONTIER, side="right")))
            parts.append((done, upto))
            done = upto
        if len(parts) > 1:
            stack += [(level, a[x:y], b[x:y], err[x:y]) for x, y in parts]
            continue
        which = np.repeat(np.arange(len(a)), made)
        at = np.arange(int(made.sum())) - np.repeat(ends - made, made)
        i = begin[a[which]] + at // size[b[which]]
        j = begin[b[which]] + at % size[b[which]]
        e = err[which] + ones[nibble[i] ^ nibble[j]]
        ok = (e <= budget) & ((a[which] != b[which]) | (i < j if level == 15 else i <= j))
        if ok.any():
            stack.append((below, i[ok], j[ok], e[ok]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each of n is joined with through the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            differ = x != y
            if not differ.any():
                break
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def trie_links(nodes: DataFrame, budget: int, node_rows: int = NODE_ROWS, depth: int = DEPTH) -> DataFrame:
    """Links (a, b) that join all of ``nodes`` (rep, fp; fingerprints distinct) within ``budget`` bits.

    The error budget is spent on budget + 1 runs of bits at most; so two
    fingerprints within it agree in one run whole. One trie for each run has
    that run on top, and below a node of that top only the budget is left to
    spend: the nodes are the keys by which Spark deals the self-join out. A node
    with more than ``node_rows`` fingerprints is opened by the same argument on
    the bits that are left, up to ``depth`` times; after that few bits are left,
    and so few distinct fingerprints. Under a node, the trie is joined with
    itself by traversal, and the links found are thinned to a spanning forest
    that joins the same fingerprints.
    """
    masks = [0]
    level = nodes.select("rep", "fp").withColumn("mask", F.lit(0).cast("long"))
    chosen = None
    for k in range(depth):
        finer = {m: _blocks(m, budget + 1) for m in masks}
        cases = None
        for m, fine in finer.items():
            made = F.array(*[F.lit(_signed(x)) for x in fine])
            cases = F.when(F.col("mask") == _signed(m), made) if cases is None else cases.when(F.col("mask") == _signed(m), made)
        masks = sorted({x for fine in finer.values() for x in fine})
        level = level.withColumn("mask", F.explode(cases)).withColumn("bucket", F.struct("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")))
        counts = level.groupBy(F.col("bucket.mask").alias("m"), F.col("bucket.bits").alias("t")).agg(F.count_distinct("fp").alias("n") if k else F.count(F.lit(1)).alias("n"))
        counts = counts.where("n > 1").select(F.struct(F.col("m").alias("mask"), F.col("t").alias("bits")).alias("bucket"), "n")
        level = level.join(shuffled(counts), "bucket")
        now = level if k == depth - 1 else level.where(F.col("n") <= node_rows)
        part = now.select("bucket.mask", "bucket.bits", "fp", "rep")
        chosen = part if chosen is None else chosen.unionByName(part)
        level = level.where(F.col("n") > node_rows).select("rep", "fp", "mask").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def join(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            fp = rows[:, 2].copy().view(np.uint64)
            order = np.lexsort((fp, np.cumsum(new)))  # signed order is not bit order
            bucket, fp, rep = np.cumsum(new)[order], fp[order], rows[order, 3]
            label = _roots(len(fp), _trie_pairs(bucket, fp, budget))
            own = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(rep[label[own]]), pa.array(rep[own])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            if not len(rows):
                continue
            held.append(rows)
            size += len(rows)
            if size < 20_000:
                continue
            all_rows = np.concatenate(held)
            last = int(np.flatnonzero((all_rows[:, :2] != all_rows[-1, :2]).any(1))[-1]) + 1 if (all_rows[0, :2] != all_rows[-1, :2]).any() else 0
            if last:
                yield join(all_rows[:last])
            held, size = [all_rows[last:]], len(all_rows) - last
        if size:
            yield join(np.concatenate(held))

    dealt = chosen.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc, fp, component_id) for every row: documents whose fingerprints link, directly or through others.

    Where ``docs`` have no column ``text_col``, their fingerprints are made already, in ``fp``.

    Equal fingerprints fall together first; only distinct ones are joined, so a
    group of copies costs one row. Components come from the links between
    distinct fingerprints, each under the smallest id that has it.

    Edge cases: a null or blank text has fingerprint 0 and links like any other;
    a text of fewer words than a shingle is one shingle; repeated rows stay and
    share a component; rows with a null id take the component of their
    fingerprint, null where no other id has it, and link nothing; an empty table
    gives an empty table; other columns are not looked at.
    """
    if text_col not in docs.columns:
        own = docs.select(F.col(id_col).cast("long").alias("doc"), "fp")
    else:
        own = cut(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = cut(own.groupBy("fp").agg(F.min("doc").alias("rep")))
    links = trie_links(nodes.where(F.col("rep").isNotNull()), max_bits)
    found = connected_components(links)
    component = nodes.join(shuffled(found), nodes["rep"] == found["node"], "left").select(
        F.struct(nodes["fp"]).alias("k"), F.coalesce("component", "rep").alias("component_id")
    )
    return own.withColumn("k", F.struct("fp")).join(shuffled(component), "k").select("doc", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
