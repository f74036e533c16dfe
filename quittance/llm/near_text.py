"""Near-duplicates by shingle similarity: pairs meet under shared least shingles, and all their shingles decide.

Texts whose five-word shingles are four fifths alike differ in about ten of 64
SimHash bits, short ones in far more. With such a budget a trie over a whole
corpus prunes next to nothing, and under a deal it loses pairs. So documents are
dealt out by least shingles that they share, and no fingerprint stands between
a deal and the shingles. Where very many share a least shingle, because they
share a passage or are copies of one text, a first pass ties copies together
block by block, and what it leaves apart meets under its rarest shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.llm.common import bounded_batches, cut, shuffled
from quittance.llm.components import connected_components
from quittance.llm.simhash import _FOLD, SEED

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Least shingles, each under a hash of its own. Two texts of similarity s share none with probability (1 - s) ** KEYS.
KEYS = 6
#: Shingles counted at once, so that a block's table of them stays small.
_STEP = 2048
#: Documents of a block; fuller deals are compared block by block, with the rarest shingles for what is left.
DEAL_ROWS = 256
#: Counters of the table that tells rare shingles from frequent ones; it is broadcast, and its size is fixed.
COUNTERS = 1 << 18
#: Bytes of text in a block, on average; a deal of more is cut into blocks as one of too many documents is.
DEAL_BYTES = 4 << 20
#: Bits of the filter that keeps rows without a partner out of a shuffle; it is broadcast, 8 MB for any input.
FILTER_BITS = 1 << 26
#: Bytes of a text that are cut into words at once.
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_MIX = [np.uint64((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * i | 1) % (1 << 64)) for i in (1, 2, 3, 5, 7, 11)]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of the distinct word shingles; a shorter text is one shingle, one without words has none."""
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(n)], strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """A text's words in lists of about _PIECE bytes, so that a very long text is not held as words."""
    data = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + _PIECE)
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def _hashed(pieces: Iterator[list[bytes]], n: int) -> Iterator[np.ndarray]:
    """The shingles' hashes of the words in pieces, repeats included, in the order of the text."""
    carried: list[bytes] = []
    some = False
    for words in pieces:
        part = carried + words
        if len(part) < n:
            carried = part
            continue
        some = True
        yield shingle_hashes(part, n)
        carried = part[len(part) - n + 1 :]
    if carried and not some:
        yield shingle_hashes(carried, n)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashed(_pieces(text), n)]))


def _sketch(text: str | None, n: int) -> tuple[int, int, list[int] | None]:
    """(fingerprint, content hash, least shingles)."""
    content = xxhash.xxh64(seed=SEED)

    def read() -> Iterator[list[bytes]]:
        some = False
        for words in _pieces(text):
            if words:
                content.update(b" " + b" ".join(words) if some else b" ".join(words))
                some = True
            yield words

    ones, total = np.zeros(64, np.int64), 0
    least: list[tuple[int, int]] = []
    for h in _hashed(read(), n):
        total += len(h)
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        x = h ^ h >> np.uint64(31)
        at = [(x * m).argmin() for m in _MIX]
        own = [(int((x[i : i + 1] * m)[0]), int(h[i].view(np.int64))) for i, m in zip(at, _MIX, strict=True)]
        least = [min(a, b, key=lambda v: v[0]) for a, b in zip(least, own, strict=True)] if least else own
    fp = int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")
    return fp, content.intdigest(), [v for _, v in least] or None


class _Joined:
    """Union-find over the rows of a deal."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    value, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    again = n[at] > 1
    column = (np.cumsum(n > 1) - 1)[at[again]]
    row = row[again]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int((n > 1).sum()), _STEP):
        x, y = np.searchsorted(column, (begin, begin + _STEP))
        has = np.zeros((len(sets), _STEP), np.float32)
        has[row[x:y], column[x:y] - begin] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _links(keys: np.ndarray, at: int, own: np.ndarray, group: np.ndarray, texts: list[str], one: int, two: int, n_words: int, least: float) -> list[tuple[int, int]]:
    """Index pairs of one deal that are similar, as a spanning forest; between blocks ``one`` and ``two`` where they differ.

    Pairs of one ``group`` are joined already; pairs that share one of the
    ``keys`` before ``at`` are left to its deal.
    """
    new = np.tri(len(texts), k=-1, dtype=bool) & (group[:, None] != group[None, :])
    if one != two:
        new &= own[:, None] != own[None, :]
    for k in range(at):
        new &= keys[:, k, None] != keys[None, :, k]
    if not new.any():
        return []
    rows = np.flatnonzero(new.any(0) | new.any(1))
    sets = [shingle_set(texts[i], n_words) for i in rows.tolist()]
    same, size = _shared(sets), np.array([len(x) for x in sets])
    alike = new[np.ix_(rows, rows)] & (same >= least * (size[:, None] + size[None, :] - same))
    joined, out = _Joined(len(rows)), []
    for i, j in np.argwhere(alike).tolist():
        x, y = joined.root(i), joined.root(j)
        if x != y:
            joined.up[max(x, y)] = min(x, y)
            out.append((int(rows[i]), int(rows[j])))
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def rarest(h: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest of distinct shingles, so many that two sets of similarity ``least`` share one of them.

    Sets that alike have at least ceil(least * n) shingles in common, for the
    size n of either. So in any order that all sets follow, both have a common
    one among their first n - ceil(least * n) + 1. The order is that of the
    counters, then of the hashes: a counter that several shingles share makes it
    a worse order, never a wrong one. A shingle alone in its counter is in no
    other set and left out.
    """
    n = counts[_bucket(h)]
    first = np.lexsort((h, n))[: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]
    return h[first[n[first] > 1]]


def _only(rows: DataFrame, few: DataFrame, *on: str) -> DataFrame:
    """Rows that may have a partner in ``few`` on the columns ``on``, before they are shuffled for the join.

    The partners' hashes set bits of FILTER_BITS, which are broadcast. A row
    whose bit is not set has no partner. The fuller the bits, the more rows
    without a partner pass; the join decides, so results do not depend on it.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS)) + 1
    at = few.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place"))
    bits = at.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1
    return rows.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "bucket").where(set_).select(*rows.columns)


def _blocks(n: Column, size: Column, deal_rows: int) -> Column:
    """Into how many blocks a deal of ``n`` documents and ``size`` bytes is cut."""
    return F.greatest(F.ceil(n / deal_rows), F.ceil(size / DEAL_BYTES)).cast("int")


def _dealt(nodes: DataFrame, deal_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dealt, full, some): the first pass over nodes (rep, th, bytes, keys) that share a least shingle, the members of full deals, and of all.

    A deal of up to ``deal_rows`` documents and DEAL_BYTES is one block, in
    which all pairs meet. A fuller one is cut into blocks, its least member in
    each of them (of those that are not much longer than the others): as many
    rows as the deal has, and one for each block. A deal that has the members of
    an earlier one is left out, so documents that share all their least
    shingles, as copies do, move once and not for each of them. ``keys`` hold
    the least shingles of the deals that are not full, by which a pair is known
    to have met, and the node's own number for the others.
    """
    level = nodes.select("rep", "th", "bytes", F.posexplode("keys").alias("at", "value"))
    level = level.select("rep", "th", "bytes", F.struct("at", "value").alias("deal"))
    counts = level.groupBy("deal").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes").alias("size"),
        F.struct(F.bit_xor(F.xxhash64("rep", "th")), F.bit_xor(F.xxhash64(F.lit(1), "th", "rep")), F.count(F.lit(1))).alias("members"),
    )
    counts = counts.where("n > 1").withColumn("blocks", _blocks(F.col("n"), F.col("size"), deal_rows)).withColumn("usual", 4 * F.col("size") / F.col("n"))
    met = level.join(shuffled(counts), "deal").groupBy("rep", "th").agg(
        F.first("bytes").alias("bytes"), F.collect_list(F.struct("deal.at", "deal.value", "blocks", "usual", "members")).alias("deals")
    )

    def key(k: object) -> object:
        whole = F.filter("deals", lambda d: (d["at"] == k) & (d["blocks"] == 1))
        return F.coalesce(F.get(whole, F.lit(0))["value"], F.col("rep"))

    again = lambda d: F.exists("deals", lambda e: (e["at"] < d["at"]) & (e["members"] == d["members"]))
    met = met.withColumn("keys", F.transform(F.sequence(F.lit(0), F.lit(KEYS - 1)), key)).withColumn("deals", F.filter("deals", lambda d: ~again(d)))
    some = cut(met.withColumn("deals", F.transform("deals", lambda d: d.dropFields("members"))))
    met = some.select("rep", "th", "bytes", "keys", F.explode("deals").alias("d")).select("d.*", "rep", "th", "bytes", "keys")
    columns = ["at", "value", "b", "rep", "th", "keys"]
    small = met.where(F.col("blocks") == 1).withColumn("b", F.lit(0))
    full = met.where(F.col("blocks") > 1).withColumn("b", F.pmod(F.xxhash64("rep", "at"), "blocks").cast("int"))
    least = F.min(F.struct((F.col("bytes") > F.col("usual")).alias("long"), "rep", "th", "b", "keys")).alias("p")
    least = full.groupBy("at", "value").agg(least, F.max("blocks").alias("blocks"))
    least = least.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("b") != F.col("p.b"))
    least = least.select("at", "value", "b", "p.rep", "p.th", "p.keys")
    dealt = small.select(columns).unionByName(full.select(columns)).unionByName(least)
    return dealt.select("at", "value", F.col("b").alias("b1"), F.col("b").alias("b2"), F.col("b").alias("own"), "rep", "th", "keys", F.col("rep").alias("group")), full, some.select("rep", "th")


def _left_apart(full: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, th, bytes, keys, group): members of full deals that hold more than one group."""
    deal = F.struct("at", "value").alias("deal")
    named = full.join(shuffled(groups), full["rep"] == groups["node"], "left").select(deal, "rep", "th", "bytes", "keys", F.coalesce("component", "rep").alias("group"))
    mixed = named.groupBy("deal").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select(F.struct("deal").alias("k"))
    first = [F.first(c).alias(c) for c in ("bytes", "keys", "group")]
    return named.withColumn("k", F.struct("deal")).join(shuffled(mixed), "k", "left_semi").groupBy("rep", "th").agg(*first)


def _across(members: DataFrame, deal_rows: int, size: Column | None = None) -> DataFrame:
    """The second pass: members (value, rep, th, group) dealt so that all pairs of a value meet that differ in group.

    The largest group of a value is not compared with itself, so a large group
    of copies costs its size times that of the rest. A fuller deal (by rows, or
    by bytes, of which a member has ``size``) is cut into blocks: those of the
    rest meet each other and those of the largest group.
    """
    by_group = members.groupBy("value", "group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if size is None else size).alias("size"))
    deals = by_group.groupBy("value").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "group", "size")).alias("top"))
    deals = deals.where(F.col("n") > F.col("top.n"))
    full = _blocks(F.col("n"), F.col("size"), deal_rows) > 1
    deals = deals.select(
        F.struct("value").alias("k"),
        F.col("top.group").alias("largest"),
        F.when(full, _blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"), deal_rows)).otherwise(1).alias("rest"),
        F.when(full, _blocks(F.col("top.n"), F.col("top.size"), deal_rows)).otherwise(0).alias("large"),
    )
    deals = cut(deals)
    met = _only(members, deals.select("k.value"), "value").select(F.struct("value").alias("k"), "rep", "th", "group").join(shuffled(deals), "k")
    within = (F.col("group") == F.col("largest")) & (F.col("large") > 0)
    own = F.when(within, F.col("rest") + F.pmod(F.xxhash64("rep"), "large")).otherwise(F.pmod(F.xxhash64("rep"), "rest")).cast("int")
    last = F.when(within, F.col("rest")).otherwise(F.col("rest") + F.col("large")) - 1
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.select(F.lit(KEYS).alias("at"), "k.value", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "rep", "th")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, th, bytes)"""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    return rows.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, th, bytes, fp, content, keys) for every row: its SimHash fingerprint, a hash of its words, its least shingles."""
    bounded_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [_sketch(t.as_py(), shingle_words) for t in batch.column(1)]
            fp, content = (np.array([x[i] for x in s], np.uint64).view(np.int64) for i in (0, 1))
            keys = pa.array([x[2] for x in s], pa.list_(pa.int64()))
            made = [batch.column(0), *batch.columns[2:], pa.array(fp), pa.array(content), keys]
            yield pa.RecordBatch.from_arrays(made, names=["doc", "th", "bytes", "fp", "content", "keys"])

    return cut(_rows(docs, id_col, text_col).mapInArrow(sketch, "doc long, th long, bytes long, fp long, content long, keys array<long>"))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, deal_rows: int = DEAL_ROWS, known: DataFrame | None = None,
    sketched: DataFrame | None = None,
) -> DataFrame:
    """(doc, component_id) for every row: documents joined by links of Jaccard similarity ``similarity`` or more.

    Texts of the same words fall together first, under the smallest id. The
    others meet under least shingles that they share (two of similarity 0.8
    share none of KEYS with probability 6e-5); there their distinct shingles
    are counted against each other and decide exactly. A deal of more than
    ``deal_rows`` or DEAL_BYTES is not compared pair by pair: its blocks are, each with the
    deal's least member, which ties copies of a text together. Where a full deal
    still holds several groups, its members meet once more, under their rarest
    shingles, of which similar texts share one for certain (``rarest``); there
    pairs of different groups are compared. So no pair of a full deal is lost,
    and neither a shared passage nor a large group of copies costs the square of
    its size. A deal gives a spanning forest and never all pairs. Only texts
    that share a deal with another are moved, and some others where the filter
    (``_only``) is crowded. What is broadcast has one size for any input: that
    filter, and a table of COUNTERS counts, which comes to the driver as well.

    ``known`` has links (a, b) between ids that were found elsewhere, the smallest
    id of a group on one side; they join groups like the others. ``sketched`` has
    the ``sketches`` of the same documents, where they are made already.

    Edge cases: null and blank texts are alike; a very long text is read in
    pieces for its sketch, and where it is compared a task holds it and its
    shingles (8 bytes each), beside blocks of DEAL_BYTES on average; a text of
    fewer words than a shingle is one shingle; repeated rows stay and share a component; rows with
    a null id take the component of their words, null where no other id has
    them; an empty table gives an empty table; other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    own = sketches(docs, id_col, text_col, shingle_words) if sketched is None else sketched
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "th", "bytes")))
    nodes = own.groupBy("fp", "content").agg(first.alias("r"), F.first("keys").alias("keys"))
    nodes = cut(nodes.select("fp", "content", "keys", F.col("r.doc").alias("rep"), "r.th", "r.bytes"))
    dealt, full, met = _dealt(nodes.where(F.col("rep").isNotNull() & F.col("keys").isNotNull()).select("rep", "th", "bytes", "keys"), deal_rows)
    key = ["at", "value", "b1", "b2"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                keys, own, group = (np.array([r[k] for r in held], np.int64) for k in (6, 4, 7))
                found = _links(keys, held[0][0], own, group, [r[8] for r in held], held[0][2], held[0][3], shingle_words, similarity)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([held[i][7] for i, _ in found]), pa.array([held[j][7] for _, j in found])], names=["a", "b"])
            held.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:4] != row[:4]:
                    yield from close()
                held.append(row)
        yield from close()

    def links(met: DataFrame, texts: DataFrame) -> DataFrame:
        met = shuffled(met).join(texts, ["rep", "th"]).select(*key, "own", "rep", "keys", "group", "text")
        return met.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a long, b long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                n += np.bincount(_bucket(shingle_set(t.as_py(), shingle_words)), minlength=COUNTERS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    texts = rows.select(F.col("doc").alias("rep"), "th", "text")
    linked = links(dealt, _only(texts, met, "rep", "th"))
    found = connected_components(linked if known is None else linked.unionByName(known))
    apart = cut(_left_apart(full, found))
    group = F.coalesce("component", "rep")
    grouped = nodes.join(shuffled(found), nodes["rep"] == found["node"], "left").select("fp", "content", group.alias("group"))
    if not apart.isEmpty():
        some = cut(_only(texts, apart, "rep", "th").join(shuffled(apart), ["rep", "th"]))
        counted = some.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(COUNTERS, np.int64)
        counts[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [rarest(shingle_set(t.as_py(), shingle_words), counts, similarity).view(np.int64) for t in batch.column(4)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.list_(pa.int64()))], names=["rep", "th", "bytes", "group", "rare"])

        members = cut(some.select("rep", "th", "bytes", "group", "text").mapInArrow(rare, "rep long, th long, bytes long, group long, rare array<long>"))
        members = members.select("rep", "th", "bytes", "group", F.explode("rare").alias("value"))
        more = connected_components(links(_across(members, deal_rows, F.col("bytes")), some))
        grouped = grouped.join(shuffled(more), grouped["group"] == more["node"], "left").select("fp", "content", F.coalesce("component", "group").alias("group"))
    component = grouped.select(F.struct("fp", "content").alias("k"), F.col("group").alias("component_id"))
    return own.withColumn("k", F.struct("fp", "content")).join(shuffled(component), "k").select("doc", "component_id")
