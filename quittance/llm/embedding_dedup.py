"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm.common import bounded_batches, cut, table
from quittance.llm.components import connected_components
from quittance.llm.simhash import _roots

#: Vectors of the sample that the rotation is learned from; all vectors are indexed.
FIT_VECTORS = 10_000
#: Rounds of iterative quantisation.
FIT_ROUNDS = 40
#: Bits of a table's part of the code: the least, the most, and the vectors of a label that should meet in an entry.
LEAST_BITS = 8
MOST_BITS = 24
ENTRY = 64
#: Share of links, all taken to be as far apart as may be, that shall meet in some table.
RECALL = 0.96
#: Vectors of a block; a fuller table entry is compared block against block.
BLOCK = 768


def fit_itq(x: np.ndarray, bits: int, rounds: int = FIT_ROUNDS, seed: int = 7) -> np.ndarray:
    """The projection whose signs are the bits.

    It is PCA to ``bits`` directions (repeated under other rotations where there
    are fewer dimensions) times the rotation that brings the projections closest
    to their signs, which balances the bits. The PCA is about the origin, not
    the mean: cosines are angles at the origin, and where most vectors are close
    to each other, directions from their mean would be noise and part them.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    _, vec = np.linalg.eigh(x.T @ x / len(x) + 1e-9 * np.eye(d))
    out = []
    while sum(p.shape[1] for p in out) < bits:
        k = min(d, bits - sum(p.shape[1] for p in out))
        pca = vec[:, ::-1][:, :k]
        v = x @ pca
        r, _ = np.linalg.qr(rng.standard_normal((k, k)))
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, wt = np.linalg.svd(b.T @ v)
            r = (u @ wt).T
        out.append(pca @ r)
    return np.concatenate(out, 1)


def tables(n: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits in each) for labels of ``n`` vectors at most.

    Bits grow with the logarithm of the vectors, so entries do not grow; tables
    follow from the odds that all bits of one agree for a pair at ``least``.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, n) / ENTRY)))))
    agree = (1 - np.arccos(min(1.0, max(-1.0, least))) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(agree, 1 - 1e-9))))), bits


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows in double precision, from the precision in which they came."""
    return np.frombuffer(b"".join(raw), f"<f{len(raw[0]) // dim}").reshape(len(raw), dim).astype(np.float64)


def _usable(vector: str, label: str) -> object:
    e = F.col(vector)
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return e.isNotNull() & F.col(label).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda v: v != 0)


def _compare(rows: dict[str, np.ndarray], raw: list[bytes], least: float) -> pa.RecordBatch:
    """The links of one table entry or pair of blocks, as (rep, root, n): with how many vectors each links here, and the least
    one it is joined with here. A pair counts in the first table in which its codes meet."""
    dim = int(rows["dim"][0])
    x = _matrix(raw, dim)
    norm = np.sqrt((x * x).sum(1))
    ids, subs, m, t = rows["rep"], rows["subs"], rows["m"], int(rows["t"][0])
    one, two = int(rows["b1"][0]), int(rows["b2"][0])
    left = np.flatnonzero(rows["own"] == one)
    right = left if one == two else np.flatnonzero(rows["own"] == two)
    links = x[left] @ x[right].T / np.outer(norm[left], norm[right]) >= least
    links &= ids[left][:, None] != ids[right][None, :]
    for earlier in range(t):
        links &= subs[left, earlier][:, None] != subs[right, earlier][None, :]
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, left, links @ m[right])
    if one != two:
        np.add.at(n, right, links.T @ m[left])
    i, j = np.nonzero(links)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = ids[order][_roots(len(ids), iter([(rank[left[i]], rank[right[j]])]))][rank]
    own = n > 0
    k1, k2 = rows["k1"][own], rows["k2"][own]
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ids[own]), pa.array(root[own]), pa.array(n[own])], names=["k1", "k2", "rep", "root", "n"])


def _sample(usable: DataFrame, n: int, fit_vectors: int) -> list[np.ndarray]:
    """About ``fit_vectors`` vectors, ``fit_vectors`` at most, the first in hash order; a task sends only its part of them."""
    share = min(1 << 62, (fit_vectors + 4 * int(fit_vectors**0.5)) * (1 << 62) // n)
    few = usable.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 62)) < share) if share < 1 << 62 else usable
    lists = few.orderBy(F.xxhash64("vec"), "vec").limit(fit_vectors).select("e").toArrow().column("e")
    return [c.values.to_numpy(zero_copy_only=False).astype(np.float64) for c in lists]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, fit_vectors: int = FIT_VECTORS
) -> DataFrame:
    """Links vectors of one label whose cosine is at least ``least``.

    Copies of a vector in a label fall together first, with their number. A
    rotation learned from a bounded sample (``fit_vectors`` at most, the first in
    hash order) turns every vector into a balanced code, and each Hamming table
    is keyed by label and its own bits of the code; ``tables`` gives their number
    and bits from the size of the largest label. Vectors that meet in an entry
    are compared by their cosine in double precision, so no link is false and
    nothing that meets is left out. Entries are counted first; an entry of more
    than BLOCK vectors is dealt into blocks that are compared pair by pair in
    tasks of their own, so no task holds more than two blocks. Tasks give each
    vector's number of links and a spanning forest, never pairs.

    Returns (vec, n_links, component_id) for every row.

    Edge cases: vectors that are null, zero or hold null or non-finite
    components, and rows without a label or an id, link with nothing (their
    component is their own id); vectors of other lengths are compared with
    their like; rows that repeat id, label and vector count once in links and
    are all returned; rows that share an id do not link with each other; an
    empty table gives an empty table; other columns are not looked at.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("e"))
    kind = "<f4" if dict(rows.dtypes)["e"] == "array<float>" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("e", F.col("e").cast("array<double>"))
    usable = rows.where(F.col("vec").isNotNull() & _usable("e", "label"))
    total, most = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if not total:
        return rows.select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    sample = _sample(usable, total, fit_vectors) or _sample(usable, 1, fit_vectors)
    dims = [len(v) for v in sample]
    d = max(set(dims), key=lambda k: (dims.count(k), k))
    fit = np.array([v for v in sample if len(v) == d])
    n_tables, bits = tables(most, least)
    projection = fit_itq(fit / np.linalg.norm(fit, axis=1, keepdims=True), n_tables * bits)
    powers = 1 << np.arange(bits)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            x = np.zeros((len(lists), d))
            for i, v in enumerate(lists):
                x[i, : min(d, len(v))] = v[:d]
            n = np.linalg.norm(x, axis=1, keepdims=True)
            signs = x / np.where(n > 0, n, 1) @ projection >= 0
            subs = (signs.reshape(len(lists), n_tables, bits) @ powers).astype(np.int32)
            raw = [np.array(v, kind).tobytes() for v in lists]
            made = [pa.array([len(v) for v in lists], pa.int32()), pa.array(list(subs), pa.list_(pa.int32())), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["vec", "label", "dim", "subs", "e"])

    coded = usable.mapInArrow(code, "vec long, label string, dim int, subs array<int>, e binary")
    # an id that has several vectors does not link with itself, so each of them stays a node of its own
    several = coded.select("vec", F.xxhash64("label", "e").alias("h")).distinct().groupBy("vec").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alone = F.when(F.col("n").isNotNull(), F.col("vec"))
    same = (F.col("label"), F.col("dim"), F.col("e"), alone)
    coded = cut(coded.join(several, "vec", "left").withColumns({"k1": F.xxhash64(*same), "k2": F.xxhash64(F.lit(1), *same)}).drop("n"))
    nodes = cut(
        coded.groupBy("k1", "k2").agg(
            F.count_distinct("vec").alias("m"), F.min("vec").alias("rep"), *[F.first(c).alias(c) for c in ("label", "dim", "subs", "e")]
        )
    )
    entries = nodes.select("*", F.posexplode("subs").alias("t", "sub")).withColumn("entry", F.struct("label", "dim", "t", "sub")).drop("t", "sub")
    counts = entries.groupBy(*[F.col(f"entry.{c}").alias(f"c_{c}") for c in ("label", "dim", "t", "sub")]).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where("n > 1").select(
        F.struct(*[F.col(f"c_{c}").alias(c) for c in ("label", "dim", "t", "sub")]).alias("entry"), F.ceil(F.col("n") / BLOCK).cast("int").alias("k")
    )
    own = F.pmod(F.xxhash64("k1", "k2"), F.col("k")).cast("int")
    dealt = (
        entries.drop("label", "dim").join(counts, "entry")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("entry.*", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "k1", "k2", "rep", "m", "subs", "e")
    )
    key = ["label", "dim", "t", "sub", "b1", "b2"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(t: pa.Table) -> list[tuple[int, int]]:
            new = np.zeros(len(t), bool)
            new[0] = True
            for c in key:
                col = t.column(c).combine_chunks()
                col = col.dictionary_encode().indices if pa.types.is_string(col.type) else col
                v = col.to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            at = [*np.flatnonzero(new).tolist(), len(t)]
            return list(zip(at, at[1:], strict=False))

        def run(t: pa.Table, upto: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            names = ["dim", "t", "b1", "b2", "own", "k1", "k2", "rep", "m"]
            cols = {n: t.column(n).to_numpy() for n in names}
            cols["subs"] = t.column("subs").combine_chunks().flatten().to_numpy().reshape(len(t), n_tables)
            raw = t.column("e").to_pylist()
            for a, b in upto:
                if b - a > 1:
                    out = _compare({n: c[a:b] for n, c in cols.items()}, raw[a:b], least)
                    if out.num_rows:
                        yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            g = groups(held)
            if len(g) > 1:
                yield from run(held, g[:-1])
                held = held.slice(g[-1][0])
        if held is not None and len(held):
            yield from run(held, groups(held))

    found = cut(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "k1 long, k2 long, rep long, root long, n long"))
    n_links = found.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    component = connected_components(found, "rep", "root")
    judged = (
        nodes.select("k1", "k2", "m", "rep")
        .join(n_links, ["k1", "k2"], "left")
        .join(component, F.col("rep") == F.col("node"), "left")
        .select(F.struct("k1", "k2").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    members = coded.select("vec", "k1", "k2").distinct().select("vec", F.struct("k1", "k2").alias("k"))
    by_vec = members.join(judged, "k").groupBy("vec").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    by_vec = by_vec.select(F.struct("vec").alias("v"), "n_links", "component_id")
    return (
        rows.select("vec", F.struct("vec").alias("v"))
        .join(by_vec, "v", "left")
        .select("vec", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec").alias("component_id"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("vec").alias("vec_id"), "n_links", "component_id", (F.col("vec") == F.col("component_id")).alias("kept"))
