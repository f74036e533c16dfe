"""Exact top-k search by inner product: columnar branch-and-bound over blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.llm.common import bounded_batches, cut, table

#: Components of one step of the search.
STEP = 8
#: Candidates of a block: so many at most, and not fewer than LEAST_BLOCK while there are fewer blocks than tasks.
MOST_BLOCK = 131_072
LEAST_BLOCK = 512
#: Queries that meet a block in one task; more are dealt to further tasks.
QUERY_PART = 262_144
#: Largest whole numbers that a float of 4 and of 8 bytes holds exactly.
EXACT4, EXACT8 = 2.0**24, 2.0**53


class Block:
    """Candidates in vertical layout: for each step a matrix of its components by candidates, and the mass that is left after it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        dims = vectors.shape[1]
        wide = vectors[order].astype(np.float64)
        # components of most mass first, so that little is left early
        self.by_mass = np.argsort(-(wide * wide).sum(0), kind="stable")
        wide = wide[:, self.by_mass]
        self.steps = [slice(i, min(i + STEP, dims)) for i in range(0, dims, STEP)]
        square = np.stack([(wide[:, s] ** 2).sum(1) for s in self.steps]) if self.steps else np.zeros((0, len(ids)))
        # norm of what is left before each step; rounded up, so a bound never falls below the truth
        self.left = np.sqrt(np.cumsum(square[::-1], axis=0)[::-1]) * (1 + 1e-12)
        self.most = float(self.left[0].max()) if len(self.steps) and len(ids) else 0.0
        self.columns = {}
        #: Candidates times steps that searches have scored so far.
        self.scored = 0
        self._vectors = vectors[order][:, self.by_mass]

    def _column(self, kind: type, step: int) -> np.ndarray:
        if (kind, step) not in self.columns:
            self.columns[kind, step] = np.ascontiguousarray(self._vectors[:, self.steps[step]].T.astype(kind))
        return self.columns[kind, step]

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates, ties to the smaller id, without those of the query's own id.

        Scores are whole numbers: floats serve while every partial sum, which the
        product of the norms bounds, is one that they hold exactly.
        """
        q = query[self.by_mass]
        wide = q.astype(np.float64)
        ahead = np.sqrt(np.array([(wide[s.start :] ** 2).sum() for s in self.steps] + [0.0])) * (1 + 1e-12)
        bound = ahead[0] * self.most
        kind = np.float32 if bound < EXACT4 else np.float64 if bound < EXACT8 else np.int64
        q = q.astype(kind)
        alive: np.ndarray | None = None  # None while all candidates are
        own = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right")
        score = np.zeros(len(self.ids), kind)
        if own[0] < own[1]:
            alive = np.r_[0 : own[0], own[1] : len(self.ids)]
            score = score[alive]
        for i, step in enumerate(self.steps):
            columns = self._column(kind, i)
            self.scored += len(score)
            score = score + q[step] @ (columns if alive is None else columns[:, alive])
            if len(score) > k and i + 1 < len(self.steps):
                slack = ahead[i + 1] * (self.left[i + 1] if alive is None else self.left[i + 1][alive])
                sure = score - slack
                least = np.partition(sure, len(sure) - k)[len(sure) - k]
                # the bounds are rounded sums of terms up to ``bound``: a hair of it keeps what might still reach the least
                keep = score + slack >= least - 1e-12 * bound
                if np.count_nonzero(keep) <= len(keep) // 2:
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    score = score[keep]
        ids = self.ids if alive is None else self.ids[alive]
        if len(score) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= least
            ids, score = ids[keep], score[keep]
        order = np.lexsort((ids, -score.astype(np.int64)))[:k]
        return ids[order], score[order].astype(np.int64)


def _finite(vector: str) -> Column:
    e = F.col(vector)
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return e.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, dim, v): distinct rows with ``floor(scale * x)`` packed in 2 bytes a component where all fit, else in 8.

    Vectors that are null or hold null or non-finite components are left out,
    and so are those whose scores might not fit a long: with a component beyond
    the root of 2^62 over the dimensions.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            at = np.asarray(lists.offsets)
            flat = np.floor(scale * np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64))
            ids, dims, packed = [], [], []
            for i, name in enumerate(batch.column("id").to_pylist()):
                v = flat[at[i] : at[i + 1]]
                most = np.abs(v).max(initial=0.0)
                if most * most * max(1, len(v)) <= 2.0**62:
                    ids.append(name)
                    dims.append(len(v))
                    packed.append(v.astype("<i2" if most < 32_768 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["id", "dim", "v"])

    usable = rows.where(F.col("id").isNotNull() & _finite("e"))
    return usable.mapInArrow(pack, "id long, dim int, v binary").distinct()


def _unpack(raw: list[bytes], dim: int) -> np.ndarray:
    wide = any(len(v) == 8 * dim for v in raw)
    if not wide:
        return np.frombuffer(b"".join(raw), "<i2").reshape(len(raw), dim)
    return np.stack([np.frombuffer(v, "<i8" if len(v) == 8 * dim else "<i2").astype(np.int64) for v in raw])


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each block for each query that meets it.

    Rows come sorted by block, its candidates before its queries: the candidates
    are gathered, a bounded number, and the queries pass one batch after another.
    """
    at: tuple | None = None
    held: list[tuple[np.ndarray, list[bytes]]] = []
    block: Block | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "part", "block", "kind", "id")}
        raw = batch.column("v").to_pylist()
        keys = np.stack([cols["dim"], cols["part"], cols["block"], cols["kind"]])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(edges, edges[1:], strict=False):
            dim, part, number, kind = (int(x) for x in keys[:, a])
            if (dim, part, number) != at:
                at, held, block = (dim, part, number), [], None
            if kind == 0:
                held.append((cols["id"][a:b], raw[a:b]))
                continue
            if block is None:
                if not held:
                    continue
                block = Block(np.concatenate([x for x, _ in held]), _unpack([v for _, vs in held for v in vs], dim))
                held = []
            for i, q in zip(range(a, b), _unpack(raw[a:b], dim), strict=True):
                ids, scores = block.best(int(cols["id"][i]), q, k)
                found.append((np.full(len(ids), i), ids, scores))
        if found:
            of, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(of), batch.column("dim").take(of), batch.column("v").take(of), pa.array(ids), pa.array(scores)], names=["query_id", "dim", "q", "vec_id", "score"]
            )


def top_k(
    vectors: DataFrame,
    queries: Column | None = None,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    most_block: int = MOST_BLOCK,
    query_part: int = QUERY_PART,
) -> DataFrame:
    """The k rows of highest inner product for every query, over ``floor(scale * x)`` in whole numbers.

    ``queries`` is a condition on ``id`` that picks the queries among the rows
    (every row without one); candidates are all rows but those of the query's
    own id. Candidates are dealt by hash into blocks of ``most_block`` at most
    on average, each kept by its task in vertical layout, and every query is sent to every
    block: the queries are what is copied, once for each block. In a block,
    scores grow by a few components at a time over all candidates still alive;
    what the rest of a vector can add is at most the product of the remaining
    norms, so a candidate goes as soon as that cannot lift it to the k-th score
    that is sure by then, and the others are compacted. The k best of the blocks
    then meet by query. Nothing is estimated: the result is exact.

    Returns (query_id, rank, vec_id, score), ties to the smaller id.

    Edge cases: vectors that are null or hold null or non-finite components,
    rows without an id, and vectors whose scores might not fit a long take no
    part; vectors of other lengths meet their like only, those of length zero
    score zero; rows that repeat id and vector count once; rows that share an id
    are queries of their own and never candidates of each other; fewer than k
    candidates give as many rows; an empty table gives an empty table; other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = cut(quantise(vectors, id_col, vector_col, scale))
    asked = rows.where(queries) if queries is not None else rows
    n, m = rows.count(), asked.count()
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-n // most_block), min(tasks, n // LEAST_BLOCK))
    parts = max(1, -(-m // query_part))
    place = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = rows.select("dim", each(parts).alias("part"), place(1, blocks).alias("block"), F.lit(0).alias("kind"), "id", "v")
    sent = asked.select("dim", place(2, parts).alias("part"), each(blocks).alias("block"), F.lit(1).alias("kind"), "id", "v")
    key = ["dim", "part", "block"]
    met = own.unionByName(sent).repartition(max(tasks, blocks * parts), *key).sortWithinPartitions(*key, "kind")
    found = met.mapInArrow(lambda batches: search(batches, k), "query_id long, dim int, q binary, vec_id long, score long")
    w = W.partitionBy("query_id", "dim", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(50)) == 0)


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS q, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
