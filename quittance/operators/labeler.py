"""A token labeler that is trained here: a linear-chain conditional random field over the tokens of a page."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quittance.functions.labels import label_of
from quittance.sources.shared import remove

PAGE = ("receipt_id", "page_no")
#: Buckets that features are hashed into.
BUCKETS = 1 << 13
#: Pages of one vectorised pass.
PASS = 256
#: Bytes of a block of stored pages, about.
STORED_BYTES = 4 << 20


@dataclass
class Chain:
    """Weights of features by label, of label pairs, and of the labels that begin and end a page; ``tags`` names the labels."""

    tags: tuple[int, ...]
    weights: np.ndarray
    pairs: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def zeros(cls, tags: tuple[int, ...], buckets: int = BUCKETS) -> Chain:
        n = len(tags)
        return cls(tags, np.zeros((buckets, n)), np.zeros((n, n)), np.zeros(n), np.zeros(n))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.weights, self.pairs, self.begin, self.end

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def moved(self, flat: np.ndarray) -> Chain:
        """A chain of this shape with other weights."""
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return Chain(self.tags, *(x.reshape(p.shape) for x, p in zip(np.split(flat, cuts), self.parts(), strict=True)))


def _pad(rows: list[np.ndarray], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rows as one array, filled up to the longest; which places are real)."""
    size = max(len(r) for r in rows)
    out = np.full((len(rows), size, *rows[0].shape[1:]), fill, rows[0].dtype)
    real = np.zeros((len(rows), size), bool)
    for i, r in enumerate(rows):
        out[i, : len(r)], real[i, : len(r)] = r, True
    return out, real


def forward_backward(emit: np.ndarray, real: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the partition sum of each page, each token's label probabilities, expected label pairs over all).

    ``emit`` is pages x tokens x labels. Sums are scaled token by token, so long pages do not overflow.
    """
    b, size, n = emit.shape
    top = emit.max(2)
    e = np.exp(emit - top[..., None])
    tops = [x.max() for x in (chain.pairs, chain.begin, chain.end)]
    a, begin, end = (np.exp(x - t) for x, t in zip((chain.pairs, chain.begin, chain.end), tops, strict=True))
    alpha, scale = np.empty_like(e), np.ones((b, size))
    alpha[:, 0] = begin * e[:, 0]
    scale[:, 0] = alpha[:, 0].sum(1)
    alpha[:, 0] /= scale[:, :1]
    for t in range(1, size):
        new = (alpha[:, t - 1] @ a) * e[:, t]
        scale[:, t] = np.where(real[:, t], new.sum(1), 1.0)
        alpha[:, t] = np.where(real[:, t, None], new / scale[:, t, None], alpha[:, t - 1])
    ends = alpha[:, -1] @ end
    log_sum = (np.log(scale) + np.where(real, top, 0)).sum(1) + (real.sum(1) - 1) * tops[0] + tops[1] + tops[2] + np.log(ends)
    beta = np.empty_like(e)
    beta[:, -1] = end
    pairs = np.zeros((n, n))
    for t in range(size - 1, 0, -1):
        ahead = e[:, t] * beta[:, t] / scale[:, t, None]
        beta[:, t - 1] = np.where(real[:, t, None], ahead @ a.T, beta[:, t])
        weight = np.where(real[:, t], 1 / ends, 0.0)[:, None]
        pairs += a * ((alpha[:, t - 1] * weight).T @ ahead)
    return log_sum, alpha * beta / ends[:, None, None], pairs


def emissions(chain: Chain, f: np.ndarray) -> np.ndarray:
    """The sum of the weights of each token's features, whose buckets are the last axis of ``f``."""
    emit = chain.weights[f[..., 0]]
    for k in range(1, f.shape[-1]):
        emit += chain.weights[f[..., k]]
    return emit


def bucket_sums(f: np.ndarray, delta: np.ndarray, buckets: int) -> np.ndarray:
    """buckets x labels: the rows of ``delta``, of tokens x labels, added up for each bucket of their tokens' features."""
    n = delta.shape[1]
    place = f[:, :, None] * n + np.arange(n)
    return np.bincount(place.ravel(), np.broadcast_to(delta[:, None], place.shape).ravel(), buckets * n).reshape(buckets, n)


def loss_and_gradient(chain: Chain, features: list[np.ndarray], tags: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """The negative log-likelihood of some pages and its gradient. ``tags`` are places in ``chain.tags``."""
    loss, grad = 0.0, Chain.zeros(chain.tags, len(chain.weights))
    order = sorted(range(len(features)), key=lambda i: len(features[i]))
    for at in range(0, len(order), PASS):
        own = [i for i in order[at : at + PASS] if len(features[i])]
        if not own:
            continue
        f, real = _pad([features[i] for i in own])
        y, _ = _pad([tags[i] for i in own])
        emit = emissions(chain, f)
        log_sum, unary, pairs = forward_backward(emit, real, chain)
        rows, last = np.arange(len(own)), real.sum(1) - 1
        said = np.where(real, np.take_along_axis(emit, y[..., None], 2)[..., 0], 0).sum(1) + chain.begin[y[:, 0]] + chain.end[y[rows, last]]
        step = real[:, 1:]
        said += np.where(step, chain.pairs[y[:, :-1], y[:, 1:]], 0).sum(1)
        loss += float((log_sum - said).sum())
        delta = unary[real]
        delta[np.arange(len(delta)), y[real]] -= 1
        grad.weights += bucket_sums(f[real], delta, len(chain.weights))
        grad.pairs += pairs
        np.add.at(grad.pairs, (y[:, :-1][step], y[:, 1:][step]), -1)
        grad.begin += unary[:, 0].sum(0)
        np.add.at(grad.begin, y[:, 0], -1)
        grad.end += unary[rows, last].sum(0)
        np.add.at(grad.end, y[rows, last], -1)
    return loss, grad.flat()


def viterbi(emit: np.ndarray, chain: Chain) -> np.ndarray:
    """The most likely labels of one page, of tokens x labels."""
    best, came = emit[0] + chain.begin, []
    for row in emit[1:]:
        ways = best[:, None] + chain.pairs
        came.append(ways.argmax(0))
        best = ways.max(0) + row
    path = [int((best + chain.end).argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return np.array(path[::-1])


def token_features(text: str, x: str, buckets: int = BUCKETS) -> list[Column]:
    """What a token is known by, as bucket numbers; windows over the page add its neighbours."""
    t = F.col(text)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"\d+", "9")
    place = F.floor(F.col(x) / 40).cast("string")
    w = W.partitionBy(*PAGE).orderBy("seq")
    known = {
        "word": F.lower(t), "shape": shape, "place": place, "both": F.concat_ws("|", shape, place), "head": F.lower(F.substring(t, 1, 2)), "tail": F.lower(F.right(t, F.lit(2))),
        "before": F.coalesce(F.lag(shape).over(w), F.lit("<")), "after": F.coalesce(F.lead(shape).over(w), F.lit(">")), "place before": F.coalesce(F.lag(place).over(w), F.lit("<")),
    }
    return [F.pmod(F.xxhash64(F.lit(k), F.coalesce(v, F.lit(""))), F.lit(buckets)).cast("int") for k, v in known.items()]


def page_sequences(entries: DataFrame, tag: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(receipt_id, page_no, seqs, features, tags): the tokens of each page in order. Tags are -1 where none are given."""
    known = entries.select(*PAGE, "seq", F.array(*token_features("text", "x1", buckets)).alias("f"), (F.lit(-1) if tag is None else tag).cast("int").alias("tag"))
    own = known.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("seq", "f", "tag"))).alias("own"))
    part = lambda c: F.transform("own", lambda v: v[c])
    return own.select(*PAGE, part("seq").alias("seqs"), part("f").alias("features"), part("tag").alias("tags"))


def _arrays(batch: pd.DataFrame) -> list[np.ndarray]:
    return [np.array([list(f) for f in fs], np.int64) for fs in batch["features"]]


def _flat(pages: DataFrame, *keep: str) -> DataFrame:
    """Page sequences with features in one array, ``flat``, beside ``n``, how many each token has: arrays that Python takes as they lie."""
    return pages.select(*keep, F.transform("features", F.size).alias("n"), F.flatten("features").alias("flat"))


def _split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(tokens x features of all pages of a batch, each page's number of tokens)."""
    n, flat = batch.column("n"), batch.column("flat").flatten().to_numpy()
    each = int(n.flatten().to_numpy()[0]) if len(flat) else 1
    return flat.reshape(-1, each), pc.list_value_length(n).to_numpy()


def stored(pages: DataFrame, path: str) -> DataFrame:
    """``pages`` as a compact table that is read again and again, in blocks small enough for all cores to have some."""
    pages.write.option("parquet.block.size", STORED_BYTES).parquet(path)
    return pages.sparkSession.read.parquet(path)


def corpus_gradient(pages: DataFrame, chain: Chain) -> tuple[float, np.ndarray, int]:
    """(loss, gradient, tokens) over all pages: tasks add up their own, some tasks add up those, and the driver adds a few.

    What travels is one gradient for each task, whatever the number of pages.
    """
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(chain)
    n_tasks = max(1, pages.rdd.getNumPartitions())
    groups = max(1, int(n_tasks**0.5))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sent.value.tags)  # in order
        loss, total, tokens = 0.0, None, 0
        for batch in batches:
            flat, sizes = _split(batch)
            given = batch.column("tags").flatten().to_numpy()
            tags = np.searchsorted(names, given)
            if not np.isin(given, names).all():
                raise KeyError("a page has a tag that the chain does not know")
            cuts = np.cumsum(sizes)[:-1]
            x, g = loss_and_gradient(sent.value, np.split(flat, cuts), np.split(tags, cuts))
            loss, total, tokens = loss + x, g if total is None else total + g, tokens + len(tags)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"loss": [loss], "tokens": [tokens], "g": [total.tobytes()]})

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        g = np.sum([np.frombuffer(b) for b in rows["g"]], axis=0)
        return pd.DataFrame({"loss": [rows["loss"].sum()], "tokens": [rows["tokens"].sum()], "g": [g.tobytes()]})

    kind = "loss double, tokens long, g binary"
    each = _flat(pages, "tags").mapInArrow(own, kind).withColumn("k", F.spark_partition_id() % groups)
    found = each.groupBy("k").applyInPandas(lambda rows: together(rows.drop(columns="k")), kind).collect()
    sent.unpersist()
    grad = np.sum([np.frombuffer(r.g) for r in found], axis=0) if found else np.zeros(chain.flat().size)
    return float(sum(r.loss for r in found)), grad, int(sum(r.tokens for r in found))


def minimise(start: np.ndarray, value: Callable[[np.ndarray], tuple[float, np.ndarray]], steps: int, after: Callable[[int, np.ndarray], None], memory: int = 7) -> np.ndarray:
    """L-BFGS with step halving; ``after`` sees the weights of each step."""
    x, (f, g) = start, value(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(1, steps + 1):
        q, undo = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            q -= a * y
            undo.append(a)
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(q).sum())
        for (s, y), a in zip(past, reversed(undo), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        slope, size = -(g @ q), 1.0
        if slope > -1e-12:
            break
        while True:
            new = x - size * q
            f_new, g_new = value(new)
            if f_new <= f + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            past = [*past[-(memory - 1) :], (s, y)]
        x, f, g = new, f_new, g_new
        after(step, x)
    return x


class Checkpoints:
    """The best ``keep`` checkpoints of a training run by their score, in the folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path, keep
        self.scores: dict[int, float] = {}

    def save(self, step: int, score: float, chain: Chain) -> None:
        data = io.BytesIO()
        np.savez_compressed(data, tags=np.array(chain.tags), weights=chain.weights, pairs=chain.pairs, begin=chain.begin, end=chain.end)
        row = [(step, score, bytearray(data.getvalue()))]
        self.spark.createDataFrame(row, "step int, score double, chain binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/step={step}")
        self.scores[step] = score
        for worse in sorted(self.scores, key=lambda k: (-self.scores[k], k))[self.keep :]:
            remove(self.spark, f"{self.path}/step={worse}")
            del self.scores[worse]

    def best(self) -> Chain:
        """The chain of the best checkpoint, the earliest on ties."""
        step = min(self.scores, key=lambda k: (-self.scores[k], k))
        with np.load(io.BytesIO(bytes(self.spark.read.parquet(f"{self.path}/step={step}").first().chain))) as f:
            return Chain(tuple(int(t) for t in f["tags"]), f["weights"], f["pairs"], f["begin"], f["end"])


def train(pages: DataFrame, checkpoints: Checkpoints, score: Callable[[Chain], float], steps: int = 24, every: int = 6, l2: float = 1.0, buckets: int = BUCKETS) -> Chain:
    """Fits a chain to tagged page sequences; every few steps it is scored, and the best two are kept.

    ``score`` is called on the driver, as a rule to label held-out pages. The
    pages are read in every step, so they are to be ``stored``. Gradients are whole: each step
    sees all pages. The best chain by score comes back, not the last.
    """
    tags = tuple(sorted(r.t for r in pages.select(F.explode("tags").alias("t")).distinct().collect()))
    if not tags:
        raise ValueError("there is no tagged token to learn from")
    shape = Chain.zeros(tags, buckets)

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad, tokens = corpus_gradient(pages, shape.moved(flat))
        return (loss + l2 / 2 * flat @ flat) / tokens, (grad + l2 * flat) / tokens

    def after(step: int, flat: np.ndarray) -> None:
        if step % every == 0 or step == steps:
            checkpoints.save(step, score(shape.moved(flat)), shape.moved(flat))

    last = minimise(shape.flat(), value, steps, after)
    if not checkpoints.scores:
        checkpoints.save(steps, score(shape.moved(last)), shape.moved(last))
    return checkpoints.best()


LABELLED = "seq long, tag int, label_ids array<int>, probs array<double>"


def best_paths(emits: list[np.ndarray], chain: Chain) -> list[np.ndarray]:
    """``viterbi`` of several pages, a token of each at a time."""
    emit, real = _pad(emits)
    rows, size = np.arange(len(emit)), real.sum(1)
    best, came = emit[:, 0] + chain.begin, []
    for t in range(1, emit.shape[1]):
        ways = best[:, :, None] + chain.pairs
        came.append(ways.argmax(1))
        best = np.where(real[:, t, None], ways.max(1) + emit[:, t], best)
    path = np.empty(real.shape, np.int64)
    now = (best + chain.end).argmax(1)
    for t in range(emit.shape[1] - 1, 0, -1):
        path[:, t] = now
        now = np.where(real[:, t], came[t - 1][rows, now], now)
    path[:, 0] = now
    return [p[:n] for p, n in zip(path, size.tolist(), strict=True)]


def path_tags(pages: DataFrame, chain: Chain) -> DataFrame:
    """Page sequences with ``path``, the tags of the best path, beside their own ``tags``: no token leaves its page, so nothing is joined."""
    sent = pages.sparkSession.sparkContext.broadcast(chain)
    known = _flat(pages, *PAGE, "seqs", "tags")
    kept = [known.schema[c] for c in (*PAGE, "seqs", "tags")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = np.array(own.tags, np.int32)
        for batch in batches:
            flat, tokens = _split(batch)
            emits = np.split(emissions(own, flat), np.cumsum(tokens)[:-1])
            order = np.argsort(tokens, kind="stable").tolist()
            paths: list[np.ndarray] = [np.empty(0, np.int64)] * len(emits)
            for at in range(0, len(order), PASS):
                part = [i for i in order[at : at + PASS] if tokens[i]]
                if part:
                    for i, p in zip(part, best_paths([emits[i] for i in part], own), strict=True):
                        paths[i] = p
            made = pa.array([names[p] for p in paths], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), made], names=[*(f.name for f in kept), "path"])

    return known.mapInArrow(run, T.StructType([*kept, T.StructField("path", T.ArrayType(T.IntegerType()))]))


def label_pages(pages: DataFrame, chain: Chain) -> DataFrame:
    """(receipt_id, page_no, seq, tag, labels) of page sequences: the best path, and each token's three likeliest labels with thousandths."""
    sent = pages.sparkSession.sparkContext.broadcast(chain)
    kind = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in PAGE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        names = np.array(own.tags)
        for batch in batches:
            out = []
            for row, f in zip(batch.itertuples(index=False), _arrays(batch), strict=True):
                emit = own.weights[f].sum(1)
                path = viterbi(emit, own)
                probs = forward_backward(emit[None], np.ones((1, len(emit)), bool), own)[1][0]
                three = np.argsort(-probs, axis=1, kind="stable")[:, :3]
                for t, seq in enumerate(row.seqs):
                    out.append((row.receipt_id, row.page_no, int(seq), int(names[path[t]]), names[three[t]].tolist(), probs[t, three[t]].tolist()))
            yield pd.DataFrame(out, columns=[*PAGE, "seq", "tag", "label_ids", "probs"])

    found = pages.select(*PAGE, "seqs", "features").mapInPandas(run, f"{kind}, {LABELLED}")
    candidate = lambda i, p: F.struct(i.alias("label_id"), label_of(i).alias("label"), F.floor(p * 1000 + 0.5).cast("int").alias("prob_milli"))
    return found.select(*PAGE, "seq", "tag", F.zip_with("label_ids", "probs", candidate).alias("labels"))
