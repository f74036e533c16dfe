"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quittance.llm.common import bounded_batches, table

#: Hashed n-grams, and their lengths.
DIMENSIONS = 1 << 15
LENGTHS = (1, 2, 3)
#: Labelled documents of the training sample, over all languages.
SAMPLE_DOCS = 2000
#: Most languages, whose counts and weights (262 KB each) are held by the driver and every worker; more are an error.
MAX_LANGUAGES = 500
#: Learner: FTRL step sizes, elastic net, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.5, 3
#: Parts of one in which a language's share of the sample is told: 500 documents of 10^15 are some.
_SHARES = 1 << 62
#: Characters counted at once.
_STEP = 1 << 20
#: Texts of no more characters are counted by sorting, others in a table of all dimensions.
_FEW = 1000


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of the lower-cased whole text, in order, and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    reach = max(LENGTHS) - 1
    dense = None
    few: list[np.ndarray] = []
    for i in range(0, len(points), _STEP):
        part = points[i : i + _STEP + reach]
        own = min(_STEP, len(points) - i)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + (part[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
            if n in LENGTHS:
                few.append(((h[:own] ^ h[:own] >> np.uint64(29)) >> np.uint64(7) & np.uint64(DIMENSIONS - 1)).astype(np.int64))
        if len(points) > _FEW:
            made = np.bincount(np.concatenate(few), minlength=DIMENSIONS)
            dense = made if dense is None else dense + made
            few = []
    if dense is not None:
        at = np.flatnonzero(dense)
        return at, dense[at]
    return np.unique(np.concatenate(few), return_counts=True) if few else (np.empty(0, np.int64), np.empty(0, np.int64))


def features(at: np.ndarray, c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the unit-length TF-IDF vector."""
    x = np.log1p(c) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm > 0 else x


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader with L1 and L2 penalties."""

    def __init__(self, n_classes: int, dimensions: int):
        self.z = np.zeros((n_classes, dimensions + 1))
        self.n = np.zeros((n_classes, dimensions + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, self.z.shape[1] - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = softmax(w @ x)
        g[y] -= 1
        g = g[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def temperature(scores: list[np.ndarray], labels: list[int]) -> float:
    """The temperature that makes held-back labels likeliest, by golden-section search on its logarithm.

    As in Platt's rule, labels count for a little less than certain: else a sample
    without an error would ask for no doubt at all.
    """
    if not scores:
        return 1.0
    s, y = np.array(scores), np.array(labels)
    k = s.shape[1]
    target = np.full(s.shape, 1 / (len(y) + k))
    target[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + k)

    def loss(log_t: float) -> float:
        z = s / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - (target * z).sum(1)).mean())

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """langs, idf, and weights over DIMENSIONS features and a constant, divided by the temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray):
        self.langs, self.idf, self.weights = langs, idf, weights

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0
        at, x = features(*counts(text), self.idf)
        p = softmax(self.weights[:, at] @ x + self.weights[:, -1])
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from labelled documents.

    Document frequencies count every labelled document. The regression sees a
    sample of about ``sample_docs`` documents, the same number of each language
    as far as there are, chosen by a hash of the id; one in five of it is held
    back for the temperature, but never a language's first. Only the frequencies
    (one for each dimension), the languages (MAX_LANGUAGES at most, else an
    error) and the sample's counts come to the driver.

    Edge cases: rows with a null text or language teach nothing; an empty text
    counts as a document without n-grams; repeated rows count again; rows with a
    null id are sampled like one id; a language of one document is learned from
    it; an empty table gives a model that finds every text ``und``; other
    columns are not looked at.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    docs = labelled.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[counts(text)[0]] += 1
                df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["i", "n"])

    df = np.zeros(DIMENSIONS + 1)
    for r in docs.select("text").mapInArrow(document_frequency, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r.i] = r.n
    n_docs = df[-1]
    idf = np.log((1 + n_docs) / (1 + df[:-1])) + 1
    per_lang = {r.lang: r["count"] for r in docs.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(per_lang) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    langs = sorted(per_lang)
    if not langs:
        return Model([], idf, np.zeros((0, DIMENSIONS + 1)))
    each = max(20, sample_docs // len(langs))
    shares = spark.createDataFrame([(k, min(_SHARES, each * _SHARES // v)) for k, v in per_lang.items()], "lang string, share long")
    picked = docs.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc", F.lit(11)), F.lit(_SHARES)) < F.col("share"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                at, c = counts(text)
                rows.append((at.astype("<u2").tobytes(), np.minimum(c, 65535).astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["h", "lang", "at", "c"]
            )

    sample = picked.select(F.xxhash64("doc", F.lit(13)).alias("h"), "lang", "text").mapInArrow(sparse, "h long, lang string, at binary, c binary").collect()
    sample.sort(key=lambda r: (r.h, r.lang, r.at))
    model = Ftrl(len(langs), DIMENSIONS)
    index = {k: i for i, k in enumerate(langs)}
    examples = []
    learned = set()
    for r in sample:
        at, c = (np.frombuffer(x, "<u2").astype(np.int64) for x in (r.at, r.c))
        examples.append((r.h % 5 == 0 and r.lang in learned, *features(at, c, idf), index[r.lang]))
        learned.add(r.lang)
    for _ in range(PASSES):
        for back, at, x, y in examples:
            if not back:
                model.learn(at, x, y)
    w = model.weights()
    back = [(w[:, at] @ x + w[:, -1], y) for held, at, x, y in examples if held]
    t = temperature([s for s, _ in back], [y for _, y in back])
    return Model(langs, idf, w / t)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``docs``; input columns of these names are replaced.

    Edge cases: a null text, or one without a letter, is ``und`` with score 0,
    and so is every text of a model that has learned no language; very long
    texts are read whole, in steps; other columns pass through.
    """
    bounded_batches(docs.sparkSession)
    rest = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t) for t in batch.column(text_col).to_pylist()]
            made = [pa.array([k for k, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> object:
    """Documents that training must not see."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train_by_contract(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train_by_contract(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
