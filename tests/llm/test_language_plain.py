"""The language operator against a plain version: dictionaries, one number at a time, no vectors."""

import math

from pyspark.sql import functions as F

from quittance.llm import language_id as L

DIR = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def grams(text):
    points, out = [ord(c) for c in text.lower()], {}
    for i in range(len(points)):
        h = 0
        for n in range(1, min(3, len(points) - i) + 1):
            h = (h * 0x9E3779B97F4A7C15 + (points[i + n - 1] + n) * 0xC2B2AE3D27D4EB4F) & MASK
            at = (h ^ h >> 29) >> 7 & (L.DIMENSIONS - 1)
            out[at] = out.get(at, 0) + 1
    return out


def vector(text, idf):
    x = {i: math.log(1 + c) * idf(i) for i, c in grams(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {i: v / norm for i, v in x.items()} | {"constant": 1.0}


def shares(scores):
    top = max(scores)
    e = [math.exp(s - top) for s in scores]
    return [v / sum(e) for v in e]


class Plain:
    def __init__(self, labelled):
        """``labelled``: (order, lang, text), all of which are the sample."""
        self.langs = sorted({k for _, k, _ in labelled})
        seen = {}
        for _, _, t in labelled:
            for i in grams(t):
                seen[i] = seen.get(i, 0) + 1
        self.idf = lambda i: math.log((1 + len(labelled)) / (1 + seen.get(i, 0))) + 1
        self.z, self.n = ([{} for _ in self.langs] for _ in range(2))
        examples, learned = [], set()
        for h, lang, text in sorted(labelled):
            examples.append((h % 5 == 0 and lang in learned, vector(text, self.idf), self.langs.index(lang)))
            learned.add(lang)
        for _ in range(L.PASSES):
            for back, x, y in examples:
                if not back:
                    self.learn(x, y)
        held = [(self.scores(x), y) for back, x, y in examples if back]
        self.n_held = len(held)
        self.t = min((math.exp(math.log(0.02) + k / 2000 * math.log(1000)) for k in range(2001)), key=lambda t: self.loss(held, t))

    def weight(self, k, i):
        z, n = self.z[k].get(i, 0.0), self.n[k].get(i, 0.0)
        return 0.0 if abs(z) <= L.L1 else -(z - math.copysign(L.L1, z)) / ((L.BETA + math.sqrt(n)) / L.ALPHA + L.L2)

    def scores(self, x):
        return [sum(self.weight(k, i) * v for i, v in x.items()) for k in range(len(self.langs))]

    def learn(self, x, y):
        error = [p - (k == y) for k, p in enumerate(shares(self.scores(x)))]
        for k, e in enumerate(error):
            for i, v in x.items():
                g, n, w = e * v, self.n[k].get(i, 0.0), self.weight(k, i)
                self.z[k][i] = self.z[k].get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / L.ALPHA * w
                self.n[k][i] = n + g * g

    def loss(self, held, t):
        wrong, right = 1 / (len(held) + len(self.langs)), (len(held) + 1) / (len(held) + len(self.langs))
        return -sum((right if k == y else wrong) * math.log(p) for s, y in held for k, p in enumerate(shares([v / t for v in s])))

    def predict(self, text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        p = shares([s / self.t for s in self.scores(vector(text, self.idf))])
        return self.langs[p.index(max(p))], max(p)


def test_language_against_plain(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 90 OR text IS NULL OR length(text) < 30")
    own = docs.where(~L.held_out()).where("text IS NOT NULL AND lang IS NOT NULL")
    labelled = [(r.h, r.lang, r.text) for r in own.select(F.xxhash64("doc_id", F.lit(13)).alias("h"), "lang", "text").collect()]
    assert len({h for h, _, _ in labelled}) == len(labelled) < L.SAMPLE_DOCS // 4 / 2  # every document is in the sample
    plain, model = Plain(labelled), L.train_by_contract(docs)
    assert plain.n_held > 5 and model.langs == plain.langs
    got = L.identify(docs.select("doc_id", "text"), model).collect()
    assert len(got) > len(labelled)
    for r in got:
        lang, score = plain.predict(r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 2e-3, r.doc_id
