"""PII spans by weak supervision: labelers vote, EM weighs them, a classifier decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm.common import bounded_batches, cut, table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Looser forms that may be personal data, and look-alikes that are not; the votes decide.
_MORE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")),
)

#: Gazetteers: endings of mail hosts, beginnings of card numbers, networks, country codes, context words for each kind and against all.
_TLDS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl pl ru cn jp br in au ca ch eu".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
_NETWORKS = ("2", "3", "fc", "fd", "fe80")
_COUNTRIES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "64", "65", "7", "81", "82", "86", "90", "91")
_CONTEXT = {
    "email": frozenset("mail email mailto contact write correo courriel kontakt".split()),
    "ip": frozenset("ip ipv4 ipv6 host server client address addr login".split()),
    "card": frozenset("card visa mastercard amex credit debit carte karte kreditkarte tarjeta".split()),
    "phone": frozenset("phone tel call mobile fax telefon telephone telefono cell".split()),
}
_AGAINST = frozenset("version release isbn serial order doi build firmware section chapter v no".split())
#: Characters around a span that context labelers see.
_AROUND = 32
_WORDS = re.compile(r"[a-z0-9]+")
#: Observations that the labelers' prior counts for, the posterior of an anchor, and the classifier's ridge.
PRIOR, SURE, RIDGE = 6.0, 0.98, 0.1
LABELERS = ("pattern", "checksum", "gazetteer", "context", "against", "boundary")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping; each @ is looked at once, so long runs cost no more than their length."""
    done = 0
    at = text.find("@")
    while at >= 0:
        run = text[done:at]
        start = at - (len(run) - len(run.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            # no match can begin before this @ and reach beyond it
            done = at + 1
            at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def more_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the looser forms."""
    low = text.lower()
    digit = _DIGIT.search(text) is not None
    # what a text must hold for the pattern to match at all
    may = (any(x in low for x in ("at)", "at]", "at}")), text.count(":") >= 7, digit and text.count(".") >= 3, digit, digit, digit)
    return [(KINDS.index(kind), *m.span()) for (kind, p), own in zip(_MORE, may, strict=True) if own for m in p.finditer(text)]


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> str:
    """A letter for each labeler: + for, - against, 0 abstains."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    name = KINDS[kind]
    if name == "email":
        tail = re.split(r"[.\])]\s*", span.lower())[-1]
        check, known = ("+" if 2 <= len(tail) <= 24 and tail.isalpha() else "-"), ("+" if tail in _TLDS else "0")
    elif name == "ip" and ":" in span:
        groups = span.split(":")
        check, known = ("+" if any(len(g) > 2 for g in groups) else "-"), ("+" if span.lower().startswith(_NETWORKS) else "0")
    elif name == "ip":
        parts = [int(x) for x in span.split(".")]
        first = parts[0]
        check, known = ("+" if max(parts) <= 255 else "-"), ("-" if first == 0 or first >= 240 else "+")
    elif name == "card":
        check, known = ("+" if luhn(digits) else "-"), ("+" if digits.startswith(_ISSUERS) else "0")
    else:
        check = "+" if 10 <= len(digits) <= 13 else "0"
        known = ("+" if digits.startswith(_COUNTRIES) else "-") if span.startswith("+") else ("-" if digits[:1] in "01" or digits[3:6] == "000" else "+")
    before, after = text[max(0, start - _AROUND) : start].lower(), text[end : end + _AROUND].lower()
    left = _WORDS.findall(before)
    context = "+" if not _CONTEXT[name].isdisjoint(left) or not _CONTEXT[name].isdisjoint(_WORDS.findall(after)) else "0"
    against = "-" if not _AGAINST.isdisjoint(left[-3:]) else "0"
    boundary = "-" if before[-1:].isalnum() or after[:1].isalnum() else "+"
    return ("+" if strict else "0") + check + known + context + against + boundary


def shape(text: str, start: int, end: int) -> str:
    """A few coarse features of the span: its length in fours, and whether it holds spaces or letters."""
    span = text[start:end]
    return f"{min(7, (end - start) // 4)}{int(' ' in span)}{int(any(c.isalpha() for c in span))}"


def reliabilities(rows: list[tuple[int, str, str, int]], rounds: int = 30) -> np.ndarray:
    """The probability of each row's votes being for personal data, by expectation-maximisation over two classes.

    Each labeler has, for each class and kind, a distribution over its votes,
    with PRIOR observations of what a labeler is made for: a vote for is three
    times as likely in the positive class as in the negative, and a vote against
    the other way. Two sorts of rows are anchors whose class does not move: what
    the fixed pattern and the checksum agree on and no labeler is against is
    positive; a loose form whose checksum fails, without a context word, is not.
    """
    kinds = np.array([r[0] for r in rows])
    v = np.array([["-0+".index(c) for c in r[1]] for r in rows])
    n = np.array([r[3] for r in rows], float)
    positive = (v[:, 0] == 2) & (v[:, 1] == 2) & (v != 0).all(1)
    negative = (v[:, 0] != 2) & (v[:, 1] == 0) & (v[:, 3] != 2)
    post = np.where(positive, SURE, np.where(negative, 1 - SURE, 0.5))
    prior = PRIOR * np.array([[3, 2, 1], [1, 2, 3]]) / 6
    for _ in range(rounds):
        odds = np.zeros(len(rows))
        for k in range(len(KINDS)):
            own = kinds == k
            if not own.any():
                continue
            w = np.stack([n[own] * (1 - post[own]), n[own] * post[own]])
            odds[own] += np.log((w[1].sum() + PRIOR) / (w[0].sum() + PRIOR))
            for j in range(v.shape[1]):
                p = np.stack([[w[c][v[own, j] == x].sum() for x in range(3)] for c in (0, 1)]) + prior
                p /= p.sum(1, keepdims=True)
                odds[own] += np.log(p[1] / p[0])[v[own, j]]
        post = np.where(positive, SURE, np.where(negative, 1 - SURE, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))))
    return post


def weigh(rows: list[tuple[int, str, str, int]]) -> dict[tuple[int, str, str], float]:
    """Scores of (kind, votes, shape) from how often each occurs.

    The posteriors of ``reliabilities`` teach a logistic regression on the
    kind, the votes for and against of each labeler, and the shape. Rows weigh
    by the logarithm of their number, so that rare forms are fitted too.
    """
    if not rows:
        return {}
    post = reliabilities(rows)
    shapes = sorted({r[2] for r in rows})
    x = np.array(
        [[1.0, *(float(r[0] == k) for k in range(len(KINDS))), *(float(c == s) for c in r[1] for s in "-+"), *(float(r[2] == z) for z in shapes)] for r in rows]
    )
    share = np.log1p([r[3] for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method, with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - post)) + RIDGE * w
        w -= np.linalg.solve(x.T @ (x * (share * p * (1 - p))[:, None]) + RIDGE * np.eye(len(w)), slope)
    return dict(zip([(r[0], r[1], r[2]) for r in rows], (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


_SPAN = "array<struct<kind:int,start:int,end:int,votes:string,shape:string,base:boolean>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("shape", pa.string()), ("base", pa.bool_())]))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, spans): candidate spans of each whole text, with votes and shape; no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                own = []
                base = base_spans(text)
                for kind, a, b in base:
                    own.append({"kind": kind, "start": a, "end": b, "votes": votes(text, kind, a, b, True), "shape": shape(text, a, b), "base": True})
                taken = sorted((a, b) for _, a, b in base)
                for kind, a, b in more_spans(text):
                    if not any(x < b and a < y for x, y in taken):
                        own.append({"kind": kind, "start": a, "end": b, "votes": votes(text, kind, a, b, False), "shape": shape(text, a, b), "base": False})
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPAN_ARROW)], names=["doc", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc long, spans {_SPAN}")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Finds emails, IP addresses, card and phone numbers in whole texts.

    Candidates are the fixed patterns (kept whatever the votes), looser forms and
    look-alikes. Labelers (pattern, checksum, gazetteers, context words for and
    against, word boundary) vote on each; expectation-maximisation over the
    counts of all vote patterns of the corpus estimates how reliable each is for
    each kind; a logistic regression on kind, votes and shape, fitted to those
    estimates, scores each span, and a looser one is added at ``least`` or more. Only
    counts by vote pattern, of which there is a fixed number, come to the
    driver.

    Returns (doc, spans): an array of (kind, start, end, base, score) by kind in
    the order of KINDS, then start; characters, end exclusive.

    Edge cases: null and empty texts have no spans; a null id is returned as
    null; repeated rows stay; an empty table gives an empty table; spans of
    looser forms never overlap the fixed ones, nor each other (the higher score
    stays, then the earlier); other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    found = cut(candidates(docs, id_col, text_col))
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count(F.lit(1)).alias("n"))
    score = weigh(sorted((r.kind, r.votes, r.shape, r.n) for r in counts.collect()))
    kinds = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                kept = []
                loose = []
                for s in spans:
                    p = score[s["kind"], s["votes"], s["shape"]]
                    (kept if s["base"] else loose).append((s["kind"], s["start"], s["end"], s["base"], p))
                taken: list[tuple[int, int]] = []
                for s in sorted(loose, key=lambda s: (-s[4], s[1], s[0])):
                    if s[4] >= least and not any(a < s[2] and s[1] < b for a, b in taken):
                        kept.append(s)
                        taken.append((s[1], s[2]))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": base, "score": p} for k, a, b, base, p in sorted(kept)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], names=["doc", "spans"])

    return found.mapInArrow(run, f"doc long, spans {kinds}")


def _joined(spans: object) -> object:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str) -> object:
    return lambda s: s["kind"] == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    n = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("doc").alias("doc_id"), *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
