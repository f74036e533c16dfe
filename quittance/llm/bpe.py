"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

Words repeat, and no token of a byte-level tokenizer joins what follows a
non-space to a space. So a text is cut before its spaces, each distinct piece is
encoded once by the library and kept (up to a bound) in the Python worker, and
the ids of a text are the pieces' ids put together. A text for which the cut
would not hold (runs of white space) is split by the whole pattern instead, and
one that names an added token goes to the library as it is.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quittance.llm.common import bounded_batches, table

#: Pieces that a worker keeps, and the longest piece that it keeps (code points).
KEPT_PIECES = 120_000
LONGEST_KEPT = 48
#: Words that the library encodes at once.
JOINED = 512
#: Marks that the pattern cuts off a word before them.
MARKS = tuple(".,!?;:")
#: Characters that Python takes for white space and the pattern does not.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    stands for itself, all others follow from code point 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, following = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(following))
            following += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def token_table(path: str) -> tuple[bytes, ...]:
    """The bytes of each id: the byte table reversed. Needs no tokenizer, so decoding holds little memory."""
    if not path.endswith(".json"):
        ids = {i: t for t, i in read_ranks(path).items()}
    else:
        back = {c: b for b, c in enumerate(byte_chars())}
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        ids = {i: bytes(back[c] for c in t) for t, i in d["model"]["vocab"].items() if all(c in back for c in t)}
        ids.update((t["id"], t["content"].encode()) for t in d["added_tokens"])
    return tuple(ids.get(i, b"") for i in range(max(ids) + 1))


def decode_ids(table: tuple[bytes, ...], ids: bytes) -> bytes:
    """Bytes are joined before anything reads characters, so characters split over tokens come back whole."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer_of_ranks(ranks: dict[bytes, int]):
    """A tokenizers.Tokenizer that merges by rank: every way to put a token
    together from two tokens becomes a merge, in the order of the ranks."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(name[token[:i]], name[token[i:]]) for i in range(1, len(token)) if token[:i] in name and token[i:] in name]
    t = Tokenizer(models.BPE(vocab={name[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return t


class Codec:
    """Encodes texts to packed little-endian unsigned 32-bit ids, and ids to bytes."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
        else:
            self.tokenizer = tokenizer_of_ranks(read_ranks(path))
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.token_bytes = token_table(path)
        self.first_byte = np.array([b[0] if b else 0 for b in self.token_bytes])
        self.split = regex.compile(pattern).findall
        self.kept = kept
        self.mark_ids = {m: self._whole(m) for m in MARKS}
        self.pieces: dict[str, bytes | bool] = {}
        self.heads: dict[str, bytes | bool] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words as the pattern splits them.

        Words that begin with a space go to the library in a row, and so do
        plain ones with line breaks between them: the pattern splits such a row
        into the same words, and the first byte of a token tells where.
        """
        out: dict[str, bytes] = {}
        spaced, plain = [], []
        for w in words:
            if len(w) > LONGEST_KEPT:
                out[w] = self._whole(w)
            elif len(w) > 1 and w[0] == " " and not w[1].isspace():
                spaced.append(w)
            elif w.isalpha():
                plain.append(w)
            else:
                out[w] = self._whole(w)
        for some, sep, skip in ((spaced, "", 0), (plain, "\n", 1)):
            first = self.first_byte == (10 if sep else 32)
            for i in range(0, len(some), JOINED):
                part = some[i : i + JOINED]
                raw = self._whole(sep + sep.join(part))
                cuts = np.flatnonzero(first[np.frombuffer(raw, "<u4")])
                if len(cuts) == len(part):
                    ends = [*cuts[1:].tolist(), len(raw) // 4]
                    out.update((w, raw[4 * (a + skip) : 4 * b]) for w, a, b in zip(part, cuts.tolist(), ends, strict=True))
                else:
                    out.update((w, self._whole(w)) for w in part)
        return out

    def _split(self, chunk: str) -> list[str]:
        """The chunk as the pattern splits it; plain words, alone or before one mark, need no pattern."""
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return [chunk]
        if chunk[-1:] in MARKS and body[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.split(chunk)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of texts that are split by the pattern."""
        split = [self._split(c) for c in chunks]
        known = self.words
        new = {w for ws in split for w in ws if w not in known}
        found = self._encode_words(new)
        if len(known) < self.kept:
            known.update((w, b) for w, b in found.items() if len(w) <= LONGEST_KEPT)
        get = lambda w: found[w] if w in found else known[w]
        return [b"".join(map(get, ws)) for ws in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str], list, list[int]]] = []
        slow: list[int] = []
        missing: set[str] = set()
        missing_heads: set[str] = set()
        known, heads = self.pieces, self.heads
        for i, text in enumerate(texts):
            if any(a in text for a in self.added) or any(c in text for c in ODD_SPACE):
                out[i] = self._whole(text)
                continue
            parts = text.split(" ")
            got = list(map(known.get, parts))
            got[0] = heads.get(parts[0])
            try:
                out[i] = b"".join(got)  # refuses pieces that are not known (None) or not to be cut (False)
                continue
            except TypeError:
                pass
            gaps = [k for k, g in enumerate(got) if g is None]
            if gaps and gaps[0] == 0:
                missing_heads.add(parts[0])
                missing.update([parts[k] for k in gaps[1:]])
            else:
                missing.update([parts[k] for k in gaps])
            cut.append((i, parts, got, gaps))
        new = self._encode_pieces(missing, " ", known)
        new_heads = self._encode_pieces(missing_heads, "", heads)
        for i, parts, got, gaps in cut:
            for k in gaps:
                got[k] = new[parts[k]] if k else new_heads[parts[0]]
            try:
                out[i] = b"".join(got)
            except TypeError:
                slow.append(i)
        for i, b in zip(slow, self._encode_chunks([texts[i] for i in slow]), strict=True):
            out[i] = b
        return out

    def _encode_pieces(self, pieces: set[str], before: str, kept: dict[str, bytes | bool]) -> dict[str, bytes | bool]:
        """Ids of pieces that stand after ``before``; False where white space at an end of one forbids the cut.

        Most are plain words, alone or before one mark, which need no pattern:
        the word's ids, then the mark's.
        """
        new: dict[str, bytes | bool] = {}
        plain, marked, rest = [], [], []
        for p in pieces:
            if p.isalpha():
                plain.append(p)
            elif p[-1:] in self.mark_ids and p[:-1].isalpha():
                marked.append(p)
            elif not p or p[-1].isspace() or (before and p[0].isspace()):
                new[p] = False if p or before else b""
            else:
                rest.append(p)
        bodies = {p[:-1] for p in marked}.difference(kept, plain)
        found = self._encode_words([before + p for p in plain] + [before + b for b in bodies])
        new.update((p, found[before + p]) for p in plain)
        mark_ids = self.mark_ids
        for p in marked:
            body = p[:-1]
            new[p] = (kept.get(body) or found[before + body]) + mark_ids[p[-1]]
        new.update(zip(rest, self._encode_chunks([before + p for p in rest]), strict=True))
        if len(kept) < self.kept:
            kept.update((p, b) for p, b in new.items() if len(p) <= LONGEST_KEPT)
        return new

    def decode(self, ids: bytes) -> bytes:
        return decode_ids(self.token_bytes, ids)

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 character of each token in the text; tokens that share a split character overlap."""
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.token_bytes[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return at[starts], at[ends - 1] + 1


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, kept: int = KEPT_PIECES) -> Codec:
    """One for each Python worker and vocabulary."""
    return Codec(path, pattern, kept)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", offsets: bool = False, decoded: bool = False, keep_text: bool = True) -> DataFrame:
    """Encodes whole texts without special tokens.

    Returns all columns of ``docs`` (the text only with ``keep_text``) plus ``n_tokens`` and ``ids`` (binary, little-endian
    unsigned 32-bit); with ``offsets`` also ``starts`` and ``ends``, the characters that each token covers; with ``decoded``
    also the bytes that the ids decode to, in the same pass. Input columns of these names are replaced.

    Edge cases: a null or empty text has no ids; very long texts are encoded whole; nulls in other columns, repeated rows
    and empty tables pass through as they are.
    """
    bounded_batches(docs.sparkSession)
    new = {"n_tokens": (pa.int64(), T.LongType()), "ids": (pa.binary(), T.BinaryType())}
    if offsets:
        new |= {k: (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())) for k in ("starts", "ends")}
    if decoded:
        new["decoded"] = (pa.binary(), T.BinaryType())
    rest = docs.drop(*new)
    kept = [c for c in rest.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in batches:
            texts = _texts(batch.column(text_col))
            ids = c.encode(texts)
            made = {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}
            if offsets:
                spans = [c.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                made |= {"starts": [s[0].tolist() for s in spans], "ends": [s[1].tolist() for s in spans]}
            if decoded:
                made["decoded"] = [c.decode(x) for x in ids]
            columns = [batch.column(k) for k in kept] + [pa.array(made[k], kind) for k, (kind, _) in new.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return rest.mapInArrow(run, T.StructType([*[rest.schema[k] for k in kept], *[T.StructField(k, kind) for k, (_, kind) in new.items()]]))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Decodes packed ids to bytes by the reversed byte table.

    Returns all columns plus ``out_col`` (binary; a column of this name is replaced). Null ids decode to nothing; an id
    outside the vocabulary is an error.
    """
    bounded_batches(encoded.sparkSession)
    rest = encoded.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = token_table(vocabulary)
        for batch in batches:
            out = [decode_ids(own, x or b"") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, out_col])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out_col, T.BinaryType())]))


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    both = encode(docs, vocabulary, pattern, decoded=True, keep_text=False)
    return both.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
