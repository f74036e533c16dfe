import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from oracle import connect, rows_of, rows_of_sql
from quittance.llm import bpe, decontaminate, language_id, license_scan, line_dedup, pii, queries, token_output, url_filter

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
#: Null id, null and empty texts, a long text, ties, repeated rows.
ODD = [(1, None), (2, ""), (3, "x " * 30_000), (4, "same line here\nshort"), (4, "same line here\nshort"), (5, "same line here\nother line too"), (None, "same line here"), (6, "é ß\x00 漢")]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("pos", "lines", "words", "n_words", "n_tokens", "ids", "score", "h", "key", "doc", "items", "fp", "url", "host"):
            df = df.selectExpr("*", f"cast(null as string) as {name}")
    return df


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = rows_of(queries.queries()[name](spark, DIR)), rows_of_sql(connect(DIR), queries.oracle_sql()[name])
    assert got == want


def lines_plain(rows):
    strip = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(strip))
            if len(k) >= 10:
                holders.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            own = holders.get(lower(line.strip(strip)), ())
            if len(own) < 2 or d == min(x for x in own if x is not None):
                kept.append(line)
        out.append((d, "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_odd_rows(spark):
    df = line_dedup.dedup_lines(frame(spark, ODD, True))
    assert {"pos", "lines", "h"} <= set(df.columns)
    assert sorted(((r.doc_id, r.text) for r in df.collect()), key=repr) == lines_plain(ODD)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_random(spark):
    rng = random.Random(5)
    pool = ["  A line that is Long ", "a line that is long", "another longer line\t", "short", "", "ÄÖ line of letters", "äÖ line of letters"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == lines_plain(rows)
    assert all(r.n_lines - r.n_dropped == (len(r.text.split("\n")) if r.n_dropped < r.n_lines else 0) for r in got)


def licenses_plain(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    at = [(i, t.label) for t in license_scan.BASE for i in range(len(words)) if words[i : i + len(t.text.split())] == t.text.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses_against_plain(spark):
    rng = random.Random(3)
    bits = ["under the MIT License", "under", "the mit", "license", "Apache License, Version 2", "cc-by-nc", "CC BY", "nc", "word", "K", "É", "under the mit license under the mit license"]
    rows = [(i, ". ".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "...")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, rows, True)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licenses_plain(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def test_license_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in license_scan.query(spark, DIR).collect()}
    for d, t in ((r.doc_id, r.text) for r in docs.collect()):
        assert (got[d].n_words, got[d].n_base, got[d].first_word, got[d].last_word, got[d].base_labels) == licenses_plain(t)


def test_notice_with_words_put_in(spark):
    text = "This work is licensed under the (new) GNU General Public License, version 3."
    r = license_scan.scan_licenses(frame(spark, [(1, text)]), min_cover=0.7).first()
    assert r.labels == "gpl-3" and r.spans[0].first == 3


def test_urls_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/x?y#z"), (5, "https://www.example.com/en/"), (6, "http://a.net/fr/#"), (7, "http://net"), (8, "http://x.com?/en/"), (9, "http://notexample.com/en/"), (9, "http://notexample.com/en/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' as host", "1 as prefix")
    got = sorted(url_filter.filter_urls(df, url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [tuple(r) for r in got] == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.com", "/en/x", "example.com/en/", "block"),
        (5, "www.example.com", "/en/", "www.example.com/en/", "allow"), (6, "a.net", "/fr/", "net/fr/", "block"), (7, "net", "", None, "allow"), (8, "x.com", "", None, "allow"),
        (9, "notexample.com", "/en/", "com/", "allow"), (9, "notexample.com", "/en/", "com/", "allow"),
    ]
    assert url_filter.filter_urls(df, url_filter.rule_table(spark).limit(0)).where("verdict <> 'allow'").count() == 0


ALPHABET = [" ", "  ", "\n", "\t", "a", "the", "The", "'s", "'ll", "12", "é", "ß", "漢", "😀", "!", "...", " ", " ", "\x1c", "<|endoftext|>", "ing", "----", "\r\n", "x" * 60]


def fuzz(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_bpe_equals_tiktoken_and_round_trips():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    c = bpe.codec(path, P.PATTERN)
    ref = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = fuzz(3000)
    for t, ids in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(t)
        assert c.decode(ids).decode() == t
    starts, ends = c.offsets("a 😀b", c.encode(["a 😀b"])[0])
    assert starts[0] == 0 and ends[-1] == 4 and all(x < y for x, y in zip(starts, ends, strict=True))


def test_bpe_operator_odd_rows(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(frame(spark, ODD, True), path, P.PATTERN, offsets=True), path).collect()
    assert len(out) == len(ODD) and all(bytes(r.decoded).decode() == (r.text or "") and len(r.starts) == r.n_tokens for r in out)
    assert bpe.encode(frame(spark, []), path, P.PATTERN).count() == 0


def test_library_equality():
    path = P.path("byte_bpe_50k.json")
    texts = fuzz(3000, 9)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.codec(path, P.PATTERN).encode(texts)] == want


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        docs = [(rng.zipf(1.3, int(k)) % 300).astype("<u4") for k in rng.integers(0, 200, n // 100 + 1)]
        raw = token_output.pack(list(range(len(docs))), [d.tobytes() for d in docs], 300)
        s = token_output.Shard(raw)
        assert s.all_ids().astype("<u4").tobytes() == b"".join(d.tobytes() for d in docs)
        assert all((s.document(k) == d).all() for k, d in enumerate(docs))
    assert len(s.rules) > 0
    many = np.tile(np.array([1, 2, 3, 4], np.uint32), 5000)
    assert len(token_output.pack([1], [many.tobytes()], 10)) < many.nbytes / 50


def test_token_output_table(spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    token_output.write_shards(frame(spark, ODD, True), str(tmp_path / "t"), path, P.PATTERN, shard_ids=50)
    got = token_output.read_shards(spark, str(tmp_path / "t")).orderBy("start").collect()
    ref = Tokenizer.from_file(path)
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (d, t) in zip(got, rows, strict=True):
        ids = np.array([*ref.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r.doc_id, r.start, bytes(r.ids)) == (d, start, ids) and zlib.crc32(ids) >= 0
        start += len(ids) // 4
    token_output.write_shards(frame(spark, []), str(tmp_path / "e"), path, P.PATTERN)
    assert token_output.read_shards(spark, str(tmp_path / "e")).count() == 0


def test_decontamination_odd_rows(spark):
    ten = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, ten + " eleven"), (1, ten + " eleven"), (2, "tiny item"), (3, None), (4, ""), (None, "null id words")], "item_id long, text string")
    docs = [(1, f"x {ten.upper()}, y"), (2, "a Tiny-item! a tiny item"), (3, None), (4, ""), (5, "null id words"), (5, "null id words"), (6, "one two three")]
    got = decontaminate.judged(decontaminate.find_contamination(frame(spark, docs, True), items)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got] == [(1, 12, 10, [1]), (2, 6, 4, [2]), (3, 0, 0, []), (4, 0, 0, []), (5, 3, 3, []), (5, 3, 3, []), (6, 3, 0, [])]
    assert docs[0][1][slice(*got[0].hit_spans[0])] == ten.upper() and got[1].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert decontaminate.judged(decontaminate.find_contamination(frame(spark, docs), items.limit(0))).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.judged(decontaminate.find_contamination(docs, items)).select("doc_id", "n_hit", "items_sha256").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 600)
    assert sorted(map(tuple, decontaminate.judged(decontaminate.find_contamination(docs, items)).select("doc_id", "n_hit", "items_sha256").collect())) == one


def test_pii_base_spans_against_regex():
    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    rng = random.Random(4)
    bits = ["a@b.c", "@", "x", ".", "1", "25", "256", " ", "-", "+1", "(", ")", "555", "4111111111111111", "4111 1111 1111 1111", "é", "..", "a@b", "+49 30 1234567", "1.2.3.4"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want = [(0, *m.span()) for m in email.finditer(t)]
        want += [(1, *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(2, *m.span()) for m in card.finditer(t) if 16 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
        want += [(3, *m.span()) for m in phone.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert pii.base_spans(t) == want, t


def test_pii_looser_forms_need_no_digit():
    rng = random.Random(5)
    bits = ["john", "{at}", "(AT)", "[at]", "example.com", "x(dot)org", " ", ":", "a:b:c:d:e:f:a:b", "fe", "7", "(555) 555-9876", "378282246310005"]
    texts = ["write to john{at}example.com", "host a:b:c:d:e:f:a:b now"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 10))) for _ in range(4000)]
    assert pii.more_spans(texts[0]) and pii.more_spans(texts[1])
    for t in texts:
        assert pii.more_spans(t) == [(pii.KINDS.index(kind), *m.span()) for kind, p in pii._MORE for m in p.finditer(t)], t


def test_pii_operator(spark):
    rows = [*ODD, (10, "Call +1 (555) 555-1234, or phone (555) 555-9876 today"), (11, "mail jane(at)mail.com now, write me"), (12, "9" * 100_000)]
    got = {r.doc: r.spans for r in pii.find_pii(frame(spark, rows, True)).collect()}
    assert [(s.kind, s.base) for s in got[10]][0] == ("phone", True) and got[2] == [] and got[1] == []
    for spans in got.values():
        assert all(0 <= s.score <= 1 for s in spans)
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.query(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)


def test_language_odd_rows(spark):
    labelled = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("der die das und", "de"), ("the and of to", "en")] * 20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    got = language_id.identify(frame(spark, [(1, None), (2, ""), (3, "123 !"), (4, "der und die"), (5, "of the and"), (5, "of the and")], True), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "de", "en", "en"] and all(0 <= float(r.score) <= 1 for r in got)
    none = language_id.train(labelled.where("lang is null"))
    assert language_id.identify(frame(spark, [(1, "abc")]), none).first().lang_pred == "und"
    assert language_id.identify(frame(spark, []), model).count() == 0


def urls_plain(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)(/[^?#]*)?", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = (m[2] or "") if m else ""
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_urls_against_plain(spark, monkeypatch):
    rng = random.Random(6)
    rules = [*url_filter.RULES, ("block", "a.b.c.example.com", "/"), ("block", "b..c", "/x"), ("allow", "com", "/long/path/of/a/rule/")]
    rows = [(i, rng.choice(["http://", "HTTPS://", "://", ""]) + ".".join(rng.choice(["a", "b", "c", "", "www", "example", "com", "net", "É"]) for _ in range(rng.randint(0, 6))) + rng.choice(["", "/", "/en/", "/en", "/es/x", "/fr/?q", "/x", "/long/path/of/a/rule/z", "?/en/", "#"])) for i in range(600)]
    rows += [(1000, "http://" + "a." * 100_000 + "com/en/"), (1001, "http://x.net/es/" + "p" * 100_000), (1002, rows[0][1]), (1003, None)]
    for n in (url_filter.BROADCAST_RULES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", n)
        got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark, rules)).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: urls_plain(u, rules) for i, u in rows} and len(got) == len(rows)


def test_urls_empty_and_null_tables(spark):
    rules = url_filter.rule_table(spark)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    got = url_filter.filter_urls(spark.createDataFrame([(i, None) for i in range(50)], "page_id long, url string"), rules).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("", "", None, "allow")] * 50


def test_repair_has_no_bound_on_the_vocabulary():
    ids = np.tile(np.arange(40, dtype="<u4"), 500)
    sizes = []
    for n_base in (50_000, 65_536, 100_000, 1 << 20):
        raw = token_output.pack([1, 2], [ids.tobytes(), ids[:7].tobytes()], n_base)
        s = token_output.Shard(raw)
        assert (s.all_ids() == np.concatenate([ids, ids[:7]])).all() and (s.document(1) == ids[:7]).all()
        sizes.append(len(s.rules))
    assert len(set(sizes)) == 1 and sizes[0] > 0


def test_language_sample_of_any_size():
    # a language of 10^15 documents keeps a share above zero
    assert min(language_id._SHARES, 500 * language_id._SHARES // 10**15) > 10**6


def test_language_counts_alike_in_all_ways(monkeypatch):
    from collections import Counter

    text = "Some Text of ä few wörds, 漢字 and more " * 50
    at, c = language_id.counts(text)
    monkeypatch.setattr(language_id, "_FEW", 10**9)
    monkeypatch.setattr(language_id, "_STEP", 37)
    by_sorting = language_id.counts(text)
    monkeypatch.setattr(language_id, "_FEW", 10)
    in_steps = language_id.counts(text)
    for other in (by_sorting, in_steps):
        assert (at == other[0]).all() and (c == other[1]).all()
    low = text.lower()
    assert c.sum() == sum(sum(Counter(low[i : i + n] for i in range(len(low) - n + 1)).values()) for n in language_id.LENGTHS)


def test_language_long_text_and_rare_language(spark):
    labelled = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("der die das und", "de"), ("the and of to", "en")] * 20)] + [(99, "el la los y", "es")], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(frame(spark, [(1, "der und die " * 200_000)]), model).collect()}
    assert model.langs == ["de", "en", "es"] and got == {1: "de"}
    assert (np.abs(model.weights).sum(1) > 0).all()  # even the language of one document is learned, not held back


@pytest.mark.parametrize("name", ["bpe", "token_output"])
def test_codec_queries_to_the_digest(spark, name):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    if name == "bpe":
        ref = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, DIR).collect()}
        ids = {d: np.array(ref.encode_ordinary(t), "<u4").tobytes() for d, t in docs.items()}
        assert got == {d: (len(ids[d]) // 4, hashlib.sha256(ids[d]).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs.items()}
    else:
        ref = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.query(spark, DIR).collect()}
        start, want = 0, {}
        for d in sorted(docs):
            ids = np.array([*ref.encode(docs[d], add_special_tokens=False).ids, 0], "<u4").tobytes()
            want[d] = (start, len(ids) // 4, zlib.crc32(ids))
            start += len(ids) // 4
        assert got == want


def spans_plain(words, templates, max_gap, min_cover):
    """Notices of a text, one template and one place after another: (label, cover) of spans that hold enough of a notice and a gram that tells."""
    rows, k, out = license_scan.gram_rows(templates), license_scan.K, []
    for tid in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == tid]
        diags = {}
        for r in own:
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == tuple(r[6:]):
                    diags.setdefault(i - r[4], {})[r[4]] = r[5]
        order = sorted((d + min(x), d, x) for d, x in diags.items())
        island, reach, before = [], None, None
        for lo, d, x in order:
            if before is None or lo - reach > max_gap or abs(d - before[1]) > max_gap or lo - before[0] >= own[0][3]:
                island.append({})
            island[-1].update(x)
            reach, before = max(reach or 0, d + max(x) + k - 1), (lo, d)
        for x in island:
            cover = len(x) / len(own)
            out.append((own[0][1], cover, cover >= min_cover and not own[0][2] and any(x.values())))
    return out


def test_license_labels_against_plain(spark):
    rng = random.Random(12)
    gnu = "licensed under the GNU General Public License"
    bits = [gnu, f"{gnu}, version 3", f"{gnu} version 2", "licensed under the (new) gnu general public license, version 3", "a creative commons attribution sharealike 4.0 international license", "licensed under", "word", "public license version 2", *[t.text for t in license_scan.NOTICES[:6]]]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))) for i in range(200)] + [(7, gnu), (7, gnu), (None, gnu), (500, "x " * 100_000 + f"{gnu} version 2")]
    got = license_scan.scan_licenses(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for d, t in rows if d == r.doc_id]
        assert any((r.labels, r.score) == (",".join(sorted({x for x, _, ok in p if ok} | set(filter(None, r.base_labels.split(","))))), max([c for _, c, _ in p], default=0.0)) for p in (spans_plain([w.lower() for w in re.findall(r"[0-9A-Za-z]+", t)], license_scan.BASE + license_scan.NOTICES, 3, 0.8) for t in texts))


def test_license_versions(spark):
    gnu = "This is licensed under the GNU General Public License"
    rows = [(1, f"{gnu}, version 3."), (2, f"{gnu}, version 2."), (3, f"{gnu}, version 1."), (4, gnu), (5, f"{gnu}, version 2, or {gnu} version 3"), (6, "licensed under a creative commons attribution 4.0 international license"), (7, "licensed under a creative commons attribution sharealike 4.0 international license")]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: "gpl-3", 2: "gpl-2", 3: "", 4: "", 5: "gpl-2,gpl-3", 6: "cc-by", 7: "cc-by-sa"}


PLANTED = [
    ("email", "mail jane.roe(at)mail.com now", "jane.roe(at)mail.com"), ("email", "write to bob [at] example (dot) org please", "bob [at] example (dot) org"),
    ("ip", "the host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), ("card", "card 3782 822463 10005 thanks", "3782 822463 10005"),
    ("phone", "call (555) 555-9876 today", "(555) 555-9876"), ("phone", "tel 212-555-0187", "212-555-0187"),
]
DECOYS = ["firmware version 1.2.300.4 is out", "id 1234-5678-9012-3456 of", "serial 3782 822463 10006", "a:1:2:3:4:5:6:7:8", "order no 1234 5678 9012 3456"]


def test_pii_adds_planted_spans_and_no_decoys(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    own = [(10**6 + i, t) for i, (_, t, _) in enumerate(PLANTED)] + [(2 * 10**6 + i, t) for i, t in enumerate(DECOYS)]
    got = {r.doc: r.spans for r in pii.find_pii(docs.unionByName(frame(spark, own))).collect()}
    for i, (kind, t, part) in enumerate(PLANTED):
        assert [(s.kind, t[s.start : s.end], s.base) for s in got[10**6 + i]] == [(kind, part, False)]
    assert all(got[2 * 10**6 + i] == [] for i in range(len(DECOYS)))
    base = [s.score for spans in got.values() for s in spans if s.base]
    assert len(base) > 50 and min(base) > 0.5


def test_pii_labelers_are_not_turned_round():
    # many look-alikes and few true ones: the anchors hold the classes
    rows = [(1, "+++00+", "300", 5), (1, "0-+00+", "300", 5000), (1, "0+++0+", "701", 3), (3, "+++00+", "410", 2), (3, "0+++0+", "310", 1)]
    post = dict(zip([r[:3] for r in sorted(rows)], pii.reliabilities(sorted(rows)), strict=True))
    assert post[1, "+++00+", "300"] > 0.9 and post[1, "0-+00+", "300"] < 0.1 and post[1, "0+++0+", "701"] > 0.5 and post[3, "0+++0+", "310"] > 0.5
    assert pii.weigh([]) == {}


def test_pii_query_against_regex(spark):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    n_digits = lambda x: sum(c.isdigit() for c in x)
    good = (lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")), lambda x: 16 <= n_digits(x) <= 19 and pii.luhn(re.sub("[ -]", "", x)), lambda x: 8 <= n_digits(x) <= 15)
    got = {r.doc_id: r for r in pii.query(spark, DIR).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for d, t in docs.items():
        own = [[m.span() for m in re.finditer(p, t) if ok(m[0])] for p, ok in zip(patterns, good, strict=True)]
        spans = [f"{k}:{a}:{b}" for k, x in zip(pii.KINDS, own, strict=True) for a, b in x]
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, own))
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(filter(None, r.spans.split(",")))


def test_pii_repeated_rows_and_ties(spark):
    t = "tel 212-555-0187"
    rows = [(1, t), (1, t), (2, "212-555-0187 212-555-0187"), (3, "mail a@b.com"), (3, "mail a@b.com")]
    got = sorted((r.doc, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in pii.find_pii(frame(spark, rows)).collect())
    assert got == [(1, [("phone", 4, 16, False)])] * 2 + [(2, [("phone", 0, 12, False), ("phone", 13, 25, False)])] + [(3, [("email", 5, 12, True)])] * 2


@pytest.mark.parametrize("limit", [250_000, 0])
def test_decontamination_against_plain_in_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
    monkeypatch.setattr(decontaminate, "_STEP", 50)
    rng = random.Random(2)
    word = lambda: rng.choice("a b c d Ee É é 7 x-y".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 14])))) for i in range(30)] + [(3, None), (None, "c d c d a a 7")]
    pool = [t for _, t in items if t]
    docs = [(i, ". ".join(rng.choice([word(), rng.choice(pool)]) for _ in range(rng.randint(0, 6)))) for i in range(150)] + [(200, None), (201, ""), (7, "a b c"), (202, "z " * 60_000 + pool[0])]
    items = [(i, t) for i, t in items if not t or len(decontaminate.words_of(t)) != 1]
    split = lambda t: [w.lower() if w.isascii() else w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    own = [(i, split(t)) for i, t in items]
    windows = {}
    for i, w in own:
        for j in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i)

    def plain(t):
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        return len(w), len(hit), sorted(x for x in found if x is not None)

    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judged(decontaminate.find_contamination(frame(spark, docs, True), df)).collect()
    assert len(got) == len(docs) and {"key", "h", "items"} <= set(got[0].asDict())
    want = sorted((d, *plain(t)) for d, t in docs)
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == want


def test_decontamination_by_a_large_benchmark(spark, monkeypatch):
    """An item of more words than an automaton takes, and others; the same rows as from one automaton."""
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 25_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.where("doc_id % 2 = 0").orderBy("doc_id").collect() if r.text]
    words, items = [w for t in texts for w in decontaminate.words_of(t)], [(0, "nothing but a long item")]
    rng = random.Random(8)
    for i in range(1, 400):
        at = rng.randrange(len(words))
        items.append((i, b" ".join(words[at : at + rng.randint(3, 60)]).decode()))
    items.append((500, " ".join(f"w{i}" for i in range(29_000)) + " " + texts[0]))
    assert sum(len(decontaminate.words_of(t)) for _, t in items) > 30_000 > decontaminate.BLOCK_WINDOWS
    df = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.n_words, str(r.hit_words), str(r.hit_spans), str(r["items"])) for r in decontaminate.find_contamination(docs, df).collect())
    parts = found()
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 1 << 40)
    assert parts == found() and sum(r[2] != "[]" for r in parts) > 100


def test_decontamination_by_items_without_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 0)
    df = spark.createDataFrame([(1, " .. "), (2, "-")], "item_id long, text string")
    assert [(r.n_words, r.hit_words) for r in decontaminate.find_contamination(frame(spark, [(1, "a b")]), df).collect()] == [(2, [])]
