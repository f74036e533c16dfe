import random

import numpy as np
import pytest
import xxhash

from quittance.llm import components, embedding_dedup, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 5), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == groups({x for e in real for x in e}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_in_steps(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    want = plain_fingerprint(text, 3)
    monkeypatch.setattr(simhash, "_STEP", 64)
    assert simhash.fingerprint(text, 3) == want
    for t in (None, "", " \t", "a", "a b", "A b C d"):
        assert simhash.fingerprint(t, 3) == plain_fingerprint(t, 3)


@pytest.mark.parametrize(("budget", "node_rows"), [(2, 1000), (2, 3), (3, 5), (0, 2)])
def test_trie_finds_all_links(spark, budget, node_rows):
    rng = random.Random(budget)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for f in list(fps)[:60]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    links = simhash.trie_links(spark.createDataFrame(rows, "rep long, fp long"), budget, node_rows=node_rows).collect()
    assert all(bin(fps[r.a] ^ fps[r.b]).count("1") <= 64 for r in links)
    want = groups(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= budget])
    assert groups(range(len(fps)), [(r.a, r.b) for r in links]) == want


def test_trie_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 16)
    fp = np.sort(np.random.default_rng(1).integers(0, 2**12, 60).astype(np.uint64))
    fp = np.unique(fp)
    got = set()
    for i, j in simhash._trie_pairs(np.zeros(len(fp), np.int64), fp, 2):
        got |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert got == {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if bin(int(fp[i] ^ fp[j])).count("1") <= 2}


def test_simhash_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = {d: plain_fingerprint(t, 3) for d, t in docs}
    ids = sorted(fps)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2])
    got = simhash.query(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", want[d]) for d in ids}


def test_simhash_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, "a b c"), (8, "A b\tC"), (8, "A b\tC"), (None, "a b c"), (None, "lonely words here"), (4, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as rep", "'x' as bits")
    got = sorted(((r.doc, r.component_id) for r in simhash.near_duplicates(df, shingle_words=3, max_bits=2).collect()), key=repr)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (8, 8), (None, 8), (None, None), (4, 4)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def vectors(seed=0, n=400, dup=120):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    near = x[rng.integers(0, n, dup)] + 0.25 * rng.standard_normal((dup, 64))
    return np.concatenate([x, near])


def plain_links(x, labels, least):
    n = np.linalg.norm(x, axis=1)
    s = (x @ x.T / np.outer(n, n) >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(s, False)
    return s


@pytest.mark.parametrize("block", [768, 16])
def test_embeddings_recall_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    x = vectors()
    labels = np.zeros(len(x), int)
    s = plain_links(x, labels, 0.93)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec: r for r in embedding_dedup.near_vectors(df).collect()}
    assert all(got[i].n_links <= s[i].sum() for i in range(len(x)))
    assert sum(r.n_links for r in got.values()) >= 0.95 * s.sum() > 0
    assert all(got[i].component_id <= i for i in range(len(x)))


def test_embeddings_odd_rows(spark):
    a, b = [1.0] * 64, [1.0] * 63 + [1.01]
    rows = [(1, a, 0), (2, b, 0), (2, b, 0), (3, a, 1), (4, a, None), (5, None, 0), (6, [0.0] * 64, 0), (7, [None] + a[1:], 0), (8, [float("nan")] + a[1:], 0), (9, [float("inf")] + a[1:], 0), (10, [1.0, 2.0], 0), (11, [1.0, 2.0], 0), (None, a, 0), (12, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as vec", "2 as n", "'c' as code")
    got = sorted(((r.vec, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()), key=repr)
    want = [(1, 1, 1), (2, 1, 1), (2, 1, 1), (10, 1, 10), (11, 1, 10), (None, 0, None)] + [(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 12)]
    assert got == sorted(want, key=repr)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_rotation_balances_bits():
    x = np.random.default_rng(2).standard_normal((2000, 64)) @ np.diag(np.linspace(1, 3, 64))
    p = embedding_dedup.fit_itq(x, 64)
    share = (x @ p >= 0).mean(0)
    assert p.shape == (64, 64) and np.abs(share - 0.5).max() < 0.1 and np.allclose(p.T @ p, np.eye(64), atol=1e-6)


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"new{rng.randint(0, 10**6)}"
    return out


@pytest.mark.parametrize("deal_rows", [256, 4])
def test_similar_documents_against_plain(spark, deal_rows):
    from quittance.llm import near_text

    rng = random.Random(8)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for g in range(25):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 150))] + (passage if g % 2 else [])
        texts += [" ".join(base)] + [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.05]))) for _ in range(rng.randint(0, 5))]
    texts += [None, "", " \n", "Same Words here", "same words HERE", "same words"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (None, "nobody else says this")]
    sets = {i: set(near_text.shingle_hashes(near_text._words(t), 5).tolist()) for i, t in enumerate(texts)}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = groups(list(sets), [(i, j) for i in sets for j in range(i) if alike(sets[i], sets[j])])
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as keys")
    got = sorted(((r.doc, r.component_id) for r in near_text.similar_documents(df, deal_rows=deal_rows).collect()), key=repr)
    assert got == sorted([*want.items(), (0, want[0]), (None, want[0]), (None, None)], key=repr)
    assert near_text.similar_documents(df.limit(0)).count() == 0


def test_all_groups_of_a_value_meet(spark):
    from quittance.llm import near_text

    # 20 rows of one group, 11 of others, none in a small deal; the large group need not meet itself
    group = {i: 0 if i < 20 else i // 2 for i in range(31)}
    rows = [(7, i, i, g) for i, g in group.items()]
    members = spark.createDataFrame(rows, "value long, rep long, th long, group long")
    for deal_rows in (4, 8, 100):
        blocks = {}
        for r in near_text._across(members, deal_rows).collect():
            blocks.setdefault((r.b1, r.b2), []).append((r.rep, r.own))
        met = {(a, b) for (b1, b2), at in blocks.items() for a, x in at for b, y in at if a < b and (b1 == b2 or x != y)}
        assert met >= {(a, b) for b in group for a in range(b) if group[a] != group[b]}
        assert deal_rows == 100 or not any(b < 20 for _, b in met)


def test_full_deals_lose_no_pair(spark):
    from quittance.llm import near_text

    # texts of one long passage and a few words of their own: all share least shingles, some pairs are similar and most are not
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(90)]
    texts = []
    for g in range(40):
        base = passage + [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 60))]
        texts += [" ".join(base), " ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.04])))]
    rng.shuffle(texts)
    sets = [set(near_text.shingle_hashes(near_text._words(t), 5).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = groups(list(range(len(texts))), pairs)
    assert 20 < len(set(want.values())) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for deal_rows in (2, 8, 256):
        assert {r.doc: r.component_id for r in near_text.similar_documents(df, deal_rows=deal_rows).collect()} == want


def test_rarest_shingles_of_similar_sets_meet():
    from quittance.llm import near_text

    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sets += [base, np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 63, 2).astype(np.uint64)]))]
    counts = np.zeros(near_text.COUNTERS, np.int64)
    for s in sets:
        np.add.at(counts, near_text._bucket(s), 1)
    some = [set(near_text.rarest(s, counts, 0.8).tolist()) for s in sets]
    whole = [set(s.tolist()) for s in sets]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(whole[i] & whole[j]) >= 0.8 * len(whole[i] | whole[j])]
    assert len(near) > 20 and all(some[i] & some[j] for i, j in near)


def test_repeats_do_not_part_equal_shingles(spark):
    from quittance.llm import near_text

    rows = []
    for g in range(12):
        rng = random.Random(g)
        text = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200))
        phrase = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(6)) + " "
        rows += [(2 * g, f"{text} {phrase}"), (2 * g + 1, f"{text} {phrase * 33}")]
    sets = [set(near_text.shingle_hashes(near_text._words(t), 5).tolist()) for _, t in rows]
    assert all(len(a & b) >= 0.9 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    got = {r.doc: r.component_id for r in near_text.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def plain_vectors(rows, least):
    """{vec: (n_links, component)} of (vec, vector, label) rows whose ids are distinct."""
    x = np.array([v for _, v, _ in rows])
    s = plain_links(x, np.array([k for _, _, k in rows]), least)
    ids = [i for i, _, _ in rows]
    comp = groups(sorted(ids), [(ids[i], ids[j]) for i, j in np.argwhere(s)])
    return {i: (int(s[k].sum()), comp[i]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("entry", [64, 1])
def test_embeddings_against_plain(spark, monkeypatch, entry):
    # all pairs of a label meet where links are very close; with ENTRY 1 the tables have more bits and there are more of them
    monkeypatch.setattr(embedding_dedup, "ENTRY", entry)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 64))
    x = np.concatenate([x, x[:60] + 0.01 * rng.standard_normal((60, 64)), x[:40], x[:40], np.tile(x[0], (50, 1))])
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(rng.permutation(len(x)), x, rng.integers(0, 2, len(x)), strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, least=0.98).collect()}
    assert got == plain_vectors(rows, 0.98) and sum(n for n, _ in got.values()) > 1000


def test_tables_grow_with_the_vectors():
    sizes = [embedding_dedup.tables(n, 0.93) for n in (10, 10**4, 10**6, 10**9)]
    assert [b for _, b in sizes] == sorted(b for _, b in sizes) and sizes[0] == (8, 8)
    assert all(n / 2**b <= 64 for n, (_, b) in zip((10, 10**4, 10**6, 10**9), sizes, strict=True))
    assert all(1 - (1 - (1 - np.arccos(0.93) / np.pi) ** b) ** t >= embedding_dedup.RECALL for t, b in sizes)


def test_embeddings_query_columns_and_recall(spark, tmp_path):
    x = vectors(seed=4, n=800, dup=300)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = plain_vectors(rows, 0.93)
    got = {r.vec_id: r for r in embedding_dedup.query(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(r.n_links <= want[i][0] and r.component_id >= want[i][1] for i, r in got.items())
    found, all_ = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    print(f"recall {found / all_:.3f} of {all_} links")
    assert found >= 0.9 * all_ > 0


def test_pieces_give_the_shingles_of_the_whole(monkeypatch):
    import xxhash

    from quittance.llm import near_text

    rng = random.Random(3)
    texts = ["", None, " \n ", "One", "a b c d", "a b c d e", "x" * 500, " ".join(f"W{rng.randint(0, 50)}" + " " * rng.randint(0, 30) for _ in range(400)), "é ü " * 90]
    plain = []
    for t in texts:
        words = near_text._words(t)
        plain.append((near_text._sketch(t, 5), np.unique(near_text.shingle_hashes(words, 5)), xxhash.xxh64_intdigest(b" ".join(words), near_text.SEED)))
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(near_text, "_PIECE", piece)
        for t, (sketch, whole, content) in zip(texts, plain, strict=True):
            assert near_text._sketch(t, 5) == sketch and sketch[1] == content
            assert near_text.shingle_set(t, 5).tolist() == whole.tolist()


def test_deals_are_cut_by_bytes_and_not_repeated(spark, monkeypatch):
    from quittance.llm import near_text

    # pairs that share all six keys move once; a deal of few but long texts becomes blocks that its least member ties together
    nodes = [(2 * g + i, g, 10, [g * 10 + k for k in range(6)]) for g in range(5) for i in range(2)]
    df = spark.createDataFrame(nodes, "rep long, th long, bytes long, keys array<long>")
    dealt, full, _ = near_text._dealt(df, 256)
    assert sorted((r.at, r.rep) for r in dealt.collect()) == [(0, i) for i in range(10)] and full.count() == 0
    monkeypatch.setattr(near_text, "DEAL_BYTES", 30)
    df = spark.createDataFrame([(i, 0, 1000 if i == 0 else 10, [1]) for i in range(40)], "rep long, th long, bytes long, keys array<long>")
    dealt, full, _ = near_text._dealt(df, 256)
    rows = [(r.b1, r.rep) for r in dealt.collect()]
    assert full.count() == 40 and {b for b, _ in rows} == {b for b, i in rows if i == 1} and len({b for b, _ in rows}) == 47
    assert sum(i == 0 for _, i in rows) == 1 and {i for _, i in rows} == set(range(40))


def test_similar_documents_with_small_bounds_of_bytes(spark, monkeypatch):
    from quittance.llm import near_text

    rng = random.Random(12)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(20, 400))] + [f"p{i}" for i in range(30)]
        texts += [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02]))) for _ in range(rng.randint(1, 6))]
    sets = [set(near_text.shingle_set(t, 5).tolist()) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = groups(list(range(len(sets))), near)
    for most in (500, 6000):
        monkeypatch.setattr(near_text, "DEAL_BYTES", most)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.doc: r.component_id for r in near_text.similar_documents(df).collect()} == want


def test_filter_before_a_shuffle_loses_no_partner(spark, monkeypatch):
    from quittance.llm import near_text

    rows = spark.range(-3000, 3000).selectExpr("id as value", "id * 7 as bucket")
    few = spark.range(-500, 500).selectExpr("id * 6 as value")
    for bits, most in ((1 << 26, 1000), (1 << 15, 1400), (8, 6000)):
        monkeypatch.setattr(near_text, "FILTER_BITS", bits)
        got = [r.value for r in near_text._only(rows, few, "value").collect()]
        assert len(got) == len(set(got)) and {v * 6 for v in range(-500, 500)} <= set(got) and len(got) <= most
    assert near_text._only(rows, few.limit(0), "value").count() == 0
