import random
import zlib
from itertools import product

import duckdb
import pytest
from oracle import rows_of, rows_of_sql

from quittance.llm import name_join

SF = "/root/testdata/sf0.01"


def one_edit(s, letters):
    yield from (s[:i] + s[i + 1 :] for i in range(len(s)))
    yield from (s[:i] + c + s[i:] for i in range(len(s) + 1) for c in letters)
    yield from (s[:i] + c + s[i + 1 :] for i in range(len(s)) for c in letters)
    yield from (s[:i] + s[i + 1] + s[i] + s[i + 2 :] for i in range(len(s) - 1))


def test_distance_is_the_shortest_way():
    """Against a search over single edits, one after another."""
    words = ["".join(w) for n in range(5) for w in product("abc", repeat=n)]
    for start in ("", "ca", "abca", "cab", "aab", "bbbb"):
        far, level = {start: 0}, {start}
        for k in range(1, 4):
            level = {y for x in level for y in one_edit(x, "abc") if y not in far and len(y) <= 6}
            far.update(dict.fromkeys(level, k))
        for w in words:
            if w in far:
                assert name_join.damerau_levenshtein(start, w) == name_join.damerau_levenshtein(w, start) == far[w]
    assert name_join.damerau_levenshtein("ca", "abc") == 2


@pytest.mark.parametrize(("edits", "agree"), [(0, 1), (1, 1), (1, 2), (1, 3), (2, 2), (3, 1)])
def test_a_set_of_chunks_stays_whole(edits, agree):
    sets = name_join.chunk_sets(edits, agree)
    chunks = 2 * edits + agree
    for hit in product(range(chunks - 1), repeat=edits):
        spoilt = {i for h in hit for i in (h, h + 1)}
        assert any(spoilt.isdisjoint(s) for s in sets)


@pytest.mark.parametrize(("edits", "agree", "least"), [(1, 2, 3), (1, 1, 1), (1, 3, 1), (2, 2, 2), (2, 1, 1), (0, 1, 1)])
def test_pairs_against_all_pairs(spark, edits, agree, least):
    rng = random.Random(edits * 10 + agree)
    base = ["".join(rng.choice("abé𝄞 ") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    ours = [*base, "a", "ab", "ba", None, "", "x" * 200, base[0]]
    theirs = [None, "", "a", "b", "x" * 199 + "y", "x" * 201]
    for w in base:
        for _ in range(4):
            for _ in range(rng.randint(0, edits + 1)):
                w = rng.choice(list(one_edit(w, "abé𝄞 ")))
            theirs.append(w)
    df = [spark.createDataFrame([(x, 1) for x in side], "name string, key int") for side in (ours, theirs)]
    got = sorted(tuple(r) for r in name_join.near_names(*df, max_edits=edits, agree=agree, least_chunk=least).collect())
    want = sorted((a, b, d) for a in {x for x in ours if x} for b in {x for x in theirs if x} if (d := name_join.damerau_levenshtein(a, b)) <= edits)
    assert got == want
    assert len(want) > 30


def misspelt(i, name):
    h = zlib.crc32(str(i).encode())
    if h % 2 or len(name) < 2:
        return name
    k = h % (len(name) - 1)
    return name[:k] + name[k + 1] + name[k] + name[k + 2 :]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs_and_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    c = duckdb.connect()
    for t in ("clients", "vendors"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = rows_of(name_join.query(spark, d))
    assert got == rows_of_sql(c, name_join.ORACLE_SQL)
    want = {}
    clients = c.execute("SELECT client_id, name FROM clients WHERE length(name) > 0").fetchall()
    for v, name in c.execute("SELECT vendor_id, name FROM vendors WHERE length(name) > 0").fetchall():
        for k, other in clients:
            if abs(len(name) - len(other)) <= 1 and (far := name_join.damerau_levenshtein(misspelt(v, name), other)) <= 1:
                want.setdefault((v, far), []).append(k)
    assert got[1] == sorted(((sum(zlib.crc32(str(k).encode()) for k in ks), far, min(ks), len(ks), v) for (v, far), ks in want.items()), key=repr)
    assert want


def test_odd_rows(spark):
    clients = [(1, "ab", 5), (2, "ba", 5), (2, "ba", 6), (None, "ab", 5), (3, None, 5), (4, "", 5), (5, "abc", 5), (6, "é", 5), (7, "xyz" * 3000, 5)]
    vendors = [(10, "ab"), (10, "ab"), (None, "ab"), (11, None), (12, ""), (10, "abc"), (13, "e"), (14, "xyz" * 3000 + "q")]
    c = spark.createDataFrame(clients, "client_id long, name string, distance int")
    v = spark.createDataFrame(vendors, "vendor_id long, name string")
    got = {(r.vendor_id, r.distance): (r.n_clients, r.first_client_id, r.clients_crc) for r in name_join.join_by_name(c, v).collect()}
    crc = lambda *ids: sum(zlib.crc32(str(i).encode()) for i in ids)
    assert got == {
        (10, 0): (3, 1, crc(1, 5)), (10, 1): (4, 1, crc(2, 5, 1)), (None, 0): (2, 1, crc(1)), (None, 1): (2, 2, crc(2, 5)), (13, 1): (1, 6, crc(6)), (14, 1): (1, 7, crc(7)),
    }
    assert name_join.join_by_name(c.limit(0), v).count() == 0
    assert name_join.join_by_name(c, v.limit(0)).count() == 0


def test_a_name_that_a_third_bears(spark):
    clients = spark.range(3000).selectExpr("id AS client_id", "CASE WHEN id % 3 = 0 THEN 'Joelma Dalmaberber' ELSE concat('N', id, ' Some Name') END AS name")
    vendors = spark.range(90).selectExpr("id AS vendor_id", "CASE WHEN id % 3 = 0 THEN 'Joelma Dalmabreber' ELSE concat('V', id, ' Other') END AS name")
    got = name_join.join_by_name(clients, vendors).collect()
    assert {(r.vendor_id, r.distance, r.n_clients, r.first_client_id) for r in got} == {(i, 1, 1000, 0) for i in range(0, 90, 3)}
