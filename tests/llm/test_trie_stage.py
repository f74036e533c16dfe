"""The near-duplicate stage groups by the trie of fingerprints as well as by shingles."""

import corpus_pipeline
from quittance.llm import components, near_text, simhash


def test_stage_takes_links_of_both(spark, monkeypatch):
    words = [f"w{i}" for i in range(900)]
    near = words[:]
    near[450] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, "  "), (None, "an id is not here but the words are"), (6, " ".join(words[:850]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda: sorted((r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert kept() == [1, 3, None]
    # what only the trie links goes as well
    monkeypatch.setattr(simhash, "near_duplicates", lambda d: d.selectExpr("doc_id AS doc", "1L AS component_id").where("doc IN (1, 3)"))
    assert kept() == [1, None]


def test_stage_makes_fingerprints_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (None, "x y"), (4, "x y z")], "doc_id long, text string")
    want = sorted((r.doc, r.fp, r.component_id) for r in simhash.near_duplicates(docs).where("doc IS NOT NULL").collect())
    sketched = near_text.sketches(docs).withColumnRenamed("doc", "doc_id")
    monkeypatch.setattr(simhash, "fingerprints", None)
    assert sorted((r.doc, r.fp, r.component_id) for r in simhash.near_duplicates(sketched).where("doc IS NOT NULL").collect()) == want
    assert near_text.similar_documents(docs, sketched=sketched.withColumnRenamed("doc_id", "doc")).count() == 5


def test_rounds_of_components_broadcast_nothing(spark):
    found = components._with_min(spark.createDataFrame([(1, 2), (3, 2)], "u long, v long").repartition(2))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1), (3, 2, 2)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_components_keep_their_size(spark):
    n = 200
    links = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    found = components.connected_components(links)
    assert found.count() == n and {r.component for r in found.collect()} == {0}
    # every join multiplies the estimate of what it reads
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
