import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vector
from corpusloom.operators import generate, hybrid, lexical, store


@pytest.fixture(scope="module")
def filled(spark):
    rows = [(f"doc{i}", f"This is document number {i}.", {"department": "eng" if i % 2 else "mkt", "lang": "en" if i < 3 else "vi"}, i) for i in range(5)]
    return store.VectorStore(spark).add(spark.createDataFrame(rows, "id string, content string, metadata map<string,string>, ord long"))


def similarity(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    return df.select(vector.cosine(F.col("a"), F.col("b")).alias("s")).first()["s"]


def test_cosine(spark):
    assert similarity(spark, [1.0, 2.0], [1.0, 2.0]) == pytest.approx(1)
    assert similarity(spark, [1.0, 0.0], [0.0, 1.0]) == 0
    assert similarity(spark, [1.0, 0.0], [-1.0, 0.0]) == pytest.approx(-1)
    assert similarity(spark, [0.0, 0.0], [1.0, 1.0]) == 0


def test_mock_embedding_is_the_same_everywhere(spark):
    texts = ["hello", "", "Học phí"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vector.mock_embedding(F.col("t")).alias("v")).collect()
    for r in rows:
        assert r["v"] == pytest.approx(vector.mock_embed_text(r["t"]), abs=1e-12)
        assert len(r["v"]) == 64 and math.isclose(sum(x * x for x in r["v"]), 1)
    assert rows[0]["v"][:3] == pytest.approx([0.1353451932, 0.1193058742, -0.1028350251], abs=1e-9)


def test_search(filled):
    assert filled.size() == 5
    hits = filled.search("This is document number 3.", 3).collect()
    assert hits[0]["id"] == "doc3" and hits[0]["score"] == pytest.approx(1) and len(hits) == 3
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert filled.search("x", 0).count() == 0 and store.VectorStore(filled.spark).search("x").count() == 0
    assert {h["id"] for h in filled.search("x", 9, {"department": "eng"}).collect()} == {"doc1", "doc3"}
    assert filled.search("x", 9, {}).count() == 5


def test_delete(filled):
    less, found = filled.delete("doc2")
    assert found and less.size() == 4 and filled.size() == 5
    assert not less.delete("doc2")[1]


@pytest.mark.parametrize(("wanted", "want"), [({"a": 1}, True), ({"a": [1, 2]}, True), ({"a": []}, False), ({"b": None}, True), ({}, True), ({"a": None}, False), ({"a": 1, "b": "x"}, False)])
def test_filters(spark, wanted, want):
    df = spark.createDataFrame([({"a": "1"},)], "m map<string,string>")
    assert df.select(store.matches(F.col("m"), wanted).alias("x")).first()["x"] is want


def test_own_doc_id_wins_and_numbers_go_on(spark, filled):
    more = filled.add(spark.createDataFrame([("n", "new", {"doc_id": "given"}, 0)], "id string, content string, metadata map<string,string>, ord long"))
    r = more.records.where("id = 'n'").first()
    assert r["doc_id"] == "given" and r["index"] == 6


def test_bm25(spark):
    docs = spark.createDataFrame([("0", "a b"), ("1", "b c")], "id string, content string")
    q = spark.createDataFrame([("q", "a a")], "qid string, question string")
    ix = lexical.index(docs)
    assert [tuple(r) for r in lexical.bm25(ix, q).collect()] == [("q", "0", pytest.approx(0.693147, abs=1e-6))]
    every = q.select("qid").crossJoin(docs.select("id"))
    assert {r["id"]: r["score"] for r in lexical.bm25_all(ix, q, every).collect()}["1"] == 0
    toks = docs.limit(1).select(lexical.tokens(F.lit("2,5% phí học")).alias("t")).first()["t"]
    assert toks == ["2,5%", "phí", "học", "phí_học"]


def test_fusion_and_pool(spark):
    rows = [("q", "dense", 0, "x", 1), ("q", "dense", 0, "y", 2), ("q", "bm25", 3, "y", 1), ("q", "bm25", 3, "z", 2)]
    b = spark.createDataFrame(rows, "qid string, branch string, branch_ord int, id string, rank int")
    fused = hybrid.fuse(b)
    assert [(r["id"], round(r["fused"], 6)) for r in fused.orderBy("fused_rank").collect()] == [("y", 0.032522), ("x", 0.016393), ("z", 0.016129)]
    assert [r["id"] for r in hybrid.rerank_pool(fused, 1, 1).orderBy("pool_ord").collect()] == ["y", "x"]


def test_hybrid_scores(spark, filled):
    q = spark.createDataFrame([("q", "document number 4")], "qid string, question string")
    dense = hybrid.HybridRetriever(filled).retrieve(q, 2).collect()
    assert all(-1 <= r["score"] <= 1 and set(r["signals"]) == {"dense", "rrf"} for r in dense)
    only = hybrid.HybridRetriever(filled, hybrid.HybridOptions(use_dense=False, use_bm25=True)).retrieve(q, 1).first()
    assert only["id"] == "doc4" and only["score"] is None
    with pytest.raises(ValueError):
        hybrid.HybridRetriever(filled, hybrid.HybridOptions(use_hyde=True))
    ranked = hybrid.HybridRetriever(filled, hybrid.HybridOptions(use_bm25=True, use_hyde=True), generate.demo_llm, hybrid.overlap_score).retrieve(q, 2)
    assert ranked.where("rank = 1").first()["id"] == "doc4"


def test_agent_answers(spark, filled):
    q = spark.createDataFrame([("q", "document number 4")], "qid string, question string")
    answer = generate.run_agent(filled, q).first()["answer"]
    assert answer.startswith("[DEMO LLM]") and "\n" not in answer
    assert generate.run_agent(store.VectorStore(spark), q).first()["answer"] == generate.AGENT_NOT_FOUND


def test_cached_calls_are_made_once(spark):
    asked = spark.createDataFrame([("k1", "aa"), ("k1", "aa"), ("k2", "b")], "key string, text string")
    cache = spark.createDataFrame([("k2", 1)], "key string, value long")
    assert [tuple(r) for r in generate.call_missing(asked, cache, lambda x: [len(t) for t in x], "long").collect()] == [("k1", 2)]


def test_unknown_provider_falls_back():
    assert store.choose_embedder("none", {}) is store.MOCK


def test_prompt_templates(spark):
    q, c = spark.createDataFrame([(1, "why {x}?"), (2, "none")], "qid int, question string"), spark.createDataFrame([(1, "ctx")], "qid int, context string")
    out = {r["qid"]: r["prompt"] for r in generate.prompts(q, c, "nothing", "A {context} B {question} C {not_found} {other}").collect()}
    assert out == {1: "A ctx B why {x}? C nothing {other}", 2: None}


def test_bm25_ranking_is_the_join(spark):
    docs = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(["a b c", "a a d", "", "x y", "a b c", "c c c c d"])], "id string, index long, content string").repartition(3)
    queries = spark.createDataFrame([(1, "a b zz"), (2, "c c d"), (3, "nothing"), (4, "")], "qid int, question string")
    ix = lexical.index(docs.select("id", "content"))
    want = {(r["qid"], r["id"]): r["score"] for r in lexical.bm25(ix, queries).collect()}
    for size in (1 << 20, 1):
        got = {(r["qid"], r["id"]): (r["score"], r["rank"]) for r in lexical.bm25_ranking(ix, queries, docs, 10, query_bytes=size).collect()}
        assert set(got) == set(want) and all(abs(got[k][0] - want[k]) < 1e-9 for k in want)
        assert [got[1, i][1] for i in ("0", "4")] == [1, 2]
    assert lexical.bm25_ranking(ix, queries.limit(0), docs).count() == 0


def test_nearest_blocks_and_odd_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], 2), ("b", [1.0, 0.0], 1), ("c", [0.0, 0.0], 3), ("d", [0.0, 1.0, 5.0], 4), ("e", None, 5)], "id string, embedding array<double>, index long")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, None)], "qid int, qvec array<double>")
    for size in (1 << 20, 1):
        out = sorted((r["qid"], r["rank"], r["id"], round(r["score"], 6)) for r in store.nearest(queries, rows, 3, size).collect())
        assert out == [(1, 1, "b", 1.0), (1, 2, "a", 1.0), (1, 3, "c", 0.0), (2, 1, "d", round(1 / 26**0.5, 6)), (2, 2, "b", 0.0), (2, 3, "a", 0.0)]
    assert store.nearest(queries.limit(0), rows, 3).count() == 0
