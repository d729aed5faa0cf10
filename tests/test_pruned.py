"""Ranking from stored indexes: the same rows as by full passes, from fewer blocks and partitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import impact, lexical, partitions, store


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    pick = lambda: words[min(int(r.expovariate(0.03)), 299)]
    rows = [(f"d{i}", i, " ".join(pick() for _ in range(r.randint(0, 60)))) for i in range(1500)]
    # Equal texts tie; some have no content.
    rows += [(f"t{i}", 2000 + i, rows[3][2]) for i in range(30)] + [("none", 3000, None), ("empty", 3001, ""), ("rare", 3002, "w299 zebra zebra " + "w1 " * 500)]
    return spark.createDataFrame(rows, "id string, index long, content string").repartition(5)


@pytest.mark.parametrize(("per_shard", "block", "k"), [(20_000, 128, 10), (300, 8, 10), (100, 4, 3), (20_000, 1, 2000)])
def test_impact_order_ranks_like_full_passes(spark, docs, per_shard, block, k):
    r = random.Random(k)
    questions = [(i, " ".join(f"W{r.randrange(300)}" for _ in range(r.randint(1, 6)))) for i in range(25)]
    questions += [(90, "zebra"), (91, "unknown words only"), (92, ""), (93, None), (94, "w1 w1 w1 zebra")]
    asked = spark.createDataFrame(questions, "qid long, question string")
    ix = impact.build(docs, per_shard=per_shard, block=block)
    got = {(x["qid"], x["rank"]): (x["id"], round(x["score"], 6)) for x in impact.ranking(ix, asked, k, digits=9).collect()}
    full = lexical.bm25_ranking(lexical.index(docs.select("id", "content")), asked, docs, k, digits=9)
    want = {(x["qid"], x["rank"]): (x["id"], round(x["score"], 6)) for x in full.collect()}
    assert got == want and len(want) > 25


def test_blocks_that_cannot_matter_are_not_read(spark, docs):
    """A common term's list is read as far as it can help, and where a rare term decides, in the shard that has it."""
    ix = impact.build(docs, per_shard=100, block=4)
    asked = ix.asked(spark.createDataFrame([(1, "w1"), (2, "zebra w1")], "qid long, question string"))
    for qid, k in ((1, 3), (2, 1)):
        b = impact.bounds(ix, asked.where(F.col("qid") == qid), k).collect()
        read = sum(x["n"] for x in b if x["read"])
        assert k <= read < 0.3 * sum(x["n"] for x in b)


def test_counts_in_the_row(spark):
    df = spark.createDataFrame([(1, "b a b ä b2 b"), (2, ""), (3, None), (4, "a")], "id long, c string")
    counts = df.select("id", impact.term_counts(tokens(F.col("c"))).alias("x")).collect()
    plain = df.select("id", F.explode(tokens(F.col("c"))).alias("t")).groupBy("id", "t").count().collect()
    assert {(r["id"], p["term"], p["tf"]) for r in counts for p in r["x"] or []} == {tuple(x) for x in plain}


def test_empty_index(spark, docs):
    none = impact.build(docs.limit(0))
    assert impact.ranking(none, spark.createDataFrame([(1, "w1")], "qid long, question string"), 5).count() == 0


@pytest.mark.parametrize(("parts", "k"), [(None, 5), (1, 3), (200, 20)])
def test_partitions_rank_like_full_passes(spark, parts, k):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8))
    vectors = [(centres[i % 12] + 0.15 * r.normal(size=8)).tolist() for i in range(1200)]
    vectors += [vectors[5]] * 20 + [[0.0] * 8] * 3 + [None, [1.0, 2.0]]
    rows = spark.createDataFrame([(f"v{i}", v, i) for i, v in enumerate(vectors)], "id string, embedding array<double>, index int").repartition(4)
    asks = spark.createDataFrame([(i, vectors[37 * i]) for i in range(20)] + [(50, [0.0] * 8), (51, None), (52, [-1.0] * 8)], "qid long, qvec array<double>")
    vp = partitions.build(rows, parts)
    got, read = partitions.nearest(vp, asks, k, digits=9)
    want = store.nearest(asks, rows, k, digits=9)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()}
    seen = {x["qid"]: x["parts_read"] / x["parts"] for x in read.collect()}
    assert set(seen) == {*range(20), 50, 52} and all(x <= 1 for x in seen.values())
    if parts is None:
        assert np.mean([seen[i] for i in range(20)]) < 0.5
        # The bound holds for every row of every partition.
        stored = vp.rows.toPandas()
        unit = np.array([x["qvec"] for x in asks.where("qid < 20").collect()])
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        most = vp.ceilings(unit)
        cos = unit @ np.stack(stored["unit"]).T
        assert (cos <= most[:, stored["part"].to_numpy()] + 1e-9).all()


def test_empty_partitions(spark):
    rows = spark.createDataFrame([], "id string, embedding array<double>, index long")
    vp = partitions.build(rows)
    got, _ = partitions.nearest(vp, spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<double>"), 3)
    assert got.count() == 0 and math.isinf(vp.radii[0])


def test_postings_are_in_blocks_before_anything_moves(spark, docs):
    """No posting is shuffled when the index is made: a shard's documents are those of one task, and its blocks are whole."""
    ix = impact.build(docs, per_shard=100, block=4)
    made = ix.blocks.select("shard", "term", "block", "n", F.size("at").alias("at"), "top", F.array_max("impact").alias("most")).collect()
    assert len({(x["shard"], x["term"], x["block"]) for x in made}) == len(made)
    assert all(x["n"] == x["at"] <= 4 and x["top"] == x["most"] for x in made)
    per = ix.blocks.select("shard", F.explode("at").alias("i")).distinct().groupBy("i").count().agg(F.max("count")).first()[0]
    assert per == 1
    tasks = {x["shard"] >> 32 for x in made}
    size = ix.blocks.select("shard", F.explode("at").alias("i")).distinct().groupBy("shard").count().agg(F.max("count")).first()[0]
    assert len(tasks) > 1 and size <= 100
    asked = {x["term"]: x["idf"] for x in ix.asked(spark.createDataFrame([(1, "w1 zebra unknown")], "qid long, question string")).collect()}
    assert asked.keys() == {"w1", "zebra"} and asked["zebra"] > asked["w1"]


def test_terms_are_stored_by_parts_and_counted_as_numbers(spark, docs):
    """a row for each term of each shard was most of the time. Pairs may read like words; digits part them."""
    odd = [(0, "a b a_b a b"), (1, "a_b c a b_c"), (2, "x 7 y 8% 9 z"), (3, ""), (4, None), (5, "٣ a é_ b"), (6, "a")]
    ix = impact.build(spark.createDataFrame([(str(i), i, t) for i, t in odd], "id string, index long, content string"))
    got = {(x["term"], i): v for x in ix.blocks.collect() for i, v in zip(x["at"], x["impact"], strict=True)}
    counts = spark.createDataFrame(odd, "i long, c string").select("i", tokens(F.col("c")).alias("t"))
    size = {r["i"]: len(r["t"] or []) for r in counts.collect()}
    avg = sum(size.values()) / len(odd)
    tf = {(r["term"], r["i"]): r["count"] for r in counts.select("i", F.explode("t").alias("term")).groupBy("term", "i").count().collect()}
    assert got == pytest.approx({k: n * 2.5 / (n + 1.5 * (0.25 + 0.75 * size[k[1]] / avg)) for k, n in tf.items()}) and ("a_b", 0) in tf
    many = spark.range(200).select(F.col("id").cast("string"), F.col("id").alias("index"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda x: F.concat(F.lit("w"), (F.col("id") * 3000 + x).cast("string"))), " ").alias("content")).coalesce(1)
    wide = impact.build(many)
    assert wide.packed.count() * 8 < wide.blocks.count() == 200 * 5999
    few = wide.of_terms(spark.createDataFrame([("w5",), ("w5_w6",), ("none",)], "term string"), "term", "n", "at").collect()
    assert sorted((x["term"], x["n"], x["at"]) for x in few) == [("w5", 1, [0]), ("w5_w6", 1, [0])]
