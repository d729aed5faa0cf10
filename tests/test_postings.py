from collections import Counter

from corpusloom.operators import lexical


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_postings_are_counted_without_a_shuffle(spark):
    """F6, F8: every posting was shuffled by document and term."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "id long, content string")
    ix = lexical.index(docs)
    assert _exchanges(ix.postings) == 0
    assert {(r["id"], r["term"]): r["tf"] for r in ix.postings.collect()} == {(1, "a"): 2, (1, "b"): 1, (1, "a_b"): 1, (1, "b_a"): 1, (2, "b"): 1, (2, "c"): 1, (2, "b_c"): 1}
    assert {r["term"]: r["df"] for r in ix.idf.collect()} == {"a": 1, "b": 2, "c": 1, "a_b": 1, "b_a": 1, "b_c": 1}


def test_rows_of_one_id_are_added_up(spark):
    rows = [(1, "x y"), (1, "y z"), (None, "y"), (None, "y 7"), (2, "y")]
    ix = lexical.index(spark.createDataFrame(rows, "id long, content string"))
    want = Counter()
    for i, t in rows:
        w = t.split()
        want.update((i, x) for x in [*w, *("_".join(p) for p in zip(w, w[1:]) if "7" not in p)])
    got = [(r["id"], r["term"], r["tf"]) for r in ix.postings.collect()]
    assert len(got) == len(want) and all(want[i, x] == n for i, x, n in got)
    assert {r["term"]: r["df"] for r in ix.idf.collect()} == Counter(x for _, x in want)
