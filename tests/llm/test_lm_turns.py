"""Language-model scores with buckets asked in turns."""

import random

import pytest

from corpusloom.llm import lm


def test_no_turn_has_all_blocks_and_scores_are_the_same(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{r.getrandbits(20):x}" for _ in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 400)))) for i in range(200)] + [(200, None), (None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    taken, plain = [], lm.answered

    def answered(blocks, buckets):
        taken.append(blocks.selectExpr("sum(length(grams) + length(words))").first()[0])
        return plain(blocks, buckets)

    monkeypatch.setattr(lm, "answered", answered)
    key = lambda x: (x[0] is None, x[0])
    scores = lambda **o: sorted((tuple(x) for x in lm.lm_scores(docs, slice_bytes=1 << 16, **o).collect()), key=key)
    want = scores(turns=1)
    whole, taken[:] = taken[0], []
    got = scores()
    assert len(taken) > 1 and sum(taken) == whole and max(taken) < 0.6 * whole
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for k in (5, 6):
        assert [x[k] for x in got] == pytest.approx([x[k] for x in want], rel=1e-12)
