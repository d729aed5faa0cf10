import math
import resource

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import lexical, store
from corpusloom.operators.best import Best
from corpusloom.session import configure


def test_best_keeps_the_first_of_equals_in_any_blocks():
    rng = np.random.default_rng(3)
    score = rng.integers(0, 6, (7, 90)) / 4.0
    score[2, 5] = np.nan
    index = rng.permutation(90)
    want = np.lexsort((np.broadcast_to(index, score.shape), -np.where(np.isnan(score), np.inf, score)), axis=1)[:, :4]
    for rows, lines in ((1, 1), (7, 2), (90, 7), (3, 5)):
        best = Best(7, 4)
        for i in range(0, 90, rows):
            for q in range(0, 7, lines):
                best.add(q, score[q : q + lines, i : i + rows], index[i : i + rows], np.arange(90).astype(object)[i : i + rows])
        assert (best.name == want).all() and best.full.all()
    few = Best(1, 4)
    few.add(0, np.array([[1.0, -np.inf]]), np.array([0, 1]), np.array(["a", "b"], dtype=object))
    kind = pa.schema([("qid", pa.int64()), ("id", pa.string()), ("index", pa.int64()), ("score", pa.float64())])
    assert [r for b in few.rows([9], kind) for r in b.to_pylist()] == [{"qid": 9, "id": "a", "index": 0, "score": 1.0}]


def test_equal_documents_have_equal_scores_to_the_last_bit(spark):
    """sums in the order of a matrix product differ from row to row, and rounding to 12 places then parts equals."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(words, 150))) for i in range(300)]
    docs += [(1000 + i, t) for i, t in docs]
    d = spark.createDataFrame(docs, "id long, content string").repartition(3)
    questions = spark.createDataFrame([(q, " ".join(rng.choice(words, 120))) for q in range(40)], "qid long, question string")
    got = lexical.bm25_ranking(lexical.index(d), questions, d.withColumn("index", F.col("id")), 600, digits=12).collect()
    score = {(r["qid"], r["id"]): r["score"] for r in got}
    assert len(score) == 40 * 600
    assert all(score[q, i] == score[q, i - 1000] for q, i in score if i >= 1000)
    rank = {(r["qid"], r["id"]): r["rank"] for r in got}
    assert all(rank[q, i] > rank[q, i - 1000] for q, i in rank if i >= 1000)


def _grown(task, batches) -> float:
    """MB by which the largest size of a fresh process grows in a task."""
    import multiprocessing

    def run(out):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        rows = sum(b.num_rows for b in task(iter(batches)))
        out.put((rows, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024))

    fork = multiprocessing.get_context("fork")
    q = fork.Queue()
    p = fork.Process(target=run, args=(q,))
    p.start()
    rows, mb = q.get(timeout=120)
    p.join()
    assert rows
    return mb


def test_scores_in_a_task_do_not_grow_with_queries_times_rows(spark):
    """4000 questions and batches of 10,000 rows made a matrix of 320 MB, several times over."""
    rng = np.random.default_rng(1)
    task = []

    class Rows:
        """Rows that give away the function they are mapped with."""

        def __init__(self, df):
            self.df, self.schema, self.sparkSession = df, df.schema, df.sparkSession

        def select(self, *columns):
            return self

        def mapInArrow(self, f, kind):  # noqa: N802
            task.append(f)
            return spark.createDataFrame([], kind)

    queries = spark.range(4000).select(F.col("id").alias("qid"), F.array(*[F.rand(i) for i in range(8)]).alias("qvec"))
    store.nearest(queries, Rows(spark.createDataFrame([], "id long, embedding array<double>, index long")), 5)
    vectors = pa.array(list(rng.random((10_000, 8))), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), vectors, pa.array(np.arange(10_000))], names=["id", "embedding", "index"])
    assert _grown(task[0], [batch]) < 200


def test_lexical_scores_in_a_task_are_bounded():
    """terms of the questions times rows of a batch was a matrix of its own."""
    rng = np.random.default_rng(2)
    known = [f"t{i}" for i in range(20_000)]
    terms = [sorted(set(rng.choice(known, 150))) for _ in range(200)]
    kind = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("index", pa.int64()), ("score", pa.float64())])
    run = lexical._scorer(list(range(200)), terms, dict.fromkeys(known, 3), 10_000, 40.0, 5, 9, 1.5, 0.75, kind)
    held = pa.array([list(rng.choice(known, 40)) for _ in range(10_000)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(np.arange(10_000)), held], names=["id", "index", "t"])
    assert _grown(run, [batch]) < 250


def test_arrow_batches_are_bounded(spark):
    """batches of 10,000 rows of whatever length went to Python functions."""
    from pyspark.sql.types import LongType, StructType

    configure(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 5000, 1, 1).mapInArrow(sizes, StructType().add("n", LongType())).collect()
    assert max(r["n"] for r in rows) <= 1000 and math.fsum(r["n"] for r in rows) == 5000

