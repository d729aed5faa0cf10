import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.segments import SegmentStore
from corpusloom.operators.store import VectorStore
from corpusloom.streaming.ingest import ingest_changes

DOCS = "id string, content string, metadata map<string,string>, ord long"
CHANGES = "seq long, gone boolean, doc_id string, content string, metadata map<string,string>"


@pytest.fixture
def filled(spark, tmp_path):
    s = SegmentStore(spark, f"file://{tmp_path}/store", buckets=4)
    s.add(docs(spark, *[(f"d{i}", f"text {i}") for i in range(12)]))
    return s


def docs(spark, *rows):
    return spark.createDataFrame([(i, c, {}, k) for k, (i, c) in enumerate(rows)], DOCS)


def texts(s, version=None):
    return sorted(((r["doc_id"], r["content"]) for r in s.rows(version).collect()), key=repr)


def test_same_rows_as_the_store_in_memory(spark, filled):
    a, b = docs(spark, *[(f"d{i}", f"text {i}") for i in range(12)]), docs(spark, ("d3", "more"), (None, "no id"))
    plain, found = VectorStore(spark).add(a).delete("d3")
    assert found and filled.delete(spark.createDataFrame([("d3",), ("none",)], "doc_id string")) == 1
    filled.add(b)
    plain = plain.add(b)
    key = lambda rows: sorted((r["index"] > 11, repr(r["id"]), r["content"], repr(r["doc_id"]), r["embedding"]) for r in rows.collect())
    assert key(filled.rows()) == key(plain.records)
    want = [(r["id"], r["content"]) for r in plain.search("more", 3).collect()]
    assert [(r["id"], r["content"]) for r in filled.view().search("more", 3).collect()] == want
    assert want[0] == ("d3", "more")


def test_delete_of_null_and_of_nothing(spark, filled):
    assert filled.delete(spark.createDataFrame([("none",)], "doc_id string")) == 0 and filled.state().version == 1
    filled.add(docs(spark, (None, "x"), (None, "y")))
    assert filled.delete(spark.createDataFrame([(None,), (None,)], "doc_id string")) == 2
    assert len(texts(filled)) == 12


def test_versions_and_compaction(spark, filled):
    filled.replace(docs(spark, ("d1", "new"), ("d1", "newer"), ("d20", "first")))
    filled.delete(spark.createDataFrame([("d2",), ("d1",)], "doc_id string"))
    filled.add(docs(spark, ("d2", "back")))
    before = filled.rows().collect()
    assert ("d1", "newer") in texts(filled, 2) and ("d1", "text 1") in texts(filled, 1) and ("d2", "back") in texts(filled)
    assert filled.compact() and sorted(filled.rows().collect()) == sorted(before)
    # Nothing that replaces is left, so there is nothing to do; buckets without changes stay in the first segment.
    state = filled.state()
    assert not any(v["replaces"] for v in state.segments.values()) and not filled.compact()
    assert filled.compact(everything=True) and len(filled.state().segments) == 1 and not filled.compact(everything=True)
    assert sorted(filled.rows().collect()) == sorted(before)
    assert filled.vacuum() > 0 and sorted(filled.rows().collect()) == sorted(before) and filled.vacuum() == 0


def test_only_touched_buckets_are_rewritten(spark, filled):
    ids = {r["doc_id"]: r["bucket"] for r in filled._scan(filled.state()).collect()}
    gone = ids["d5"]
    filled.delete(spark.createDataFrame([("d5",)], "doc_id string"))
    assert filled.compact()
    first, new = sorted(filled.state().segments.values(), key=lambda v: len(v["without"]), reverse=True)
    assert first["without"] == [gone] and new["buckets"] in ([gone], [])
    assert [i for i, _ in texts(filled)] == sorted(set(ids) - {"d5"})


def test_changes_during_a_compaction_stay(spark, filled, monkeypatch):
    """Rows that are written anew count from the version that was read, so later deletions reach them."""
    filled.delete(spark.createDataFrame([("d5",)], "doc_id string"))
    other, write = SegmentStore(spark, filled.path, buckets=4), filled._write

    def meanwhile(rows):
        line = write(rows)
        other.delete(spark.createDataFrame([("d6",), ("d7",)], "doc_id string"))
        other.add(docs(spark, ("d7", "again")))
        return line

    monkeypatch.setattr(filled, "_write", meanwhile)
    assert filled.compact(everything=False)
    want = sorted([(f"d{i}", f"text {i}") for i in range(12) if i not in (5, 6, 7)] + [("d7", "again")])
    assert texts(filled) == want
    monkeypatch.setattr(filled, "_write", write)
    assert filled.compact(everything=True) and texts(filled) == want


def test_two_writers(spark, filled):
    line = {"name": "s-none", "holds": [], "count": 0, "bytes": 0, "replaces": False}
    assert filled._put(2, line) and not filled._put(2, line)
    filled.add(docs(spark, ("x", "y")))
    assert filled.state().version == 3 and len(texts(filled)) == 13


def test_batches_are_taken_once(spark, filled):
    rows = [(1, False, "d1", "old", {}), (2, False, "d1", "a", {"doc_id": "other"}), (2, False, "d1", "b", None), (3, True, "d2", None, None), (1, False, "d2", "x", {}), (1, True, "d40", None, None), (1, False, None, "n", {})]
    changes = spark.createDataFrame(rows, CHANGES)
    assert filled.apply(changes, ("s", 0)) and not filled.apply(changes, ("s", 0))
    want = sorted([(f"d{i}", f"text {i}") for i in range(12) if i not in (1, 2)] + [("d1", "a"), ("d1", "b"), (None, "n")], key=repr)
    assert texts(filled) == want and filled.apply(changes, ("s", 1)) and texts(filled) == want
    assert filled.compact() and not filled.apply(changes, ("s", 1)) and filled.apply(changes, ("t", 0)) and texts(filled) == want
    assert filled.apply(changes.limit(0), ("t", 1)) and not filled.apply(changes, ("t", 1)) and texts(filled) == want


def test_empty_store(spark, tmp_path):
    s = SegmentStore(spark, f"file://{tmp_path}/none")
    assert s.rows().count() == 0 and not s.compact() and s.vacuum() == 0
    assert s.delete(spark.createDataFrame([("a",)], "doc_id string")) == 0
    s.add(docs(spark, ("a", "b")).limit(0))
    assert s.rows().count() == 0 and s.delete(spark.createDataFrame([("a",)], "doc_id string")) == 0


def test_stream_of_changes(spark, tmp_path):
    def put(k, *rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")

    def run(checkpoint):
        q = ingest_changes(spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in"), s, f"{tmp_path}/{checkpoint}", "feed")
        q.awaitTermination()
        assert q.exception() is None

    s = SegmentStore(spark, f"file://{tmp_path}/store", buckets=4)
    put(0, (1, False, "a", "one", {}), (1, False, "b", "two", {}))
    run("at")
    put(1, (2, True, "a", None, None), (2, False, "c", "three", {}))
    run("at")
    assert texts(s) == [("b", "two"), ("c", "three")] and s.state().batches == {"feed": 1}
    version = s.state().version
    # With its checkpoint lost, the stream sends batch 0 again, now with both files: the store has it.
    run("other")
    assert s.state().version == version and texts(s) == [("b", "two"), ("c", "three")]
