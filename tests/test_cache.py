import pytest
from pyspark.sql import functions as F

from corpusloom.operators.cache import BucketedCache


@pytest.fixture
def cache(spark, tmp_path):
    c = BucketedCache(spark, f"file://{tmp_path}/it's a cache", "bigint", 4)
    yield c
    c.close()


def table(spark, rows, names="key string, value long"):
    return spark.createDataFrame(rows, names)


def values(c):
    return {r["key"]: r["value"] for r in c.rows().collect()}


def test_last_written_counts(spark, cache):
    assert values(cache) == {}
    cache.append(table(spark, [("a", 1), ("b", 2), (None, 3), ("c", None)]))
    cache.append(table(spark, [("b", 5), ("d", 6)]))
    assert values(cache) == {"a": 1, "b": 5, "d": 6}
    asked = table(spark, [("b", 1), ("x", 2), ("x", 3), (None, 4), ("c", 5)], "key string, n long")
    assert sorted(r["key"] for r in cache.missing(asked).collect()) == ["c", "x"]
    got = sorted(((r["key"], r["n"], r["value"]) for r in cache.get(asked).collect()), key=repr)
    assert got == sorted([("b", 1, 5), ("x", 2, None), ("x", 3, None), (None, 4, None), ("c", 5, None)], key=repr)


def test_another_session_opens_the_folder(spark, tmp_path):
    one = BucketedCache(spark, f"file://{tmp_path}/shared", "string", 4)
    one.append(table(spark, [("a", "x"), ("b", "y")], "key string, value string"))
    one.close()
    two = BucketedCache(spark, f"file://{tmp_path}/shared", "string", 4)
    assert values(two) == {"a": "x", "b": "y"}
    two.close()


def test_calls_only_for_what_is_missing(spark, cache, tmp_path):
    def call(texts):
        with open(tmp_path / "calls", "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [len(t) for t in texts]

    asked = table(spark, [("1", "one"), ("3", "three"), ("3", "three")], "key string, text string")
    cache.append(table(spark, [("1", -1)]))
    cache.fill(asked, call)
    cache.fill(asked, call)
    assert (tmp_path / "calls").read_text() == "three\n" and values(cache) == {"1": -1, "3": 5}


def test_the_cache_is_not_shuffled(spark, cache):
    cache.append(table(spark, [(str(i), i) for i in range(50)]))
    asked = table(spark, [(str(i), i) for i in range(0, 100, 3)], "key string, n long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df, exchanges in ((cache.missing(asked), 1), (cache.get(asked), 1), (cache.rows(), 0)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == exchanges, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert cache.missing(asked).count() == len([i for i in range(0, 100, 3) if i >= 50])
