"""The vector store: an immutable view of a DataFrame of (id, content, metadata, doc_id, embedding, index)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from corpusloom.functions.vector import cosine, mock_embed_text, mock_embedding
from corpusloom.operators.best import CELLS, Best


def matches(metadata: Column, wanted: dict | None) -> Column:
    """Whether metadata passes a filter: equal values; None for a missing key; a list for any of its members, an empty
    list for nothing; no filter for everything."""
    tests = []
    for key, value in (wanted or {}).items():
        have = F.try_element_at(metadata, F.lit(key))
        if isinstance(value, list | tuple | set | frozenset):
            one = [have.eqNullSafe(F.lit(None if v is None else str(v))) for v in value]
            tests.append(reduce(lambda a, b: a | b, one, F.lit(False)))
        else:
            tests.append(have.eqNullSafe(F.lit(None if value is None else str(value))))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass(frozen=True)
class Embedder:
    """How texts become vectors: as a column, and on the driver for a query."""

    column: Callable[[Column], Column]
    one: Callable[[str], list[float]]
    name: str = "mock"


MOCK = Embedder(mock_embedding, mock_embed_text)


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], name: str, batch: int = 96) -> Embedder:
    """An embedder around an external model: `load` is called once in each worker and gives a function of a list of
    texts; texts go through it in batches, each different text of a batch once."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterable[pd.Series]) -> Iterable[pd.Series]:
        model = load()
        for s in parts:
            texts = list(dict.fromkeys(s.dropna()))
            got = {t: v for i in range(0, len(texts), batch) for t, v in zip(texts[i : i + batch], model(texts[i : i + batch]), strict=True)}
            yield s.map(got, na_action="ignore")

    return Embedder(lambda c: run(c), lambda t: list(load()([t])[0]), name)


def choose_embedder(provider: str, makers: dict[str, Callable[[], Embedder]]) -> Embedder:
    """The embedder of a provider; the mock one if it is unknown or cannot be made."""
    try:
        return makers[provider.strip().lower()]()
    except Exception:  # noqa: BLE001  any failure of an external provider falls back
        return MOCK


class VectorStore:
    """Every change gives a new store; `persist` writes the rows to a table so that vectors are made once."""

    def __init__(self, spark: SparkSession, records: DataFrame | None = None, embedder: Embedder = MOCK):
        self.spark, self.embedder = spark, embedder
        self.records = records if records is not None else spark.createDataFrame([], "id string, content string, metadata map<string,string>, doc_id string, embedding array<double>, index long")

    def add(self, docs: DataFrame) -> VectorStore:
        """Append docs (id, content, metadata): one record for each; ids may repeat. Records are numbered after the
        ones already there, in the order of `ord` if docs have such a column."""
        made = docs.select(
            "id",
            "content",
            F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
            F.col("ord") if "ord" in docs.columns else F.monotonically_increasing_id().alias("ord"),
        )
        made = made.withColumn("metadata", F.map_concat(F.create_map(F.lit("doc_id"), F.col("id")), "metadata")).withColumn("doc_id", F.col("metadata")["doc_id"])
        base = self.records.agg(F.coalesce(F.max("index"), F.lit(0)).alias("base"))
        made = made.withColumn("embedding", self.embedder.column(F.col("content"))).crossJoin(F.broadcast(base)).withColumn("index", F.col("base") + F.col("ord") + 1).drop("ord", "base")
        return VectorStore(self.spark, self.records.unionByName(made), self.embedder)

    def persist(self, path: str) -> VectorStore:
        target = f"{path.rstrip('/')}/store-{uuid.uuid4().hex}"
        self.records.write.parquet(target)
        return VectorStore(self.spark, self.spark.read.schema(self.records.schema).parquet(target), self.embedder)

    def size(self) -> int:
        return self.records.count()

    def search(self, query: str, top_k: int = 5, metadata_filter: dict | None = None) -> DataFrame:
        """The top_k records by cosine to the query, earlier ones first among equals; the filter applies before."""
        rows = self.records.where(matches(F.col("metadata"), metadata_filter))
        vector = F.array(*[F.lit(float(x)) for x in self.embedder.one(query)])
        scored = rows.select("id", "content", "metadata", cosine(F.col("embedding"), vector).alias("score"), "index")
        return scored.orderBy(F.desc("score"), "index").limit(max(top_k, 0)).drop("index")

    def delete(self, doc_id: str) -> tuple[VectorStore, bool]:
        """The store without a document's records, and whether there were any."""
        gone = F.col("metadata")["doc_id"].eqNullSafe(F.lit(doc_id))
        found = not self.records.where(gone).limit(1).isEmpty()
        return VectorStore(self.spark, self.records.where(~gone), self.embedder), found


def nearest(queries: DataFrame, rows: DataFrame, top_k: int, query_bytes: int = 16 << 20, digits: int = 12) -> DataFrame:
    """The top_k rows (id, embedding, index) for each of a set of queries (qid, qvec): (qid, id, score, rank).

    Scores are cosines, rounded to `digits` places; earlier rows go first among equals. Every query is computed once and
    streams to the driver, which holds them in blocks of query_bytes that go to the tasks. Rows meet a block in matrix
    products of CELLS scores at most, and each task sends its best top_k for every query into the shuffle."""
    kinds = {"qid": queries.schema["qid"].dataType, "id": rows.schema["id"].dataType}
    out_type = StructType([StructField("qid", kinds["qid"]), StructField("id", kinds["id"]), StructField("index", LongType()), StructField("score", DoubleType())])
    schema = to_arrow_schema(out_type)

    def best_of(ids: list, vectors: np.ndarray):
        unit = _unit(vectors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), top_k)
            for b in batches:
                have = b.filter(pc.is_valid(b.column(1)))
                for start in range(0, have.num_rows, 1024):
                    part = have.slice(start, 1024)
                    m = _unit(_matrix(part.column(1)))
                    width = min(m.shape[1], unit.shape[1])
                    # A whole number of lines, so that equal vectors are multiplied in the same way wherever they stand.
                    m = np.pad(m[:, :width], ((0, -len(m) % 64), (0, 0))).T
                    index, name = part.column(2).to_numpy(), np.empty(part.num_rows, dtype=object)
                    name[:] = part.column(0).to_pylist()
                    step = CELLS // 1024
                    for at in range(0, len(ids), step):
                        best.add(at, np.round((unit[at : at + step, :width] @ m)[:, : len(name)], digits) + 0.0, index, name)
            yield from best.rows(ids, schema)

        return run

    local = queries.select("qid", "qvec").where("qvec is not null")
    found = None
    for ids, vectors in _blocks(local, query_bytes):
        part = rows.select("id", "embedding", F.col("index").cast("long").alias("index")).mapInArrow(best_of(ids, vectors), out_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], out_type)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "index")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("qid", "id", "score", "rank")


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of a set of queries in blocks of about `most` bytes; every query is computed once."""
    held, size = [], 0
    for r in queries.toLocalIterator():
        held.append(r)
        size += 8 * len(r["qvec"]) + 64
        if size >= most:
            yield [x["qid"] for x in held], _padded([x["qvec"] for x in held])
            held, size = [], 0
    if held:
        yield [x["qid"] for x in held], _padded([x["qvec"] for x in held])


def _padded(vectors: list) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros, which products do not feel."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all() and not column.flatten().null_count:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), sizes[0])
    return _padded([[x or 0.0 for x in v] for v in column.to_pylist()])


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows over their norms; a row of zeros stays, so its cosines are 0."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)
