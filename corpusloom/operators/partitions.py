"""Vectors stored in partitions around centroids, and exact search that reads only partitions which can matter.

Vectors are scaled to length 1, so the cosine of two is 1 - d * d / 2 of their distance d, and distances obey the triangle
inequality: a vector of a partition with centroid c and radius r is no nearer to a query q than |q - c| - r. A query first
meets its nearest partitions, which gives a cosine that k rows reach at least; of the others only those are read, each from
a folder of its own, whose bound lies at or above it. Centroids come from a bounded sample and decide about speed only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from corpusloom.operators.store import _blocks, _matrix, _unit
from corpusloom.tables import stored

#: Rows of length 0 have a cosine of 0 with everything and a partition of their own.
ZERO = -1


@dataclass
class VectorPartitions:
    """rows (id, index, unit, part) in folders by part; centroids and radii by part; whether there are rows of length 0."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    zeros: bool

    def ceilings(self, unit: np.ndarray) -> np.ndarray:
        """The largest cosine that each query (a row of length 1 or 0) can have with a row of each partition; the last
        column is for rows of length 0."""
        near = np.maximum(np.sqrt(np.maximum(_squares(unit, self.centroids), 0)) - self.radii, 0)
        most = np.where((unit * unit).sum(axis=1, keepdims=True) == 0, 0.0, 1 - near * near / 2)
        most[:, np.isinf(self.radii)] = -np.inf
        return np.concatenate([most, np.full((len(unit), 1), 0.0 if self.zeros else -np.inf)], axis=1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T


def _centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centroids of unit vectors by Lloyd's rounds from rows that are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(rounds):
        at = _squares(sample, centres).argmin(axis=1)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build(rows: DataFrame, parts: int | None = None, sample: int = 20_000) -> VectorPartitions:
    """Store rows (id, embedding, index) in about `parts` partitions (by default the square root of their number, 4096 at
    most). Centroids are fitted on the `sample` rows with the smallest hashes of index; every row is assigned. Rows without a vector are
    left out, as no search returns them."""
    rows = rows.where("embedding is not null").select("id", F.col("index").cast("long").alias("index"), "embedding")
    n = rows.count()
    k = parts or max(1, min(4096, math.isqrt(n)))
    few = rows.orderBy(F.xxhash64("index")).limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    few = _unit(_matrix(few)) if len(few) else np.zeros((0, 1))
    few = few[(few * few).sum(axis=1) > 0]
    centroids = _centres(few, k) if len(few) else np.zeros((1, few.shape[1]))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # parts x dimensions
    kind = StructType([rows.schema["id"], StructField("index", LongType())]).add("unit", ArrayType(DoubleType())).add("part", IntegerType()).add("away", DoubleType())
    schema = to_arrow_schema(kind)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(_matrix(b.column(2)))
            far = np.sqrt(np.maximum(_squares(*_even(unit, shared.value)), 0))
            part = np.where((unit * unit).sum(axis=1) > 0, far.argmin(axis=1), ZERO)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), unit.shape[1]).cast(schema.field("unit").type)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(schema.field("id").type), b.column(1), lists, pa.array(part, pa.int32()), pa.array(far.min(axis=1))], schema=schema)

    made = rows.select("id", "index", "embedding").mapInArrow(assign, kind)
    # A partition may be large; salt lets several tasks write it, a file each.
    made = made.repartition("part", F.pmod(F.xxhash64("index"), F.lit(max(1, n // k // 100_000))))
    kept = stored(made, "vector-partitions", partitionBy=["part"])
    reach = {r["part"]: r["r"] for r in kept.groupBy("part").agg(F.max("away").alias("r")).collect()}  # a row for each part
    # Empty partitions are never read: nothing is within an infinite negative radius.
    radii = np.array([reach.get(p, -np.inf) for p in range(len(centroids))])
    return VectorPartitions(kept.select("id", "index", "unit", "part"), centroids, radii, ZERO in reach)


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns; what is missing is 0."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _meet(vp: VectorPartitions, ids: list, unit: np.ndarray, meets: np.ndarray, top_k: int, digits: int, kind: StructType) -> DataFrame:
    """The best rows for each query of the partitions that it meets (meets: queries x parts and zeros)."""
    schema = to_arrow_schema(kind)
    of = {p: np.flatnonzero(meets[:, p]) for p in np.flatnonzero(meets.any(axis=0)).tolist()}
    last = meets.shape[1] - 1
    read = [ZERO if p == last else p for p in of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column(3).to_numpy()
            for p in np.unique(part).tolist():
                here = b.filter(pa.array(part == p))
                asks = of[last if p == ZERO else p]
                q, x = _even(unit[asks], _matrix(here.column(2)))
                score = np.round(q @ x.T, digits) + 0.0
                index = np.broadcast_to(here.column(1).to_numpy(), score.shape)
                keep = np.lexsort((index, -score), axis=1)[:, :top_k]
                query, at = np.repeat(asks, keep.shape[1]), keep.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in query.tolist()], schema.field(0).type), here.column(0).take(pa.array(at)).cast(schema.field(1).type), here.column(1).take(pa.array(at)), pa.array(np.take_along_axis(score, keep, axis=1).ravel())], schema=schema)

    found = vp.rows.where(F.col("part").isin(read)).select("id", "index", "unit", "part").mapInArrow(run, kind)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "index")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def nearest(vp: VectorPartitions, queries: DataFrame, top_k: int, first: int = 2, digits: int = 12, query_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """((qid, id, score, rank), (qid, parts_read, parts)): the top_k rows for each of queries (qid, qvec) by cosine, ties
    by index, and how many of all partitions were read for it.

    Queries are held in blocks of query_bytes. Each meets its `first` nearest partitions, then those that can still hold a
    row of its top k; tasks send top_k rows for each query and batch into the shuffle."""
    spark = vp.rows.sparkSession
    kind = StructType([StructField("qid", queries.schema["qid"].dataType), StructField("id", vp.rows.schema["id"].dataType), StructField("index", LongType()), StructField("score", DoubleType())])
    visits = StructType([kind["qid"], StructField("parts_read", LongType()), StructField("parts", LongType())])
    best, read = [], []
    for ids, vectors in _blocks(queries.select("qid", "qvec").where("qvec is not null"), query_bytes):
        unit, centroids = _even(_unit(vectors), vp.centroids)
        vp = VectorPartitions(vp.rows, centroids, vp.radii, vp.zeros)
        most = vp.ceilings(unit)
        lead = np.zeros(most.shape, dtype=bool)
        np.put_along_axis(lead, np.argsort(-most, axis=1)[:, :first], True, axis=1)
        lead &= most > -np.inf
        one = stored(_meet(vp, list(range(len(ids))), unit, lead, top_k, digits, StructType([StructField("qid", LongType()), *kind.fields[1:]])), "vector-first")
        reach = np.full(len(ids), -np.inf)
        for r in one.where(F.col("rank") == top_k).select("qid", "score").collect():  # one row for each query of the block
            reach[r["qid"]] = r["score"]
        # Products are rounded, so what is only just below is read too.
        again = (most >= (reach - 10.0**-digits - 1e-9)[:, None]) & ~lead & (most > -np.inf)
        two = _meet(vp, list(range(len(ids))), unit, again, top_k, digits, StructType([StructField("qid", LongType()), *kind.fields[1:]]))
        named = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], StructType([StructField("n", LongType()), kind["qid"]]))
        both = one.unionByName(two).withColumnRenamed("qid", "n").drop("rank")
        best.append(both.join(F.broadcast(named), "n").select("qid", "id", "index", "score"))
        total = int((vp.radii > -np.inf).sum()) + int(vp.zeros)
        read += [(x, int(n), total) for x, n in zip(ids, (lead | again).sum(axis=1), strict=True)]
    found = spark.createDataFrame([], kind)
    for x in best:
        found = found.unionByName(x)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "index")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("qid", "id", "score", "rank")
    return out, spark.createDataFrame(read, visits)
