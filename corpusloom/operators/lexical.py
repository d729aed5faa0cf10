"""Lexical retrieval: postings, corpus statistics and BM25 scores."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from corpusloom.functions.text import tokens
from corpusloom.operators.best import CELLS, Best
from corpusloom.tables import stored


class LexicalIndex:
    """tokens (id, t), postings (id, term, tf), lengths (id, len), idf (term, df, idf), and one row of totals (n, avg_len)
    of docs (id, content)."""

    def __init__(self, docs: DataFrame, compose: bool = False):
        self.docs, self.compose = docs, compose
        self.tokens = self._tokens(docs)
        self.lengths = self.tokens.select("id", F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("len"))
        self.totals = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))

    def _tokens(self, docs: DataFrame) -> DataFrame:
        return docs.select("id", tokens(F.col("content"), self.compose).alias("t"))

    @functools.cached_property
    def postings(self) -> DataFrame:
        """Terms are counted row by row, so no posting is shuffled; only what rows of one id have is added up."""

        def counted(docs: DataFrame) -> DataFrame:
            each = self._tokens(docs).select("id", F.explode(term_counts(F.col("t"))).alias("p"))
            return each.select("id", "p.term", F.col("p.tf").cast("long").alias("tf"))

        again = stored(self.docs.groupBy(F.col("id").alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("again"), "lexical-again")
        if again.isEmpty():
            return counted(self.docs)
        of = lambda how: self.docs.join(again, F.col("id").eqNullSafe(F.col("again")), how)
        return counted(of("left_anti")).unionByName(counted(of("left_semi")).groupBy("id", "term").agg(F.sum("tf").alias("tf")))

    @functools.cached_property
    def idf(self) -> DataFrame:
        df = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        # One row of totals.
        return df.crossJoin(F.broadcast(self.totals)).select("term", "df", weight(F.col("n"), F.col("df")).alias("idf"))


def term_counts(t: Column) -> Column:
    """Of an array of terms, an array of (term, tf), by run lengths of the sorted array."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.element_at(F.transform(F.array(starts), lambda st: F.transform(st, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(st, k + 1), F.size(s)) - i).alias("tf")))), 1)

    return F.when(F.size(t) > 0, F.element_at(F.transform(F.array(F.array_sort(t)), runs), 1))


def weight(n: Column, df: Column) -> Column:
    """Inverse document frequency."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def index(docs: DataFrame, compose: bool = False) -> LexicalIndex:
    """The index of docs (id, content). All statistics cover all docs, whatever is searched later."""
    return LexicalIndex(docs, compose)


def bm25(ix: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75, compose: bool = False) -> DataFrame:
    """(qid, id, score) of all documents that share a term with queries (qid, question); others score 0. Repeated query
    terms count once."""
    terms = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("question"), compose))).alias("term")).join(ix.idf, "term")
    hits = ix.postings.join(terms, "term").join(ix.lengths, "id").crossJoin(F.broadcast(ix.totals.select("avg_len")))
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hits.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def bm25_all(ix: LexicalIndex, queries: DataFrame, candidates: DataFrame, **options) -> DataFrame:
    """bm25 for stated candidates (qid, id), with zeros."""
    return candidates.join(bm25(ix, queries, **options), ["qid", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def bm25_ranking(ix: LexicalIndex, queries: DataFrame, rows: DataFrame, candidate_k: int = 20, digits: int = 12, k1: float = 1.5, b: float = 0.75, compose: bool = False, query_bytes: int = 16 << 20) -> DataFrame:
    """(qid, id, score, rank) of the candidate_k best with a positive score; rows (id, index, content) are those that pass
    the filter. Scores that are equal to `digits` places are equals, and index decides between them.

    No postings move. Queries (qid, question) stream to the driver in blocks of query_bytes; a block's terms get their
    frequencies from one pass over the index, and every task scores its own rows against the block and sends its best
    for each query into the shuffle. What is shuffled grows with tasks and queries, not with their matches."""
    kinds = {"qid": queries.schema["qid"].dataType, "id": rows.schema["id"].dataType}
    out_type = StructType([StructField("qid", kinds["qid"]), StructField("id", kinds["id"]), StructField("index", LongType()), StructField("score", DoubleType())])
    found = None
    tokenised = rows.select("id", F.col("index").cast("long").alias("index"), tokens(F.col("content"), compose).alias("t"))
    for ids, terms in _blocks(queries.select("qid", F.array_distinct(tokens(F.col("question"), compose)).alias("t")), query_bytes):
        vocabulary = sorted({x for t in terms for x in t})
        # A row for each term that occurs, and two for the number of documents and of all their tokens.
        counts = {r["term"]: r["n"] for r in ix.tokens.select("t").mapInArrow(_counter(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, total = counts.pop(-1, 0), counts.pop(-2, 0)
        df = {vocabulary[k]: c for k, c in counts.items()}
        part = tokenised.mapInArrow(_scorer(ids, terms, df, n, total / max(n, 1), candidate_k, digits, k1, b, to_arrow_schema(out_type)), out_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], out_type)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", digits)), "index")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= candidate_k).select("qid", "id", "score", "rank")


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[list, list[list[str]]]]:
    """(ids, terms) of a set of queries in blocks of about `most` bytes of terms."""
    held, size = [], 0
    for r in queries.toLocalIterator():
        held.append((r["qid"], r["t"] or []))
        size += 64 + sum(64 + len(x) for x in r["t"] or [])
        if size >= most:
            yield tuple(map(list, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(list, zip(*held, strict=True)))


def _found(column: pa.Array, known: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each row, rows, terms, occurrences) of those tokens of a column of lists that are among known."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    which = pc.index_in(pc.list_flatten(column), value_set=pa.array(known, pa.string()))
    hit = which.is_valid().to_numpy(zero_copy_only=False)
    pair, tf = np.unique(of[hit] * max(len(known), 1) + which.drop_null().to_numpy(), return_counts=True)
    return sizes, *np.divmod(pair, max(len(known), 1)), tf


def _counter(vocabulary: list[str]):
    """A function of batches of (tokens) that gives (term number, documents with it), and the number of documents (-1)
    and of tokens (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(vocabulary), dtype=np.int64), 0, 0
        for batch in batches:
            sizes, _, term, _ = _found(batch.column(0), vocabulary)
            df += np.bincount(term, minlength=len(vocabulary))
            n, total = n + len(sizes), total + int(sizes.sum())
        full = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *full.tolist()], pa.int32()), pa.array([n, total, *df[full].tolist()], pa.int64())], names=["term", "n"])

    return run


def _scorer(ids: list, terms: list[list[str]], df: dict[str, int], n: int, avg_len: float, k: int, digits: int, k1: float, b: float, schema: pa.Schema):
    """A function of batches of (id, index, tokens) that gives the best k for each query."""
    known = sorted(df)
    number = {x: i for i, x in enumerate(known)}
    idf = np.array([math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) for x in known])
    # The queries of each term, one after the other.
    asked = np.array([(number[x], q) for q, t in enumerate(terms) for x in t if x in number], dtype=np.int64).reshape(-1, 2)
    asked = asked[np.lexsort((asked[:, 1], asked[:, 0]))]
    first = np.searchsorted(asked[:, 0], np.arange(len(known) + 1))
    many, who = np.diff(first), asked[:, 1]

    def scored(tokens_: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of all queries) for the rows of a column of token lists, some rows at a time. The parts of a
        score are added in the order of terms, so documents with the same counts have the same score to the last bit."""
        sizes, row, term, tf = _found(tokens_, known)
        part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / avg_len))
        step = max(1, CELLS // len(ids))
        for start in range(0, len(sizes), step):
            rows = min(step, len(sizes) - start)
            total = np.zeros(len(ids) * rows)
            i, end = np.searchsorted(row, (start, start + rows))
            here = many[term[i:end]]
            pairs = np.cumsum(here)
            # Pairs of a term and a query that asks for it, about CELLS at a time.
            cuts = np.searchsorted(pairs, np.arange(CELLS, pairs[-1], CELLS)) if len(pairs) else []
            for x, y in zip([0, *cuts], [*cuts, end - i], strict=True):
                n_asked, hit = here[x:y], slice(i + x, i + y)
                at = np.repeat(first[term[hit]] - np.cumsum(n_asked) + n_asked, n_asked) + np.arange(n_asked.sum())
                np.add.at(total, who[at] * rows + np.repeat(row[hit] - start, n_asked), np.repeat(part[hit], n_asked))
            yield start, total.reshape(len(ids), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches if known else ():
            for start, score in scored(batch.column(2)):
                part = batch.slice(start, score.shape[1])
                name = np.empty(part.num_rows, dtype=object)
                name[:] = part.column(0).to_pylist()
                # No score, no hit.
                best.add(0, np.where(score > 0, score, -np.inf), part.column(1).to_numpy(), name, digits)
        yield from best.rows(ids, schema)

    return run
