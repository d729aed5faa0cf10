"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are trained online by follow-the-regularised-leader with elastic-net penalties, so that most n-grams get
exactly none, and probabilities are calibrated by one temperature on a part of the labelled rows that training did
not see. Texts are labelled whole; only letters (Unicode category L, with the marks that follow them) and the blanks
between them count. N-grams of 1 to 3 characters are hashed into a fixed number of columns; a text's vector is the share
of each n-gram times its inverse document frequency, so a score is one gather and sum. Document frequencies are counted
over all rows that may be learned from; the fit takes a bounded sample of them, in which every language has its part.
What reaches the driver is that sample's vectors, at most as long as the number of columns, never its texts.

A null text, and one without any letter, is `und` with score 0. Rows are predicted one by one; of languages that are
equally likely the first in alphabetical order is taken. With no labelled row every text is `und`; with one language
only, that language has score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import bounded_batches, crc_mod, stored, text_slices

COLUMNS = 1 << 16
ORDERS = (1, 2, 3)
#: Runs of what is neither a letter nor a mark on one. Nothing is read twice, however many marks a text has.
NOT_LETTERS = regex.compile(r"\A\p{M}++|(?:[^\p{L}\p{M}]++\p{M}*+)++")
UNKNOWN = "und"


def grams(texts: list[str], size: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(columns, first column of each text's run, plus the end) of a batch of texts."""
    cleaned = [f" {c} " if (c := NOT_LETTERS.sub(" ", t.lower()).strip()) else "" for t in texts]
    sizes = np.array([len(c) for c in cleaned], dtype=np.int64)
    points = np.frombuffer("".join(cleaned).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(points)
    ends = np.repeat(np.cumsum(sizes), sizes)
    parts, counts = [], []
    code = np.zeros(n, dtype=np.uint64)
    for k in ORDERS:
        code = (code[: max(n - k + 1, 0)] + points[k - 1 :]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        code ^= code >> np.uint64(29)
        inside = np.arange(len(code)) + k <= ends[: len(code)]
        parts.append((((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int32)[inside])
        counts.append(np.maximum(sizes - k + 1, 0))
    # Orders of one text are put beside each other.
    total = sum(counts)
    bounds = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(int(bounds[-1]), dtype=np.int32)
    at = bounds[:-1].copy()
    for p, c in zip(parts, counts, strict=True):
        place = np.repeat(at - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(len(p))
        out[place] = p
        at = at + c
    return out, bounds


@dataclass
class Classifier:
    """Languages, weights already multiplied by the inverse document frequency, bias and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores by language, number of n-grams) of each text."""
        columns, bounds = grams(texts, len(self.weights))
        counts = np.diff(bounds)
        sums = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(counts)
        if len(full):
            for k in range(len(self.languages)):
                sums[full, k] = np.add.reduceat(self.weights[:, k][columns], bounds[:-1][full])
        return sums * SCALE / np.maximum(counts, 1)[:, None] + self.bias, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        z, counts = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        known = counts > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


SCALE = 20.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def vectors_of(texts: list[str], columns: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(different columns, share of each among the text's n-grams) of each text."""
    found, bounds = grams(texts, columns)
    out = []
    for i in range(len(texts)):
        c, n = np.unique(found[bounds[i] : bounds[i + 1]], return_counts=True)
        out.append((c, n / max(n.sum(), 1)))
    return out


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, passes: int = 2, hold: int = 5) -> Classifier:
    """FTRL-proximal on the rows whose number is not divisible by `hold`; the rest set the temperature."""
    names, size = sorted(set(langs)), len(idf)
    if not names:
        return Classifier([], np.zeros((size, 0)), np.zeros(0), 1.0)
    number = {x: i for i, x in enumerate(names)}
    y = np.array([number[x] for x in langs])
    k = len(names)
    # The last column is the bias; it is not penalised.
    z, n2 = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    penalty = np.full((size + 1, 1), l1)
    penalty[-1] = 0

    def weights(z: np.ndarray, n2: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n2)) / alpha + l2))

    used = [i for i in range(len(vectors)) if i % hold or len(vectors) < 2 * hold]
    order = np.random.default_rng(11)
    for _ in range(passes):
        for i in order.permutation(used):
            c, share = vectors[i]
            x = np.append(share * idf[c] * SCALE, 1.0)
            c = np.append(c, size)
            zc, nc = z[c], n2[c]
            w = weights(zc, nc, penalty[c])
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p[None]
            z[c] = zc + g - (np.sqrt(nc + g * g) - np.sqrt(nc)) / alpha * w
            n2[c] = nc + g * g
    w = weights(z, n2, penalty)
    model = Classifier(names, w[:-1] * idf[:, None], w[-1], 1.0)
    rest = [i for i in range(len(vectors)) if i % hold == 0]
    logits = np.array([(vectors[i][1] * SCALE) @ model.weights[vectors[i][0]] + model.bias for i in rest])
    grid = np.exp(np.linspace(-4, 3, 57))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(rest)), y[rest]], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def labelled_sample(rows: DataFrame, max_rows: int, columns: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Vectors and languages of labelled rows (text, lang): of every language those with the smallest hashes, an equal
    part of max_rows but one at least, so a language with most of the rows does not crowd out others."""
    counts = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    known = counts.count()
    if not known:
        return [], []
    each = max(1, max_rows // known)
    # A hash lets through some times as many rows as are wanted, or all of a small language; then the smallest are taken.
    near = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)) < F.least(F.lit(1.0), (3 * each + 40) / F.col("n")) * float(1 << 40)
    some = rows.join(counts, "lang").where(near).withColumn("h", F.xxhash64("text", "doc_id", F.lit(1)))
    best = Window.partitionBy("lang").orderBy("h", "text")
    some = some.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= each).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in text_slices(texts, 1 << 20):
                got = vectors_of(texts[i:j], columns)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array([c.astype("<u4").tobytes() for c, _ in got], pa.binary()), pa.array([s.astype("<f8").tobytes() for _, s in got], pa.binary())], names=["lang", "h", "c", "s"])

    got = some.mapInArrow(run, "lang string, h long, c binary, s binary").collect()
    got.sort(key=lambda r: (r["h"], r["lang"], bytes(r["c"])))
    return [(np.frombuffer(r["c"], dtype="<u4").astype(np.int64), np.frombuffer(r["s"], dtype="<f8")) for r in got], [r["lang"] for r in got]


def inverse_frequencies(rows: DataFrame, columns: int) -> np.ndarray:
    """log((1 + texts) / (1 + texts with a column)) + 1 of every column, over all rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts_ = np.zeros(columns + 1, dtype=np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in text_slices(texts, 1 << 20):
                found, bounds = grams(texts[i:j], columns)
                of = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(bounds))
                mark = np.zeros((j - i) * columns, dtype=bool) if (j - i) * columns < 1 << 27 else None
                if mark is None:
                    once = np.unique(of * columns + found) % columns
                else:
                    mark[of * columns + found] = True
                    once = np.flatnonzero(mark) % columns
                seen[:columns] += np.bincount(once, minlength=columns)
                texts_ += j - i
        seen[columns] = texts_
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(seen[full], pa.int64())], names=["c", "n"])

    # One row for each column and one for the number of texts.
    counts = rows.select("text").mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(columns + 1, dtype=np.int64)
    for r in counts:
        seen[r["c"]] = r["n"]
    return np.log((1 + seen[columns]) / (1 + seen[:columns])) + 1


def identify(docs: DataFrame, held_out_mod: tuple[int, int] = (3, 1), max_rows: int = 2400, columns: int = COLUMNS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; max_rows labelled rows are fitted, or one of each language if
    there are more languages than that."""
    spark = docs.sparkSession
    mod, rest = held_out_mod
    out_of = F.coalesce(crc_mod(F.col("doc_id"), mod) == rest, F.lit(False))
    bounded_batches(spark)
    rows = docs.where(~out_of & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    shared = spark.sparkContext.broadcast(fit(*labelled_sample(rows, max_rows, columns), inverse_frequencies(rows, columns)))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in text_slices(texts, 1 << 20):
                langs, scores = model.predict([t or "" for t in texts[i:j]])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(langs), pa.array(scores)], schema=arrow)

    return docs.select("doc_id", out_of.alias("held_out"), "text").mapInArrow(run, schema)
