"""Chunkers: one row for each document becomes one for each chunk."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE, strip

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
EMPTY = F.array


def fixed(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of `size` characters that start size - overlap apart, until one reaches the end."""
    if size == overlap:
        raise ValueError("overlap must differ from the size")
    n, step = F.length(text), size - overlap
    if step < 0:
        return F.when((n > 0) & (n <= size), F.array(text)).otherwise(F.array().cast("array<string>"))
    count = F.ceil((n - overlap) / F.lit(step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(cut)


def sentences(text: Column, most: int = 3) -> Column:
    """Groups of `most` sentences; a sentence ends with . ! or ? before white space."""
    most = max(1, most)
    parts = F.filter(F.split(strip(text), f"(?<=[.!?]){SPACE}+"), lambda s: s != "")

    def grouped(p: Column) -> Column:
        n = F.ceil(F.size(p) / F.lit(most)).cast("int")
        return F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(p, i * most + 1, most), " ")))

    return F.element_at(F.transform(F.array(parts), grouped), 1)


def split_recursively(text: str, separators: tuple[str, ...] = SEPARATORS, size: int = 500) -> list[str]:
    """Pieces of at most `size` characters: at the first separator that occurs, neighbours merged while they fit, and
    larger pieces cut by the separators that follow. Pieces are stripped; empty ones go."""
    out: list[str] = []
    if not text.strip():
        return out
    # Depth-first work list of (piece, number of separators already used).
    work = [(text, 0)]
    while work:
        piece, k = work.pop()
        if len(piece) <= size:
            out.append(piece)
            continue
        while k < len(separators) and separators[k] and separators[k] not in piece:
            k += 1
        if k >= len(separators) or not separators[k]:
            out += [piece[i : i + size] for i in range(0, len(piece), size)]
            continue
        sep, todo, held = separators[k], [], ""
        for part in piece.split(sep):
            joined = held + sep + part if held else part
            if len(joined) <= size:
                held = joined
                continue
            if held:
                todo.append((held, k + 1))
            held = ""
            if len(part) <= size:
                held = part
            else:
                todo.append((part, k + 1))
        if held:
            todo.append((held, k + 1))
        work += reversed(todo)
    return [p for x in out if (p := x.strip())]


def recursive(text: Column, size: int = 500, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """split_recursively as a column: the fold is sequential within a document, so it runs in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_recursively(t, separators, size), na_action="ignore")

    return run(text)


STRATEGIES = {
    "fixed_size": lambda t: fixed(t, 500, 50),
    "by_sentences": lambda t: sentences(t, 3),
    "recursive": lambda t: recursive(t, 500),
}


def chunk_corpus(docs: DataFrame, strategy: str = "fixed_size", text: str = "body") -> DataFrame:
    """One row for each chunk of docs (doc_id, body, metadata map): id, content, chunk_index, strategy and metadata,
    to which doc_id, chunk_index and strategy are added (they win over entries of the same name)."""
    cut = docs.select("doc_id", "metadata", F.posexplode(STRATEGIES[strategy](F.col(text))).alias("chunk_index", "content"))
    own = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("strategy"), F.lit(strategy))
    return cut.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string")).alias("id"),
        F.col("doc_id"),
        "chunk_index",
        F.lit(strategy).alias("strategy"),
        "content",
        F.map_concat("metadata", own).alias("metadata"),
    )


def compare(docs: DataFrame, size: int = 200, text: str = "text") -> DataFrame:
    """(doc_id, strategy, count, avg_length, chunks) of the three chunkers at one size; no chunk gives length 0."""
    each = F.array(
        F.struct(F.lit("fixed_size").alias("strategy"), fixed(F.col(text), size, size // 10).alias("chunks")),
        F.struct(F.lit("by_sentences").alias("strategy"), sentences(F.col(text), 3).alias("chunks")),
        F.struct(F.lit("recursive").alias("strategy"), recursive(F.col(text), size).alias("chunks")),
    )
    flat = docs.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.*")
    total = F.aggregate("chunks", F.lit(0), lambda a, c: a + F.length(c))
    n = F.size("chunks")
    return flat.select("doc_id", "strategy", n.alias("count"), F.when(n == 0, F.lit(0.0)).otherwise(total / F.greatest(n, F.lit(1))).alias("avg_length"), "chunks")


def statistics(chunks: DataFrame) -> DataFrame:
    """Number, mean, shortest and longest length of chunks by strategy."""
    n = F.length("content")
    return chunks.groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks"), F.avg(n).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))
