"""The benchmark: every strategy of the matrix over one corpus and one set of questions, and its report.

    python -m corpusloom.benchmark CORPUS QUESTIONS.json [--only NAME] [--no-rerank] [--rerankers overlap] [--report FILE]

QUESTIONS.json has lines of qid, question, gold_docs, context_keys, answer_keys and possibly filter (a map)."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions.text import nfc
from corpusloom.operators import chunking, evaluate, generate, hybrid, sections, store
from corpusloom.session import configure
from corpusloom.sources.files import read_corpus
from corpusloom.tables import stored

RERANKERS = {"overlap": hybrid.overlap_score}
QUESTIONS = "qid string, question string, gold_docs array<string>, context_keys array<array<string>>, answer_keys array<array<string>>, filter map<string,string>"


def chunk_sets(docs: DataFrame, names: set[str]) -> dict[str, DataFrame]:
    """Chunks of docs (doc_id, title, body, metadata) by each of the named strategies."""
    leaf = sections.StructureChunker(max_chars=1200, mode="leaf")
    makers = {n: lambda n=n: chunking.chunk_corpus(docs, n) for n in ("fixed_size", "by_sentences", "recursive")}
    makers |= {c.name: lambda c=c: sections.structure_chunks(docs, c) for c in (leaf, sections.StructureChunker())}
    return {n: stored(makers[n](), f"chunks-{n}") for n in sorted(names)}


def run(docs: DataFrame, questions: DataFrame, only: str | None = None, rerankers: dict | None = None, embedder: store.Embedder = store.MOCK, llm: Callable = generate.demo_llm) -> dict[str, DataFrame]:
    """chunks, hits, verdicts and unfiltered (verdicts of the questions with a filter, asked without it) of all strategies,
    or of one. Questions are few and their filters fewer: those with equal filters are asked together."""
    matrix = evaluate.strategy_matrix(rerankers)
    if only is not None:
        if only not in matrix:
            raise ValueError(f"no strategy {only!r}; there are {', '.join(matrix)}")
        matrix = {only: matrix[only]}
    sets = chunk_sets(docs, {c for c, *_ in matrix.values()})
    stores = {n: store.VectorStore(docs.sparkSession, embedder=embedder).add(c.select("id", "content", "metadata")) for n, c in sets.items()}
    stores = {n: store.VectorStore(s.spark, stored(s.records, f"store-{n}"), embedder) for n, s in stores.items()}
    # One row for each different filter.
    filters = [r[0] for r in questions.select(F.to_json("filter")).distinct().collect()]
    found, missed = [], []
    for name, (chunker, options, reranker) in matrix.items():
        retriever = hybrid.HybridRetriever(stores[chunker], options, llm, reranker)
        for text in filters:
            some = questions.where(F.to_json("filter").eqNullSafe(F.lit(text)))
            wanted = some.select("filter").first()[0]
            for into, use in ((found, wanted), *([(missed, None)] if wanted else [])):
                answers, hits = generate.run_pipeline(retriever, some.select("qid", "question"), llm, 3, use)
                tag = lambda df: df.withColumn("strategy", F.lit(name))  # noqa: B023, E731
                into.append((tag(answers), tag(hits.withColumn("doc_id", F.col("metadata")["doc_id"]))))

    def verdicts(parts: list, label: str) -> tuple[DataFrame, DataFrame] | None:
        if not parts:
            return None
        # Texts are composed before they are written, since expressions over alternatives take no Python.
        composed = (reduce(DataFrame.unionByName, x).withColumn(c, nfc(F.col(c))) for c, x in zip(("answer", "content"), zip(*parts, strict=True), strict=True))
        answers, hits = (stored(x, f"{label}-{k}") for x, k in zip(composed, ("answers", "hits"), strict=True))
        return hits, stored(evaluate.verdicts(hits, answers, questions), f"{label}-verdicts")

    hits, judged = verdicts(found, "benchmark")
    other = verdicts(missed, "benchmark-unfiltered")
    chunks = reduce(DataFrame.unionByName, [c.select("strategy", "content") for c in sets.values()])
    return {"chunks": chunking.statistics(chunks), "hits": hits, "verdicts": judged, "unfiltered": other[1] if other else judged.limit(0)}


def report(result: dict[str, DataFrame]) -> list[str]:
    """The report's lines: chunks, verdicts by question, totals, and the effect of filters."""
    out = ["1. CHUNKS"]
    out += [f"{r['strategy']:16} n={r['chunks']:4} mean={r['mean_length']:6.0f} min={r['min_length']:4} max={r['max_length']:5}" for r in result["chunks"].orderBy("strategy").collect()]
    out += ["", "2. VERDICTS"]
    out += [f"{r['qid']} | {r['strategy']} | {r['score']}/2 | first relevant {r['first_relevant'] or '-'} | gold document {'yes' if r['doc_hit'] else 'no'} | coverage {r['coverage']:.0%} | answer {'yes' if r['answer_ok'] else 'no'}" for r in result["verdicts"].orderBy("qid", "strategy").collect()]
    out += ["", "3. TOTALS", *(r["line"] for r in evaluate.report(result["verdicts"]).collect())]
    out += ["", "4. FILTERS"]
    pairs = evaluate.filter_effect(result["verdicts"].join(result["unfiltered"].select("strategy", "qid"), ["strategy", "qid"], "left_semi"), result["unfiltered"])
    return out + [f"{r['qid']} | {r['strategy']} | with {r['score_filtered']} | without {r['score_unfiltered']}" for r in pairs.orderBy("qid", "strategy").collect()]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="benchmark")
    p.add_argument("corpus")
    p.add_argument("questions")
    p.add_argument("--only")
    p.add_argument("--no-rerank", action="store_true")
    p.add_argument("--rerankers", default="overlap")
    p.add_argument("--report")
    a = p.parse_args(argv)
    spark = configure(SparkSession.builder.getOrCreate())
    chosen = {} if a.no_rerank else {n: RERANKERS[n] for n in a.rerankers.split(",")}
    lines = report(run(read_corpus(spark, a.corpus), spark.read.schema(QUESTIONS).json(a.questions), a.only, chosen, Settings.read().embedder()))
    print("\n".join(lines))
    if a.report and not a.only:
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(a.report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
