"""A walk through the engine: files are loaded, stored and searched, and a question is answered.

    python -m corpusloom.demo FOLDER [QUESTION...]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.operators.generate import run_agent
from corpusloom.operators.store import VectorStore
from corpusloom.session import configure
from corpusloom.sources.files import read_text_documents

QUESTION = "Summarize the key information from the loaded files."


def walk(spark: SparkSession, folder: str, question: str = QUESTION) -> list[str]:
    """What the walk prints."""
    docs = read_text_documents(spark, folder)
    settings = Settings.read()
    embedder = settings.embedder()
    s = VectorStore(spark, embedder=embedder).add(docs.select("id", "content", "metadata"))
    n = s.size()
    if not n:
        return [f"No .md or .txt files in {folder}."]
    out = [f"Loaded {n} documents; embeddings: {embedder.name}", f"Question: {question}"]
    for i, r in enumerate(s.search(question, 3).collect(), 1):
        out += [f"{i}. score={r['score']:.3f} source={r['metadata'].get('source')}", f"   {' '.join(r['content'][:120].split())}..."]
    asked = spark.createDataFrame([(1, question)], "qid int, question string")
    return [*out, "Answer: " + run_agent(s, asked).select(F.col("answer")).first()[0]]


def main(argv: list[str] | None = None) -> int:
    folder, *words = sys.argv[1:] if argv is None else argv
    lines = walk(configure(SparkSession.builder.getOrCreate()), folder, " ".join(words).strip() or QUESTION)
    print("\n".join(lines))
    return 0 if len(lines) > 1 else 1


if __name__ == "__main__":
    sys.exit(main())
