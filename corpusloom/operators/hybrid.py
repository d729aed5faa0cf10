"""Hybrid retrieval: branches are ranked on their own, fused by reciprocal ranks, and optionally reranked."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators.generate import filled
from corpusloom.operators.lexical import LexicalIndex, bm25_ranking, index
from corpusloom.operators.store import VectorStore, matches, nearest
from corpusloom.tables import stored

#: Branch order decides between equal fused scores.
BRANCHES = ("dense", "hyde_en", "hyde_vi", "bm25")


@dataclass(frozen=True)
class HybridOptions:
    use_dense: bool = True
    use_bm25: bool = False
    use_hyde: bool = False
    candidate_k: int = 20
    rerank_top_n: int = 20
    branch_pool: int = 5
    rrf_k: int = 60
    hyde_prompts: dict[str, str] | None = None


#: Passage that a language model writes for a question, by language. Invented numbers are to be left out as [X].
HYDE_PROMPTS = {
    "vi": "Viết một đoạn ngắn theo văn phong quy định của nhà trường để trả lời câu hỏi; số liệu không chắc thì ghi [X].\n\nCâu hỏi: {question}\n\nĐoạn quy định:",
    "en": "Write one short passage in the style of an official policy that answers the question; write [X] for numbers you are unsure of.\n\nQuestion: {question}\n\nPassage:",
}


def hyde_languages(records: DataFrame, prompts: dict[str, str] = HYDE_PROMPTS) -> list[str]:
    """Languages to write passages in: those of the records (none means vi) that have a prompt, in order; else vi."""
    lang = F.coalesce(F.try_element_at("metadata", F.lit("language")), F.lit("vi"))
    found = [r[0] for r in records.select(lang.alias("l")).where(F.col("l").isin(sorted(prompts))).distinct().collect()]
    return sorted(found) or ["vi"]


def fuse(branches: DataFrame, rrf_k: int = 60) -> DataFrame:
    """(qid, id, fused, fused_rank, best, ranks) from branches (qid, branch, branch_ord, id, rank): sum of
    1 / (rrf_k + rank); between equals the one met first, by branch and then rank. best is the smallest rank."""
    w = Window.partitionBy("qid").orderBy(F.desc("fused"), "first")
    summed = branches.groupBy("qid", "id").agg(
        F.sum(1.0 / (rrf_k + F.col("rank"))).alias("fused"),
        F.min(F.struct("branch_ord", "rank")).alias("first"),
        F.min("rank").alias("best"),
        F.map_from_entries(F.collect_list(F.struct("branch", F.col("rank").cast("double")))).alias("ranks"),
    )
    # Sums over branches come in any order; rounding keeps equal totals equal.
    summed = summed.withColumn("fused", F.round("fused", 12))
    return summed.withColumn("fused_rank", F.row_number().over(w))


def rerank_pool(fused: DataFrame, top_n: int = 20, branch_pool: int = 5) -> DataFrame:
    """The rows to rerank, with pool_ord: the top_n fused, then what else is among a branch's first branch_pool."""
    top = F.col("fused_rank") <= top_n
    w = Window.partitionBy("qid").orderBy(F.desc("_top"), F.when(top, F.col("fused_rank")), "first")
    return fused.where(top | (F.col("best") <= branch_pool)).withColumn("_top", top).withColumn("pool_ord", F.row_number().over(w)).drop("_top")


def overlap_score(question: Column, content: Column) -> Column:
    """The offline reranker: share of the question's terms that the passage has."""
    q = F.array_distinct(tokens(question))
    return F.size(F.array_intersect(q, tokens(content))) / F.greatest(F.size(q), F.lit(1))


def model_reranker(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 8) -> Callable[[Column, Column], Column]:
    """A reranker around an external model, loaded once in each worker and fed in batches of (question, passage)."""

    @F.pandas_udf("double")
    def run(parts: Iterable[tuple[pd.Series, pd.Series]]) -> Iterable[pd.Series]:
        model = load()
        for q, c in parts:
            pairs = list(zip(q, c, strict=True))
            yield pd.Series([float(s) for i in range(0, len(pairs), batch) for s in model(pairs[i : i + batch])], dtype="float64")

    return lambda q, c: run(q, c)


class HybridRetriever:
    """Retrieval over the records of a store, for a whole set of questions at once."""

    # Scores of branches are rounded to `digits` places before they are ranked, so that equals are equal everywhere.
    def __init__(self, store: VectorStore, options: HybridOptions = HybridOptions(), llm: Callable[[Column], Column] | None = None, reranker: Callable[[Column, Column], Column] | None = None, lexical: LexicalIndex | None = None, digits: int = 12):
        if options.use_hyde and llm is None:
            raise ValueError("hypothetical passages need a language model")
        self.store, self.o, self.llm, self.reranker, self.digits = store, options, llm, reranker, digits
        self.hyde = options.hyde_prompts or HYDE_PROMPTS
        self.languages = hyde_languages(store.records, self.hyde) if options.use_hyde else []
        self.lexical = lexical or (index(store.records.select("id", "content")) if options.use_bm25 else None)

    def branches(self, questions: DataFrame, metadata_filter: dict | None = None) -> DataFrame:
        """(qid, branch, branch_ord, id, score, rank) of every branch in use, cut to candidate_k."""
        rows = self.store.records.where(matches(F.col("metadata"), metadata_filter))
        embed, k, out = self.store.embedder.column, self.o.candidate_k, []

        def named(df: DataFrame, name: str) -> DataFrame:
            return df.select("qid", F.lit(name).alias("branch"), F.lit(BRANCHES.index(name)).alias("branch_ord"), "id", "score", "rank")

        if self.o.use_dense:
            out.append(named(nearest(questions.select("qid", embed(F.col("question")).alias("qvec")), rows, k, digits=self.digits), "dense"))
        for lang in self.languages:
            passage = self.llm(filled(self.hyde[lang], question=F.col("question")))
            out.append(named(nearest(questions.select("qid", embed(passage).alias("qvec")), rows, k, digits=self.digits), f"hyde_{lang}"))
        if self.o.use_bm25:
            out.append(named(bm25_ranking(self.lexical, questions, rows, k, self.digits), "bm25"))
        return reduce(DataFrame.unionByName, out)

    def contents(self, pool: DataFrame) -> DataFrame:
        """pool with content and metadata of its ids. Ids may repeat in the store; the last record of an id stands for it.
        The store meets the pool's ids before anything of it is shuffled."""
        some = self.store.records.select("id", "content", "metadata", "index").join(pool.select("id").distinct(), "id", "left_semi")
        last = some.groupBy("id").agg(F.max_by(F.struct("content", "metadata"), "index").alias("r")).select("id", "r.*")
        return pool.join(last, "id")

    def retrieve(self, questions: DataFrame, top_k: int = 3, metadata_filter: dict | None = None) -> DataFrame:
        """(qid, rank, id, content, metadata, score, signals) for questions (qid, question).

        The score is the reranker's, else the cosine if there is only the dense branch, null for another single
        branch, else the fused one. signals holds each branch's rank, rrf and rerank, rounded to four places."""
        branches = stored(self.branches(questions, metadata_filter), "hybrid-branches")
        n_branches = int(self.o.use_dense) + len(self.languages) + int(self.o.use_bm25)
        fused = fuse(branches, self.o.rrf_k)
        rrf = F.create_map(F.lit("rrf"), F.round("fused", 4))
        if self.reranker:
            pool = rerank_pool(fused, self.o.rerank_top_n, self.o.branch_pool)
            pool = self.contents(pool.join(questions, "qid"))
            pool = pool.withColumn("score", self.reranker(F.col("question"), F.col("content")))
            order, signals = (F.desc("score"), F.col("pool_ord")), F.map_concat("ranks", rrf, F.create_map(F.lit("rerank"), F.round("score", 4)))
        else:
            pool = fused.where(F.col("fused_rank") <= top_k)
            if n_branches == 1:
                own = branches.select("qid", "id", F.when(F.col("branch") == "dense", F.col("score")).alias("score"))
                pool = pool.join(own, ["qid", "id"])
            else:
                pool = pool.withColumn("score", F.col("fused"))
            pool = self.contents(pool)
            order, signals = (F.col("fused_rank"),), F.map_concat("ranks", rrf)
        w = Window.partitionBy("qid").orderBy(*order)
        ranked = pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
        return ranked.select("qid", "rank", "id", "content", "metadata", "score", signals.alias("signals"))
