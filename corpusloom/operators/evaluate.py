"""Evaluation of retrieval and answers against gold documents and key phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import has_any, norm
from corpusloom.operators.hybrid import HybridOptions


def _normed(groups: str) -> Column:
    return F.transform(groups, lambda g: F.transform(g, lambda a: norm(a, False)))


def verdicts(hits: DataFrame, answers: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each key of gold (keys, gold_docs, context_keys, answer_keys): score, first_relevant, doc_hit,
    coverage and answer_ok.

    hits (keys, rank, content, doc_id) and answers (keys, answer) have the same key columns, qid and possibly strategy.
    A hit is relevant if it is of a gold document and has a phrase of the first group; coverage is the share of groups
    that occur in the hits together; 2 points are for a relevant first hit and a right answer, 1 for any relevant. Texts
    and phrases are compared as they are composed (see nfc)."""
    keys = [c for c in ("strategy", "qid") if c in hits.columns]
    g = gold.withColumns({"_ck": _normed("context_keys"), "_ak": _normed("answer_keys")})
    joined = hits.join(g, [k for k in keys if k in g.columns])
    of_gold = F.array_contains("gold_docs", F.col("doc_id"))
    relevant = of_gold & has_any(norm(F.col("content"), False), F.get("_ck", 0))
    seen = joined.select(*keys, "rank", "content", of_gold.alias("of_gold"), relevant.alias("relevant"))
    by = seen.groupBy(*keys).agg(
        F.bool_or("of_gold").alias("doc_hit"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_relevant"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("context"),
    )
    base = answers.join(g, [k for k in keys if k in g.columns])
    out = base.join(by, keys, "left")
    context, answer = norm(F.coalesce("context", F.lit("")), False), norm(F.coalesce("answer", F.lit("")), False)
    covered = F.size(F.filter("_ck", lambda k: has_any(context, k))) / F.greatest(F.size("_ck"), F.lit(1))
    ok = F.forall("_ak", lambda k: has_any(answer, k))
    first = F.col("first_relevant")
    return out.select(
        *keys,
        F.when((first == 1) & ok, 2).when(first.isNotNull(), 1).otherwise(0).alias("score"),
        first,
        F.coalesce("doc_hit", F.lit(False)).alias("doc_hit"),
        covered.alias("coverage"),
        ok.alias("answer_ok"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """By strategy: total score, hits of gold documents, relevant results, mean reciprocal rank and right answers."""
    return rows.groupBy("strategy").agg(
        F.sum("score").alias("score"),
        F.count_if("doc_hit").alias("doc_hits"),
        F.count_if(F.col("first_relevant").isNotNull()).alias("relevant"),
        F.avg(F.coalesce(1.0 / F.col("first_relevant"), F.lit(0.0))).alias("mrr"),
        F.count_if("answer_ok").alias("answers_ok"),
    )


def score_matrix(rows: DataFrame, queries: list[str]) -> DataFrame:
    """Strategies by queries."""
    return rows.groupBy("strategy").pivot("qid", queries).agg(F.first("score"))


def filter_effect(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """Scores with and without the metadata filter side by side."""
    keys = [c for c in ("strategy", "qid") if c in filtered.columns]
    pick = lambda df, name: df.select(*keys, F.col("score").alias(f"score_{name}"), F.col("first_relevant").alias(f"first_{name}"))
    return pick(filtered, "filtered").join(pick(unfiltered, "unfiltered"), keys)


def report(rows: DataFrame) -> DataFrame:
    """Formatted lines of a benchmark report, in order."""
    s = summary(rows)
    text = F.format_string("%-28s score=%d doc_hit=%d relevant=%d mrr=%.3f answers=%d", "strategy", "score", "doc_hits", "relevant", "mrr", "answers_ok")
    return s.orderBy(F.desc("score"), "strategy").select(text.alias("line"))


def strategy_matrix(rerankers: dict | None = None) -> dict[str, tuple[str, HybridOptions, object]]:
    """name -> (chunk strategy, options, reranker): the chunkers with dense search, then further branches on the
    structure chunks, and one entry for each reranker on top of all."""
    dense, both, all_ = HybridOptions(), HybridOptions(use_bm25=True), HybridOptions(use_bm25=True, use_hyde=True)
    out = {f"{c} + dense": (c, dense, None) for c in ("fixed_size", "by_sentences", "recursive", "structure_leaf", "structure_aware")}
    out |= {"structure_aware + hybrid": ("structure_aware", both, None), "structure_aware + hybrid + hyde": ("structure_aware", all_, None)}
    return out | {f"structure_aware + hybrid + hyde + {n}": ("structure_aware", all_, r) for n, r in (rerankers or {}).items()}
