"""Prompts, answers and cached calls of language models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers where nothing was found, of the agent and of the pipeline.
AGENT_NOT_FOUND = "Không tìm thấy thông tin liên quan trong cơ sở tri thức."
PIPELINE_NOT_FOUND = "Không tìm thấy thông tin trong tài liệu được cung cấp."
#: What a prompt says before context and question; callers may give their own.
RULES = "Chỉ dùng thông tin trong NGỮ CẢNH và trích dẫn số đoạn nguồn dạng [1], [2]. Nếu ngữ cảnh không đủ, hãy nói rõ: "


TEMPLATE = RULES + '"{not_found}"\n\nNGỮ CẢNH:\n{context}\n\nCÂU HỎI: {question}\n\nTRẢ LỜI:'


def filled(template: str, **columns: Column) -> Column:
    """A template with columns in place of their names in braces; all else stands as it is."""
    parts = re.split(r"\{(" + "|".join(columns) + r")\}", template)
    return F.concat(*[columns[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def demo_llm(prompt: Column) -> Column:
    """The offline model: says what it was asked, first 400 characters on one line."""
    return F.concat(F.lit("[DEMO LLM] Generated answer from prompt preview: "), F.replace(F.substring(prompt, 1, 400), F.lit("\n"), F.lit(" ")), F.lit("..."))


def _joined(hits: DataFrame, label: Column) -> DataFrame:
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), label, F.lit(")\n"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def _get(key: str) -> Column:
    return F.nullif(F.try_element_at("metadata", F.lit(key)), F.lit(""))


def agent_context(hits: DataFrame) -> DataFrame:
    """(qid, context): hits in their order, numbered, each under its source and section (or title)."""
    source = F.coalesce(F.try_element_at("metadata", F.lit("doc_id")), F.col("id"), F.lit("?"))
    section = F.coalesce(_get("section_path"), _get("title"))
    return _joined(hits, F.concat(F.lit("nguồn: "), source, F.coalesce(F.concat(F.lit(" — "), section), F.lit(""))))


def pipeline_context(hits: DataFrame) -> DataFrame:
    """(qid, context) with source, audience and version; empty ones are left out."""
    return _joined(
        hits,
        F.concat_ws(
            " | ",
            F.concat(F.lit("nguồn: "), F.coalesce(F.try_element_at("metadata", F.lit("doc_id")), F.lit("None"))),
            F.concat(F.lit("đối tượng: "), _get("audience")),
            F.concat(F.lit("phiên bản: "), _get("document_version")),
        ),
    )


def prompts(questions: DataFrame, context: DataFrame, not_found: str, template: str = TEMPLATE) -> DataFrame:
    """(qid, question, prompt) by a template of {context}, {question} and {not_found}; the prompt is null where there is
    no context."""
    text = filled(template, context=F.col("context"), question=F.col("question"), not_found=F.lit(not_found))
    return questions.join(context, "qid", "left").select("qid", "question", text.alias("prompt"))


def answers(asked: DataFrame, llm: Callable[[Column], Column] = demo_llm, not_found: str = PIPELINE_NOT_FOUND) -> DataFrame:
    """(qid, answer) of prompts; the model only sees rows that have one."""
    with_prompt = asked.where(F.col("prompt").isNotNull()).select("qid", llm(F.col("prompt")).alias("answer"))
    return with_prompt.unionByName(asked.where(F.col("prompt").isNull()).select("qid", F.lit(not_found).alias("answer")))


def call_missing(asked: DataFrame, cache: DataFrame | None, call: Callable[[list[str]], list], kind: str, batch: int = 96) -> DataFrame:
    """New rows (key, value) for a cache (key, value): keys and texts (key, text) that it lacks, each once, through an
    external call in batches. Append them to the cache table, then read values by joining on the key. Without a cache,
    asked are different keys that are known to be missing."""
    missing = asked if cache is None else asked.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def run(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for p in parts:
            for i in range(0, len(p), batch):
                some = p.iloc[i : i + batch]
                yield pd.DataFrame({"key": some["key"].to_numpy(), "value": pd.Series(list(call(list(some["text"]))), dtype="object")})

    return missing.select("key", "text").mapInPandas(run, f"key string, value {kind}")


def run_agent(store, questions: DataFrame, llm: Callable[[Column], Column] = demo_llm, top_k: int = 3, template: str = TEMPLATE) -> DataFrame:
    """(qid, answer): the agent's answers to questions (qid, question) from the nearest records of a store."""
    from corpusloom.operators.hybrid import HybridOptions, HybridRetriever

    hits = HybridRetriever(store, HybridOptions(candidate_k=max(top_k, 0))).retrieve(questions, top_k)
    return answers(prompts(questions, agent_context(hits), AGENT_NOT_FOUND, template), llm, AGENT_NOT_FOUND)


def run_pipeline(retriever, questions: DataFrame, llm: Callable[[Column], Column] = demo_llm, top_k: int = 3, metadata_filter: dict | None = None, template: str = TEMPLATE) -> tuple[DataFrame, DataFrame]:
    """((qid, answer), hits) of a retriever's pipeline."""
    hits = retriever.retrieve(questions, top_k, metadata_filter)
    return answers(prompts(questions, pipeline_context(hits), PIPELINE_NOT_FOUND, template), llm), hits
