"""Training-data pipeline: quality rules, near-duplicates, decontamination, personal data, token ids.

Each stage works on all documents that the one before kept and is written as Parquet in the shared folder; all but the
last return the columns of documents. Rows keep their multiplicity unless a stage removes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import stored, whole
from corpusloom.llm.contamination import decontaminate
from corpusloom.llm.near import near_components
from corpusloom.llm.pieces import encode_documents
from corpusloom.llm.pii import find_pii
from corpusloom.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    out, _ = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a similarity of 0.8 or more on 5-word shingles: that with the smallest
    doc_id, and of its texts in the group that with the smallest hash. Rows without doc_id stay."""
    found = stored(near_components(docs), "pipeline-components")
    first = stored(found.groupBy("component").agg(F.min(F.struct("doc_id", "txt")).alias("k")).select("k.doc_id", F.col("k.txt").alias("_txt")), "pipeline-first")
    again = found.groupBy("doc_id", F.col("txt").alias("_txt")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "_txt")
    kept = docs.withColumn("_txt", F.md5(whole(F.col("text")))).join(first, ["doc_id", "_txt"], "left_semi")
    if not again.isEmpty():
        once = kept.join(again, ["doc_id", "_txt"], "left_semi").dropDuplicates(["doc_id", "_txt"])
        kept = kept.join(again, ["doc_id", "_txt"], "left_anti").unionByName(once)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where("not contaminated").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text."""
    out = find_pii(docs, replace=True).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the text's ids and what they decode to, their number, checksum and whether they decode to
    the text."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "lang", "source", "ids", "decoded", "n_ids", "ids_crc32", "round_trip")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("token_ids", token_ids)]
#: Learned rules and weights have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
