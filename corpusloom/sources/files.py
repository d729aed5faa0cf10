"""Readers and writers of the file formats that corpora come in."""

from __future__ import annotations

import time
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import strip
from corpusloom.operators.corpus import load_documents, upsert


def read_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file_name, text) of whole text files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def read_text_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents (id, content, metadata{source, extension}) of .md and .txt files; other files are skipped."""
    f = read_whole(spark, paths).withColumn("ext", F.lower(F.regexp_extract("file_name", "(\\.[^.]+)$", 1)))
    return f.where(F.col("ext").isin(".md", ".txt")).select(F.regexp_replace("file_name", "\\.[^.]*$", "").alias("id"), F.col("text").alias("content"), F.create_map(F.lit("source"), F.col("path"), F.lit("extension"), F.col("ext")).alias("metadata"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the Markdown files of a folder, not of its folders."""
    return load_documents(read_whole(spark, f"{folder.rstrip('/')}/*.md"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as it is: all columns are text, quotes doubled."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """A list of URLs to fetch: names and values trimmed, nulls empty, rows without url dropped."""
    df = read_manifest(spark, path)
    clean = df.select(*[F.coalesce(strip(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in df.columns])
    if "url" not in clean.columns:
        raise ValueError("the list of URLs needs a column url")
    return clean.where("url <> ''")


def read_existing(spark: SparkSession, path: str, schema: DataFrame | None = None) -> DataFrame | None:
    """The rows of a written manifest by doc_id, the last of each; None if there is none yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    df = read_manifest(spark, path).withColumn("_n", F.monotonically_increasing_id())
    w = Window.partitionBy("doc_id").orderBy(F.desc("_n"))
    return df.where("doc_id is not null and doc_id <> ''").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_n", "_k")


def read_cache(spark: SparkSession, path: str, value: str = "array<double>") -> DataFrame:
    """(key, value) of a cache of JSON lines [key, value]: one file, or what append_cache wrote; later lines win, and
    later batches over earlier ones."""
    lines = spark.read.text(path)
    batch = F.col("batch").cast("string") if "batch" in lines.columns else F.lit("")
    raw = lines.select(F.struct(batch.alias("b"), F.monotonically_increasing_id().alias("n")).alias("n"), F.from_json("value", "array<string>").alias("p"))
    last = raw.where(F.size("p") == 2).groupBy(F.col("p")[0].alias("key")).agg(F.max_by(F.col("p")[1], "n").alias("raw"))
    return last.select("key", (F.col("raw") if value == "string" else F.from_json("raw", value)).alias("value"))


def append_cache(rows: DataFrame, path: str) -> None:
    """New rows (key, value) at the end of a cache of JSON lines [key, value], as read_cache reads them; a key that is
    there already gets the new value. Each write adds files whose names sort behind those of earlier ones."""
    value = rows.schema["value"].dataType
    raw = F.to_json(F.array("value")) if isinstance(value, StringType) else F.to_json(F.struct("value"))
    inner = F.regexp_extract(raw, "^\\[(.*)\\]$", 1) if isinstance(value, StringType) else F.regexp_extract(raw, "^\\{\"value\":(.*)\\}$", 1)
    key = F.regexp_extract(F.to_json(F.array(F.col("key").cast("string"))), "^\\[(.*)\\]$", 1)
    lines = rows.where("key is not null and value is not null").select(F.concat(F.lit("["), key, F.lit(","), inner, F.lit("]")).alias("value"))
    lines.write.mode("append").text(f"{path.rstrip('/')}/batch={time.time_ns():020d}")


def write_markdown(files: DataFrame, folder: str) -> None:
    """One Markdown file for each row (doc_id, text), under folder/doc_id=<id>/: part of the path, so files of all ids
    are written by all tasks at once."""
    files.select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(folder)


def write_drafts(drafts: DataFrame, folder: str) -> None:
    """Drafts (doc_id, metadata, body): bodies as Markdown, metadata as JSON."""
    write_markdown(drafts.select("doc_id", F.col("body").alias("text")), f"{folder}/markdown")
    drafts.select("doc_id", "metadata").write.mode("overwrite").json(f"{folder}/metadata")


def write_sources(rows: DataFrame, path: str) -> None:
    """A sources list as one CSV part, by doc_id: one row for each document of a published corpus."""
    rows.orderBy("doc_id").coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def merge_sources(spark: SparkSession, path: str, new: DataFrame, target: str) -> None:
    """Add new rows to the sources at path, newer ones winning, and write them to target."""
    old = read_existing(spark, path)
    write_sources(new if old is None else upsert(old, new), target)


def write_fetch_log(old: DataFrame | None, new: DataFrame, target: str) -> None:
    """The fetch log as JSON lines, newer entries winning. The target must not be where old is read from."""
    own = urlsplit(target).path.rstrip("/")
    if old is not None and any(f"{urlsplit(f).path}/".startswith(f"{own}/") for f in old.inputFiles()):
        raise ValueError("a log cannot be written over the one that it is made from")
    (new if old is None else upsert(old, new)).write.mode("overwrite").json(target)


def read_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, override) of the files of a folder of overrides."""
    return read_whole(spark, f"{folder.rstrip('/')}/*.md").select(F.regexp_replace("file_name", "\\.md$", "").alias("doc_id"), F.col("text").alias("override"))


def read_pages(spark: SparkSession, path: str, accept: tuple[str, ...] = ("text/html", "text/plain")) -> DataFrame:
    """Pages fetched beforehand (url, html and possibly content_type): only accepted types."""
    df = spark.read.parquet(path)
    if "content_type" in df.columns:
        df = df.where(reduce(lambda a, b: a | b, [F.lower("content_type").startswith(t) for t in accept]))
    return df
