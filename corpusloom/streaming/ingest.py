"""Continuous ingest into a store: documents arrive as a stream and are chunked, embedded and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.chunking import STRATEGIES
from corpusloom.operators.segments import SegmentStore
from corpusloom.operators.store import MOCK, Embedder


def ingest(stream: DataFrame, table: str, checkpoint: str, strategy: str = "fixed_size", embedder: Embedder = MOCK) -> StreamingQuery:
    """Append the chunks of a stream of documents (doc_id, text) to a Parquet table; every document is written once,
    as the checkpoint remembers what was read and the file sink what was committed."""
    cut = stream.select("doc_id", F.posexplode(STRATEGIES[strategy](F.col("text"))).alias("chunk_index", "content"))
    made = cut.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string")).alias("id"), "doc_id", "chunk_index", "content", embedder.column(F.col("content")).alias("embedding"))
    return made.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def ingest_changes(stream: DataFrame, store: SegmentStore, checkpoint: str, name: str) -> StreamingQuery:
    """Take a stream of changes (seq, gone, doc_id, content, metadata) into a store: documents are put in the place of older
    ones or deleted. A batch that comes again after a failure changes nothing, as the store remembers it under `name`."""
    taken = stream.writeStream.foreachBatch(lambda batch, number: store.apply(batch, (name, number)) and None)
    return taken.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
