"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, two segments of 32. Two fingerprints that differ in at most 2 bits differ in at most one
bit in one of the segments, so each fingerprint looks up the ball of radius 1 around each of its segments in a table
of exact segment values, and full distances are verified. A table bucket with more than `hot` fingerprints would
pair quadratically; its members are indexed a second time by the ball of radius 1 in the other segment. Whoever meets
there is within 2 bits by construction, at most 33 + 33 fingerprints share such a key, and linking each to the
smallest keeps the links linear.

Null and blank texts have fingerprint zero and link like any other. Equal fingerprints are one class, represented by
the smallest doc_id; a row without doc_id belongs to no class and gets a null component. Repeated rows are returned
as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import bounded_batches, dropped, stored

RADIUS = 2


def fingerprint_of(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint of a whole text: majority bits of the XXH64 (seed 42) of its shingles of `size` words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (a signed long holding the 64 bits) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint_of(x.as_py()) for x in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())]))


def links(classes: DataFrame, hot: int = 64) -> DataFrame:
    """Links (a, b), a < b, between classes (id, fp: distinct fingerprints) that join all within RADIUS differing bits.

    Every pair within the radius is connected by the links, directly or through the smallest member of a shared key."""
    halves = F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("value"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("rest")),
        F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("value"), F.shiftrightunsigned("fp", 32).alias("rest")),
    )
    table = classes.select("id", "fp", F.explode(halves).alias("h")).select("id", "fp", "h.*")
    bits = F.sequence(F.lit(0), F.lit(31))
    flips = lambda c: F.transform(bits, lambda b: c.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    ball = lambda c: F.concat(F.array(c), flips(F.col(c)))
    sizes = table.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n"))
    crowded = sizes.where(F.col("n") > hot).select("seg", "value")
    # Two exact lookups at distance 0 find each pair from both sides, so one order is enough; at distance 1 the side
    # that has the differing bit set asks.
    asks = table.select("id", "fp", "seg", "rest", F.explode(F.concat(F.array("value"), F.filter(flips(F.col("value")), lambda v: v < F.col("value")))).alias("value"), F.col("value").alias("own"))
    cool = table.join(crowded, ["seg", "value"], "left_anti")
    a, b = asks.alias("a"), cool.alias("b")
    near = a.join(b, ["seg", "value"]).where((F.col("a.id") != F.col("b.id")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS))
    pairs = near.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    # Crowded buckets: members spread a ball in the other segment; askers from one bit away bring their exact rest.
    spread = table.join(crowded, ["seg", "value"], "left_semi").select("seg", "value", F.explode(ball("rest")).alias("rest"), "id")
    askers = asks.where("value <> own").select("seg", "value", "rest", "id").join(crowded, ["seg", "value"], "left_semi").select("seg", "value", "rest", "id")
    met = spread.unionByName(askers).groupBy("seg", "value", "rest").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    star = met.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b")
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b).

    Stars are made by turns: each node hands its smallest neighbour, or itself if smaller, to its larger neighbours,
    then to its smaller ones. Edges never become more, a path halves with each turn, and once a turn changes nothing
    every component is one star around its smallest id. A node with very many neighbours meets one row of the other side
    in a sort-merge join, which skew handling can split; every turn is a written table."""
    pair = lambda u, v: [F.col(u).alias("u"), F.col(v).alias("v")]
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc-edges")
    before = None
    while True:
        facts = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if facts == before:
            break
        before = facts
        least = now.unionByName(now.select(*pair("v", "u"))).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(*pair("v", "u")).join(least, "u").select(*pair("v", "m")).distinct()
        large = stored(large, "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(*pair("v", "m")).unionByName(least.select(*pair("u", "m"))).distinct()
        last, now = now, stored(small, "cc-small")
        dropped(now.sparkSession, last, large)
    star = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return star.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def simhash_components(docs: DataFrame, hot: int = 64) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable, itself included) of every row."""
    prints = stored(fingerprints(docs), "simhash-fp")
    classes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-classes")
    found = components(links(classes, hot))
    named = classes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
