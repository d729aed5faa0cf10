"""Near-duplicates by HyperMinHash.

A document is the set of its shingles, as 64-bit hashes. The first bits of a hash choose one of 256 buckets; of the
smallest rest in a bucket its register keeps the number of leading zeros and the ten bits behind the first one: 16 bits
for what MinHash keeps in 64. Texts with equal sets are one class and are sketched into one row.

Banding: five registers are a band, and classes that agree on one (not all of it empty) share a key. Keys are made from
registers whose mantissa is not cut at ten bits: a short text fills one register of a band, and with 16 bits its key would
be that of many unlike texts, more with every text. A pair of the similarity asked for, 0.8, agrees on none of the 51 bands
with a probability of about 2e-9, and less the more alike.
Keys with many members are no reason to pair them all: `groups.linked` lets them meet heads; what is not joined by then is
compared in place, in the task that holds the key's members; members of keys that are still crowded (a passage that many
texts share) meet by the rarest shingles of their sets instead, which misses no pair.

Of every pair that meets, the registers first give an estimate: the share of equal registers among those that either has,
less the collisions that sets of these sizes give by chance. A pair goes on unless the estimate is so far below the bound
that a pair at the bound would show it with a probability under exp(-20). Then the whole sets decide.

Null and blank texts have no shingles, are empty sets and linked with nothing. A row without doc_id is linked with nothing
and stays (its component is null). Repeated rows are one class; a doc_id with several texts has a row for each. Other
columns of the table are not read. Two different sets are taken for equal if their 64-bit signatures are.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import bounded_batches, stored
from corpusloom.llm.groups import linked, prefix_heads, similar_sets, similar_within
from corpusloom.llm.hashing import components
from corpusloom.llm.near import Shingler, _sig, members_answered, prefix_sets

SHARE = (4, 5)
BUCKET_BITS, MANTISSA, ROWS = 8, 10, 5
REST = 64 - BUCKET_BITS
BUCKETS = 1 << BUCKET_BITS
#: A pair is dropped by its estimate only if it is less likely than exp(-DOUBT) at the bound.
DOUBT = 20.0
#: Candidates that may be sent to every executor to fetch their texts (8 bytes each); more are joined by a shuffle.
FETCHED = 1_000_000


def smallest(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that are not empty, smallest rest of each) of a set of sorted 64-bit hashes."""
    starts = np.searchsorted(h, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(REST))
    full = np.flatnonzero(starts < np.append(starts[1:], len(h)))
    # Hashes are sorted, so the first of a bucket is its smallest.
    return full, h[starts[full]] & np.uint64((1 << REST) - 1)


def registers(h: np.ndarray) -> np.ndarray:
    """The registers of a set of sorted 64-bit hashes; 0 is an empty bucket."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    full, low = smallest(h)
    high = low >> np.uint64(16)  # few enough bits to be exact as a float
    bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 16, np.frexp(low.astype(np.float64))[1])
    shift = np.minimum(64 - bits, 63).astype(np.uint64)
    mantissa = (low << shift >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out[full] = ((REST - bits) << MANTISSA) + mantissa.astype(np.int64) + 1
    return out


#: What the registers of a key are multiplied by, one row for each band.
FACTORS = np.random.default_rng(12).integers(1 << 62, 1 << 63, (BUCKETS // ROWS, ROWS), dtype=np.uint64) | np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """The keys of the bands of a set of sorted 64-bit hashes that are not empty."""
    full, low = smallest(h)
    r = np.zeros(BUCKETS, dtype=np.uint64)
    r[full] = low + np.uint64(1)
    r = r[: FACTORS.size].reshape(FACTORS.shape)
    x = (r + np.uint64(1)) * FACTORS
    x = (x ^ (x >> np.uint64(31))).sum(axis=1) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29)))[r.any(axis=1)]


@functools.lru_cache(maxsize=4096)
def chance(quarter: int) -> float:
    """Probability that the registers of one bucket of two disjoint sets of 2 ** (quarter / 4) members are equal, given that
    one of them has any."""
    rate = 2 ** (quarter / 4) / BUCKETS
    zeros = np.arange(REST, dtype=np.float64)[:, None]
    lower = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    cell = np.exp(-rate * lower) * -np.expm1(-rate * 2.0 ** -(zeros + 1) / (1 << MANTISSA))
    return float((cell**2).sum() / -np.expm1(-2 * rate))


def estimates(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated Jaccard similarity, registers it rests on) of rows of registers of sets of sa and sb members."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    sa, sb = sa.astype(np.float64), sb.astype(np.float64)
    lucky = np.array([chance(int(q)) for q in np.rint(2 * np.log2(np.maximum(sa * sb, 1)))])
    # Sets of different sizes collide less.
    lucky *= 4 * sa * sb / np.maximum((sa + sb) ** 2, 1)
    return np.clip((equal / np.maximum(either, 1) - lucky) / (1 - lucky), 0, 1), either


def promising(similarity: np.ndarray, n: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Whether a pair at the bound would show so low an estimate with a probability (Chernoff) of exp(-DOUBT) or more."""
    bound = share[0] / share[1]
    x = np.clip(similarity, 1e-12, 1 - 1e-12)
    far = n * (x * np.log(x / bound) + (1 - x) * np.log((1 - x) / (1 - bound)))
    return (x >= bound) | (far <= DOUBT)


def sketches(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, sig (of the set; null if it is empty), s (members), registers and keys of bands of every row of docs (doc_id,
    text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            sigs = np.array([_sig(h) for h in sets], dtype=np.uint64).view(np.int64)
            sizes = np.array([len(h) for h in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, mask=sizes == 0), pa.array(sizes), pa.array([registers(h).tobytes() for h in sets], pa.binary()), pa.array([band_keys(h).tobytes() for h in sets], pa.binary())], names=["doc_id", "sig", "s", "registers", "keys"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    return docs.select("doc_id", "text").mapInArrow(run, kind.add("sig", "long").add("s", "long").add("registers", "binary").add("keys", "binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint16).reshape(-1, BUCKETS)


def bands(classes: DataFrame) -> DataFrame:
    """(key, id): the keys of the bands of classes (id, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(b.column(0).to_numpy(), [len(k) for k in keys]))], names=["key", "id"])

    return classes.select("id", "keys").mapInArrow(run, "key long, id long")


def estimated(pairs: DataFrame, classes: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """Those of pairs (a, b) of classes (id, s, registers) that their registers do not rule out."""
    one, two = (classes.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"), F.col("registers").alias(f"r{c}")) for c in "ab")
    p, q = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sa, sb = (b.column(c).to_numpy() for c in (2, 3))
            keep = promising(*estimates(_matrix(b.column(4)), _matrix(b.column(5)), sa, sb), share)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in (0, 1)], names=["a", "b"]).filter(pa.array(keep))

    fit = (F.col("sa") * q >= F.col("sb") * p) & (F.col("sb") * q >= F.col("sa") * p)
    both = pairs.join(one, "a").join(two, "b").where(fit)
    return both.select("a", "b", "sa", "sb", "ra", "rb").mapInArrow(run, "a long, b long")


def _pairs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all pairs within runs [start, end)."""
    sizes = ends - starts
    # Position i meets those behind it in its run.
    behind = np.repeat(ends, sizes) - np.arange(sizes.sum()) - 1
    first = np.repeat(np.arange(len(behind)), behind)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(behind) - behind, behind)


def estimated_within(rest: DataFrame, classes: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """(a, b), a < b: pairs of one key and different labels in rest (key, id, label) that registers do not rule out. The
    members of a key arrive together and are compared in place, so only what passes becomes a row."""
    p, q = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in itertools.chain(batches, [None]):
            table = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if table is None or not len(table):
                continue
            key, ids, label, s = (table.column(c).to_numpy() for c in range(4))
            # The last key may go on in the next batch.
            stop = len(key) if b is None else int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            held = table.slice(stop)
            r = _matrix(table.column(4).slice(0, stop))
            starts = np.flatnonzero(np.append(True, key[1:stop] != key[: stop - 1])) if stop else np.empty(0, dtype=np.int64)
            ends = np.append(starts[1:], stop)
            first, second = _pairs(starts, ends)
            fit = (label[first] != label[second]) & (s[first] * q >= s[second] * p) & (s[second] * q >= s[first] * p)
            first, second = first[fit], second[fit]
            for k in range(0, len(first), 4096):
                i, j = first[k : k + 4096], second[k : k + 4096]
                keep = promising(*estimates(r[i], r[j], s[i], s[j]), share)
                x, y = ids[i[keep]], ids[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    # Registers travel only for members that have one of a size within the bound next to them in order of size.
    by = Window.partitionBy("key").orderBy("s")
    sized = rest.select("key", "id", "label").join(classes.select("id", "s"), "id")
    sized = sized.withColumns({"below": F.lag("s").over(by), "above": F.lead("s").over(by)})
    sized = sized.where((F.col("below") * q >= F.col("s") * p) | (F.col("s") * q >= F.col("above") * p)).select("key", "id", "label")
    both = sized.join(classes.select("id", "s", "registers"), "id").select("key", "id", "label", "s", "registers")
    return both.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, size: int = 4) -> DataFrame:
    """(id, s, hs): the whole sets of classes wanted (id, first: a doc_id that has it), computed from the texts again."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(0)]
            ids = np.array([_sig(h) for h in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["id", "s", "hs"])

    first = wanted.select(F.col("first").alias("doc_id")).distinct()
    first = F.broadcast(first) if first.count() <= FETCHED else first
    made = docs.select("doc_id", "text").join(first, "doc_id", "left_semi").select("text").mapInArrow(run, "id long, s long, hs array<long>")
    # A doc_id may stand for other texts too, and for repeated rows.
    return made.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def minhash_components(docs: DataFrame, size: int = 4, share: tuple[int, int] = SHARE, crowded: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over pairs of similarity `share` or more, itself
    included) and kept (whether it is its own) of every row of docs."""
    rows = stored(sketches(docs, size), "minhash-rows")
    known = rows.where("doc_id is not null and sig is not null")
    classes = stored(known.groupBy(F.col("sig").alias("id")).agg(F.min("doc_id").alias("first"), F.max("s").alias("s"), F.first("registers").alias("registers"), F.first("keys").alias("keys")), "minhash-classes")

    def sets(ids: DataFrame) -> DataFrame:
        return stored(sets_of(docs, stored(classes.join(ids, "id", "left_semi").select("id", "first"), "minhash-wanted"), size), "minhash-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        left = stored(estimated(pairs, classes, share), "minhash-left")
        return similar_sets(left, sets(left.select(F.explode(F.array("a", "b")).alias("id")).distinct()), share)

    def by_prefix(ids: DataFrame) -> DataFrame:
        """Links among crowded classes, by the rarest members of their sets."""
        whole = sets(ids)
        total = whole.agg(F.sum("s")).first()[0] or 0
        held = stored(prefix_sets(members_answered(whole, total), share), "minhash-prefix-sets")
        return linked(prefix_heads(held), lambda pairs: similar_sets(pairs, held, share), "minhash-crowd", within=lambda rest: similar_within(rest, held, share, joined=True))

    def within(rest: DataFrame) -> DataFrame:
        left = stored(estimated_within(rest, classes, share), "minhash-left")
        return similar_sets(left, sets(left.select(F.explode(F.array("a", "b")).alias("id")).distinct()), share)

    found = components(linked(bands(classes), verify, "minhash", crowded, by_prefix, within))
    named = classes.select("id", "first").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = stored(named.join(least, "component").select(F.col("id").alias("sig"), "component_id"), "minhash-labels")
    out = rows.select("doc_id", "sig", "s").join(labels, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("s").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
