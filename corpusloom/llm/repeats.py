"""Removal of repeated byte strings by bucket-pointer refinement of a suffix array, spread over the cluster.

Every byte covered by a string of `length` bytes that also starts anywhere else goes. Sorting all suffixes of a corpus
would move many times its size, so the buckets are chosen first:

1. Each possible start is owned by an anchor, the bytes of smallest hash within its string, so equal strings
   have equal anchors. Starts of one anchor form a run, whose context is all the bytes of its strings.
2. Runs are counted by anchor and by context. Equal contexts settle their runs; an anchor seen in one context only
   settles it too. What is left are anchors in several contexts, mostly at the edges of copied passages, and only one
   run for each different context needs its bytes looked at.
3. These contexts meet by anchor in one place. A worker concatenates them; their initial q-gram buckets are refined by
   sorting on the bucket numbers of later offsets, whose updates are used again at twice the depth, until buckets hold
   equal strings of the full length. Only members of buckets with company are sorted again.
4. An anchor that more than `hot` contexts share would crowd one place. Its contexts are first cut again by anchors of
   more bytes (GRAMS), settled as in step 2, and meet as in step 3 once few enough share an anchor; at the full length
   an anchor is the string itself.

Steps 1, 2 and 4 tell contexts apart by 128 bits of hash, step 3 the initial q-grams of a batch by 64. Null texts are empty; texts shorter than
`length` lose nothing. Of repeated rows each repeats the other, so all their strings go. A row is known by doc_id and
a hash of its text, so rows that share a doc_id, or have none, are told apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import bounded_batches, dropped, stored, text_slices, whole

LENGTH = 200
#: Bytes of anchors: of documents, then of what is left.
GRAMS = (40, 160, 190)
#: Bytes of the initial q-grams, which are told apart by 64 bits of hash.
FIRST = 50
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Bits of a packed gram that hold its place, at least; a slice of more bytes takes more.
_PLACE_BITS = 30


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS: list[np.ndarray] = [np.ones(0, dtype=np.uint64)] * 2


class Hasher:
    """64-bit hashes of any ranges of a byte array, from one pass of prefix sums."""

    def __init__(self, seed: int):
        self.codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)

    def read(self, data: np.ndarray) -> None:
        if len(data) >= len(_POWERS[0]):
            # Powers are shared by all hashers of a worker.
            n = max(1 << 20, 2 * len(data)) + 1
            _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, f, dtype=np.uint64), dtype=np.uint64)]) for f in (_ODD, _INVERSE)]
        self.up, self.down = _POWERS
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.codes[data] * self.up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        count = len(self.sums) - n
        return _mix((self.sums[n:] - self.sums[:count]) * self.down[:count])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs_of(raws: list[bytes], length: int, gram: int, hashers: tuple[Hasher, Hasher]) -> tuple[np.ndarray, ...]:
    """(document, first start, starts, anchor hash, context hash) of all runs of a slice of documents."""
    sizes = np.array([len(r) for r in raws])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    for h in hashers:
        h.read(data)
    grams = hashers[0].grams(gram)
    place = np.uint64((1 << max(_PLACE_BITS, len(grams).bit_length())) - 1)
    packed = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(packed, length - gram + 1) & place).astype(np.int64)
    doc = np.repeat(np.arange(len(raws)), sizes)[: len(anchor)]
    start = np.arange(len(anchor))
    # Strings that would reach into the next document are none.
    inside = start + length <= bounds[doc + 1]
    start, doc, anchor = start[inside], doc[inside], anchor[inside]
    if not len(start):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    at, owner = anchor[new], doc[new]
    context = hashers[1].of(first, last + length) + (at - first).astype(np.uint64)
    return owner, first - bounds[owner], last - first + 1, grams[at].view(np.int64), context.view(np.int64)


def refine(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers of all positions: two are equal if and only if `length` bytes from there are (the data is padded
    by distinct endings, so a string that runs over the end is like no other)."""
    n, depth = len(data), min(FIRST, length)
    hasher = Hasher(5)
    hasher.read(data)
    # The last few places have no q-gram; each gets a number of its own.
    key = np.concatenate([hasher.grams(depth), np.arange(min(n, depth - 1), dtype=np.uint64)])
    bucket = np.empty(n, dtype=np.int64)
    order = np.argsort(key)
    _number(bucket, order, key[order][1:] != key[order][:-1], np.zeros(n, dtype=np.int64))
    active = _company(bucket, np.arange(n))
    while depth < length and len(active):
        step = min(depth, length - depth)
        later = active + step
        ahead = np.where(later < n, bucket[np.minimum(later, n - 1)], -1 - later)
        # One number for both: buckets come first, what follows decides.
        both = bucket[active] * (2 * n + length) + (ahead + n + length)
        order = np.argsort(both)
        members, a, b = active[order], bucket[active][order], ahead[order]
        # Members keep the room of their bucket: sub-buckets are numbered by their first place in it.
        place = np.arange(len(members))
        opens = np.concatenate([[True], a[1:] != a[:-1]])
        base = np.maximum.accumulate(np.where(opens, place, 0))
        splits = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        bucket[members] = a + np.maximum.accumulate(np.where(splits, place, 0)) - base
        depth += step
        active = _company(bucket, members)
    return bucket


def _number(bucket: np.ndarray, order: np.ndarray, differs: np.ndarray, base: np.ndarray) -> None:
    place = np.arange(len(order))
    bucket[order] = np.maximum.accumulate(np.where(np.concatenate([[True], differs]), place, 0)) + base


def _company(bucket: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The members that share their bucket."""
    own = bucket[members]
    counts = np.bincount(own - own.min()) if len(own) else own
    return members[counts[own - own.min()] > 1] if len(own) else members


def covered(n: int, starts: list[tuple[int, int]], length: int) -> np.ndarray:
    """Which of n bytes lie in a string of `length` bytes from one of the (first, count) starts."""
    edge = np.zeros(n + 1, dtype=np.int32)
    for s, k in starts:
        edge[s] += 1
        edge[s + k - 1 + length] -= 1
    return np.cumsum(edge[:-1]) > 0


_ID = T.StructType().add("id", "long").add("th", "long")
_RUN = T.StructType([*_ID.fields]).add("of", "integer").add("lo", "integer").add("k", "integer").add("anchor", "long").add("ctx", "long").add("full", "boolean")
_SPAN = T.StructType().add("lo", "integer").add("k", "integer")
_CONTEXT = T.StructType([*_ID.fields, *_SPAN.fields]).add("anchor", "long").add("full", "boolean").add("hot", "boolean").add("raw", "binary")
_FOUND = T.StructType([*_ID.fields, *_SPAN.fields])
_DONE = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")


def _result(raw: bytes, starts: list[tuple[int, int]], length: int) -> dict:
    if not starts:
        return {"n_bytes": len(raw), "n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(raw).hexdigest()}
    gone = covered(len(raw), starts, length)
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
    return {"n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of rows (id, th, lo, full, raw), as places in the document; `of` is the row's own lo."""
    schema = to_arrow_schema(_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hasher(1), Hasher(2)
        for b in batches:
            ids, ths, los, full, raws = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(False), b.column(4).to_pylist())
            for i, j in text_slices(raws, 1 << 20):
                owner, lo, k, anchor, ctx = runs_of(raws[i:j], length, gram, hashers)
                owner = i + owner
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(ths[owner]), pa.array(los[owner].astype(np.int32)), pa.array((los[owner] + lo).astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(anchor), pa.array(ctx), pa.array(full[owner].astype(bool))], schema=schema)

    return rows.select("id", "th", "lo", "full", "raw").mapInArrow(run, _RUN)


def _settled(runs: DataFrame, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """Runs that are not unique, with `full` (their context occurs again), many (their anchor has other contexts), rep
    (they show the context's bytes, for one run of it) and hot (more than `hot` contexts); and the tables they rest on."""
    # One run of a context stands for all: that with the smallest hash of its place.
    runs = stored(runs.withColumn("place", F.xxhash64("id", "th", "lo")), "repeats-runs")
    by_context = runs.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("was"), F.min("place").alias("rep"))
    by_anchor = by_context.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("total")).where("total > 1")
    repeated = stored(by_context.join(by_anchor, "anchor").select("anchor", "ctx", (F.col("was") | (F.col("n") > 1)).alias("twice"), F.col("rep").alias("first"), "contexts"), "repeats-contexts")
    many = F.col("contexts") > 1
    out = runs.join(repeated, ["anchor", "ctx"]).select("id", "th", "of", "lo", "k", "anchor", F.col("full").alias("was"), F.col("twice").alias("full"), many.alias("many"), (many & (F.col("first") == F.col("place"))).alias("rep"), (F.col("contexts") > hot).alias("hot")).where(F.col("full") | F.col("many"))
    return out, [runs, repeated]


def _marks(settled: DataFrame, *keys: str) -> DataFrame:
    return settled.groupBy(*keys).agg(F.collect_list(F.struct("lo", "k", "anchor", "full", "rep", "hot")).alias("marks"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(whole(F.col("text"))).alias("th"), F.lit(0).alias("lo"), F.lit(False).alias("full"), whole(F.col("text")).cast("binary").alias("raw"))
    settled, rest = _settled(_runs(rows, length, GRAMS[0]), hot)
    marks = _marks(settled, "id", "th")
    first = rows.join(marks, ["id", "th"], "left")

    kind = docs.schema["doc_id"].dataType
    pending = T.StructType([*_ID.fields]).add("raw", "binary").add("starts", T.ArrayType(_SPAN))
    mixed = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("done", _DONE), T.StructField("pending", pending), T.StructField("context", _CONTEXT)])
    mixed_arrow = to_arrow_schema(mixed)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for r in b.to_pylist():
                raw, found = r["raw"], r["marks"] or []
                starts = [(f["lo"], f["k"]) for f in found if f["full"]]
                if len(starts) == len(found):
                    out.append({"kind": 0, "doc_id": r["doc_id"], "done": _result(raw, starts, length)})
                else:
                    out.append({"kind": 1, "doc_id": r["doc_id"], "pending": {"id": r["id"], "th": r["th"], "raw": raw, "starts": [{"lo": s, "k": k} for s, k in starts]}})
                    size += len(raw)
                out += [{"kind": 2, "context": c} for c in _cut(r, 0, length)]
                size += sum(len(x["context"]["raw"]) for x in out[-len(found) :] if x["kind"] == 2) if found else 0
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=mixed_arrow)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=mixed_arrow)

    parts = stored(first.select("doc_id", "id", "th", "raw", "marks").mapInArrow(settle, mixed), "repeats-parts")
    dropped(spark, *rest)
    contexts = parts.where("kind = 2").select("context.*")
    context_arrow, found_arrow = to_arrow_schema(_CONTEXT), to_arrow_schema(_FOUND)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if out := [c for r in b.to_pylist() for c in _cut(r, r["of"], length)]:
                yield pa.RecordBatch.from_pylist(out, schema=context_arrow)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for r in b.to_pylist():
                # Whole anchors only: the rows come in their order.
                if size > 1 << 20 and r["anchor"] != last:
                    yield _compared(held, length, found_arrow)
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r["raw"]), r["anchor"]
        if held:
            yield _compared(held, length, found_arrow)

    def met(some: DataFrame) -> DataFrame:
        return some.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, _FOUND)

    found, contexts = stored(met(contexts), "repeats-found"), contexts.where("hot")
    for gram in (*GRAMS[1:], length):
        if contexts.isEmpty():
            break
        settled, _ = _settled(_runs(contexts, length, gram), hot)
        here = settled.where("full and not was").select(*_FOUND.fieldNames())
        if gram < length:
            again = contexts.withColumnRenamed("lo", "of").join(_marks(settled.where("many"), "id", "th", "of"), ["id", "th", "of"])
            nearer = stored(again.select("id", "th", "of", "raw", "marks").mapInArrow(cut, _CONTEXT), "repeats-nearer")
            here, contexts = here.unionByName(met(nearer)), nearer.where("hot")
        found = found.unionByName(stored(here, "repeats-found"))
    more = found.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "k")).alias("more"))
    waiting = parts.where("kind = 1").select("doc_id", "pending.*").join(more, ["id", "th"], "left")
    last_schema = T.StructType([T.StructField("doc_id", kind), *_DONE.fields])
    last_arrow = to_arrow_schema(last_schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                starts = [(s["lo"], s["k"]) for s in (r["starts"] or []) + (r["more"] or [])]
                out.append({"doc_id": r["doc_id"]} | _result(r["raw"], starts, length))
            yield pa.RecordBatch.from_pylist(out, schema=last_arrow)

    late = waiting.select("doc_id", "raw", "starts", "more").mapInArrow(finish, last_schema)
    return parts.where("kind = 0").select("doc_id", "done.*").unionByName(late)


def _cut(row: dict, of: int, length: int) -> list[dict]:
    """The contexts that a row shows, cut out of its bytes, which start at place `of` of the document."""
    shown = (f for f in row["marks"] or [] if f["rep"])
    return [{"id": row["id"], "th": row["th"], "lo": f["lo"], "k": f["k"], "anchor": f["anchor"], "full": f["full"], "hot": f["hot"], "raw": row["raw"][f["lo"] - of : f["lo"] - of + f["k"] - 1 + length]} for f in shown]


def _compared(held: list[dict], length: int, schema: pa.Schema) -> pa.RecordBatch:
    """The starts of single contexts whose strings share a bucket with another, as (id, th, first, count)."""
    raws = [r["raw"] for r in held]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raws])])
    bucket = refine(np.frombuffer(b"".join(raws), dtype=np.uint8), length)
    starts = np.concatenate([np.arange(s, s + r["k"]) for s, r in zip(bounds, held, strict=False)])
    owner = np.repeat(np.arange(len(held)), [r["k"] for r in held])
    own = bucket[starts]
    hit = (np.bincount(own)[own] > 1) & ~np.array([r["full"] for r in held])[owner]
    at, who = starts[hit], owner[hit]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(who) != 0)])) if len(at) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(new, len(at)))
    rows = [held[w] for w in who[new]]
    lo = at[new] - bounds[who[new]] + np.array([r["lo"] for r in rows], dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.int64()), pa.array([r["th"] for r in rows], pa.int64()), pa.array(lo.astype(np.int32)), pa.array(size.astype(np.int32))], schema=schema)
