"""WARC archives of pages, and the merge of their index into one globally ordered capture history.

Archives are written as compressed records in segments, rows of a table in the shared folder, so any store that Spark
reaches holds them; each segment is a well-formed sequence of WARC members. Reading them back gives index entries;
every reading task sorts its own into runs of bounded length. For the merge, entries are dealt into ranges of (URL
key, timestamp, page), which also cuts a URL with very many captures, and each range merges the runs that reach into
it by a loser tree.

Null html is an empty payload; a null url has an empty key and no target header. Of equal payloads of at least
MIN_REVISIT bytes the largest page_id is the response; rows that repeat this page_id are responses too, and a null
page_id is never the largest unless there is no other. A capture's time is the start of 2024 plus page_id seconds.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import bounded_batches, stored, whole

MIN_REVISIT = 1000
SEGMENT_BYTES = 4 << 20
RUN_ROWS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


def url_key(url: str | None) -> str:
    """Host parts in reverse order, then the rest, in lower case and without scheme."""
    if not url:
        return ""
    rest = url.lower().split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit without payload that names the page it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    when = _EPOCH + timedelta(seconds=(page_id or 0) % 10**9)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(segment: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every member of a segment, in one pass; blocks are cut by their stated length."""
    view, at = memoryview(segment), 0
    while at < len(view):
        member, parts, pos = zlib.decompressobj(31), [], at
        while not member.eof:
            if pos >= len(view):
                raise ValueError("a record is cut short")
            piece = view[pos : pos + (1 << 14)]
            parts.append(member.decompress(piece))
            pos += len(piece)
        start, at = at, pos - len(member.unused_data)
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield start, headers, body[: int(headers["Content-Length"])]


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    rows = pages.select("page_id", "url", whole(F.col("html")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    big = rows.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", "digest")
    first = stored(big.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-first")
    out = rows.join(first, "digest", "left")
    return out.select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


_ARCHIVE = T.StructType().add("archive", "integer").add("segment", "integer").add("content", "binary")


def write_archives(pages: DataFrame) -> DataFrame:
    """The stored archives: (archive, segment, content)."""
    bounded_batches(pages.sparkSession)
    schema = to_arrow_schema(_ARCHIVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, segment, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive], pa.int32()), pa.array([segment], pa.int32()), pa.array([b"".join(held)], pa.binary())], schema=schema)

        for b in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(gzip.compress(record(page_id, url, html.encode(), digest, refers), 1, mtime=0))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield out()
                    segment, held, size = segment + 1, [], 0
        if held:
            yield out()

    return stored(decided(pages).mapInArrow(run, _ARCHIVE), "warc")


_ENTRY = T.StructType().add("url_key", "string").add("captured", "string").add("page_id", "long").add("payload_bytes", "long").add("payload_digest", "string").add("record_type", "string").add("refers_to", "long").add("archive", "integer").add("segment", "integer").add("offset", "long").add("run", "long")


def index_runs(archives: DataFrame) -> DataFrame:
    """Index entries of all archives, read back and checked: stored runs, each sorted by (url_key, captured, page_id)."""
    bounded_batches(archives.sparkSession, 4)
    schema = to_arrow_schema(_ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def out() -> pa.RecordBatch:
            nonlocal number, held
            held.sort(key=_order)
            got = pa.RecordBatch.from_pylist([x | {"run": number} for x in held], schema=schema)
            number, held = number + 1, []
            return got

        page = lambda x: int(x[len("<urn:page:") : -1]) if x != "<urn:page:>" else None
        for b in batches:
            for r in b.to_pylist():
                for offset, h, block in records(r["content"]):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = h["WARC-Type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError("a payload differs from its digest")
                    held.append({"url_key": url_key(h.get("WARC-Target-URI")), "captured": h["WARC-Date"], "page_id": page(h["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(h["WARC-Refers-To"]) if kind == "revisit" else None, "archive": r["archive"], "segment": r["segment"], "offset": offset})
                    if len(held) >= RUN_ROWS:
                        yield out()
        if held:
            yield out()

    return stored(archives.mapInArrow(run, _ENTRY), "warc-runs")


def _order(x: dict) -> tuple:
    return x["url_key"], x["captured"], x["page_id"] is not None, x["page_id"] or 0, x["archive"], x["segment"], x["offset"]


class LoserTree:
    """k-way merge of sorted iterators: each inner node holds the loser of its match, so a step costs one path."""

    def __init__(self, sources: list[Iterator], key):
        self.key, self.sources, k = key, sources, len(sources)
        self.heads = [self._next(s) for s in sources]
        self.tree = [-1] * max(k, 1)
        winners = [*([None] * k), *range(k)]
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            win, lose = (a, b) if self._beats(a, b) else (b, a)
            winners[node], self.tree[node] = win, lose
        self.winner = (winners[1] if k > 1 else 0) if k else -1

    def _next(self, source: Iterator):
        x = next(source, None)
        return None if x is None else (self.key(x), x)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[0] < y[0] or (x[0] == y[0] and a < b))

    def __iter__(self) -> Iterator:
        k = len(self.sources)
        while self.winner >= 0 and (top := self.heads[self.winner]) is not None:
            yield top[1]
            w = self.winner
            self.heads[w] = self._next(self.sources[w])
            node = (w + k) // 2
            while node:
                if self._beats(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.winner = w


def merge_index(runs: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """The capture history: all entries with `position`, their place in the order of (url_key, captured, page_id)."""
    spark = runs.sparkSession
    bounded_batches(spark, 10_000)
    n = runs.count()
    kind = T.StructType([*_ENTRY.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    schema = to_arrow_schema(kind)
    names = [f.name for f in _ENTRY.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A piece of a run arrives in its order; where the order breaks or another run begins, a new piece does.
        pieces, last = [], None
        for b in batches:
            for r in b.to_pylist():
                key = (r["run"], _order(r))
                if last is None or key[0] != last[0] or key[1] < last[1]:
                    pieces.append([])
                pieces[-1].append(r)
                last = key
        part, place, out = TaskContext.get().partitionId(), 0, []
        for r in LoserTree([iter(x) for x in pieces], _order):
            out.append(r | {"part": part, "place": place})
            place += 1
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    dealt = runs.select(*names).repartitionByRange(max(1, -(-n // range_rows)), "url_key", "captured", F.col("page_id").asc_nulls_first())
    merged = stored(dealt.mapInArrow(run, kind), "warc-history")
    # One row for each range: its number of entries.
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return merged.join(before, "part").withColumn("position", F.col("before") + F.col("place")).drop("before", "part", "place", "run")
