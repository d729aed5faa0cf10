"""A store on disk that takes additions, replacements and deletions without rewriting what is there.

Every change writes one segment of rows, in folders by bucket of doc_id, and then a line of the log, a file named by its
version. The log is the store: a segment that no line names does not exist, so a job that dies leaves nothing half done,
and a line is put in place by a rename that fails where the version is taken, so of two writers one tries again with the
next version. Needs a file system with such a rename (HDFS, local disks); plain object stores have none.

Rows are never changed. A segment that replaces ends all older rows of the doc_ids in it, and a row marked `gone` does
nothing else. Reading is one scan of the segments and an anti join with the doc_ids of those that replace: they are
broadcast where the log says that they are small, and shuffled beyond. `compact` rewrites the buckets that replacing
segments touch, and no others, so that work follows the changes and not the store.

A change may carry the name of a stream and the number of a batch. The log remembers the last batch of each stream, and one
that was taken already changes nothing. Null doc_ids are a document like any other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from corpusloom.operators.store import MOCK, Embedder, VectorStore

ROWS = StructType().add("id", "string").add("content", "string").add("metadata", T.MapType(T.StringType(), T.StringType())).add("doc_id", "string").add("embedding", T.ArrayType(T.DoubleType())).add("index", "long").add("gone", "boolean")
#: Doc_ids of replacing segments that may be sent to every executor, in bytes.
SENT = 64 << 20


@dataclass
class State:
    """What the log says: segments by name, and the last batch of each stream."""

    version: int = 0
    top: int = 0
    segments: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def take(self, version: int, line: dict) -> None:
        self.version = version
        if "stream" in line:
            self.batches[line["stream"]] = line["batch"]
        # Buckets that a compaction took over are read from its own segment.
        for name in line.get("over", []):
            known = self.segments[name]
            known["without"] = sorted({*known["without"], *line["buckets"]})
            if set(known["buckets"]) <= set(known["without"]):
                del self.segments[name]
        if line["holds"]:
            self.segments[line["name"]] = {"version": line.get("as_of", version), "base": line.get("base", self.top), "replaces": line["replaces"], "buckets": line["holds"], "without": [], "bytes": line["bytes"]}
        self.top += line["count"]


class SegmentStore:
    """The store at `path`; every call reads the log anew."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder = MOCK, buckets: int = 64):
        self.spark, self.path, self.embedder, self.buckets = spark, path.rstrip("/"), embedder, buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # ---- log

    def _file(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def state(self, version: int | None = None) -> State:
        """The store as of a version, by default the last one. A line of a compaction holds the state that it leads to, so
        lines before the last of these are not read."""
        folder = self._file("log")
        fs = folder.getFileSystem(self._conf)
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json") and (version is None or int(n.split(".")[0]) <= version)]
        lines = []
        for n in reversed(names):
            stream = fs.open(self._file("log", n))
            try:
                line = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            lines.append((int(n.split(".")[0]), line))
            if "state" in line:
                break
        out = State()
        for v, line in reversed(lines):
            if "state" in line:
                out = State(**line["state"])
            else:
                out.take(v, line)
        return out

    def _put(self, version: int, line: dict) -> bool:
        """Whether the line became that version; False if another writer was first."""
        draft, target = self._file("log", f"{uuid.uuid4().hex}.draft"), self._file("log", f"{version:020d}.json")
        fs = target.getFileSystem(self._conf)
        out = fs.create(draft, False)
        try:
            out.write(json.dumps(line).encode())
        finally:
            out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            files.rename(draft, target, plain)
        except Exception:
            fs.delete(draft, False)
            if fs.exists(target):
                return False
            raise
        return True

    # ---- changes

    def _write(self, rows: DataFrame) -> dict:
        """Write a segment and say what is in it; its rows are computed once."""
        name = f"s-{uuid.uuid4().hex}"
        folder = f"{self.path}/segments/segment={name}"
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        # Otherwise every task would write a file to every bucket; hot buckets are split again.
        dealt = rows.select(*ROWS.fieldNames(), bucket.alias("bucket")).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").parquet(folder)
        kept = self.spark.read.schema("doc_id string, index long, bucket int").parquet(folder)
        sums = kept.groupBy("bucket").agg(F.max("index").alias("top"), F.sum(F.coalesce(F.octet_length("doc_id"), F.lit(0)) + 16).alias("bytes")).collect()
        return {"name": name, "holds": sorted(r["bucket"] for r in sums), "count": max((r["top"] or 0 for r in sums), default=0), "bytes": sum(r["bytes"] for r in sums)}

    def _commit(self, rows: DataFrame, replaces: bool, batch: tuple[str, int] | None) -> bool:
        """Whether the change was taken; a batch that the store has is none."""
        if batch and self.state().batches.get(batch[0], -1) >= batch[1]:
            return False
        line = {**self._write(rows), "replaces": replaces}
        if batch:
            line |= {"stream": batch[0], "batch": batch[1]}
        while True:
            now = self.state()
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return False
            if self._put(now.version + 1, line):
                return True

    def _made(self, docs: DataFrame) -> DataFrame:
        return VectorStore(self.spark, embedder=self.embedder).add(docs).records.withColumn("gone", F.lit(False))

    def add(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Append docs (id, content, metadata and possibly ord), as VectorStore.add does: ids may repeat."""
        return self._commit(self._made(docs), False, batch)

    def replace(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Put docs in the place of all rows of their doc_ids."""
        return self._commit(self._made(docs), True, batch)

    def delete(self, doc_ids: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Delete the rows of doc_ids (doc_id): how many there were."""
        # Only ids that exist are written down.
        hit = self.rows().join(doc_ids.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi")
        found = hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        path = f"{self.path}/deleted/{uuid.uuid4().hex}"
        found.write.parquet(path)
        found = self.spark.read.schema("doc_id string, n long").parquet(path)
        n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        taken = self._commit(self._ended(found), True, batch) if n or batch else True
        self._remove("deleted", path.rsplit("/", 1)[1])
        return n if taken else 0

    @staticmethod
    def _ended(ids: DataFrame) -> DataFrame:
        nothing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in ROWS if f.name not in ("doc_id", "gone")}
        return ids.select("doc_id", *nothing.values(), F.lit(True).alias("gone"))

    def apply(self, changes: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Take changes (seq, gone, doc_id, content, metadata): of every doc_id the rows with its last seq count, and are put
        in the place of all that the store has of it, or, if one of them is `gone`, delete it. Ids of rows are doc_ids."""
        last = changes.groupBy("doc_id").agg(F.max("seq").alias("_seq"), F.max_by("gone", F.struct("seq", "gone")).alias("_gone")).withColumnRenamed("doc_id", "_id")
        kept = changes.join(last, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("seq") == F.col("_seq"))).drop("_id", "_seq")
        own = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("doc_id"), F.col("doc_id")))
        docs = kept.where("not _gone").select(F.col("doc_id").alias("id"), "content", own.alias("metadata"))
        ended = self._ended(kept.where("_gone").select("doc_id").distinct())
        return self._commit(self._made(docs).unionByName(ended), True, batch)

    # ---- reading

    def _scan(self, state: State, replacing: bool = False) -> DataFrame:
        """Rows with segment, bucket and the version that they count from; all, or those of segments that replace."""
        named = {k: v for k, v in state.segments.items() if v["replaces"] or not replacing}
        if not named:
            return self.spark.createDataFrame([], ROWS).select("*", F.lit("").alias("segment"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("version"))
        read = self.spark.read.option("basePath", f"{self.path}/segments").schema(StructType([*ROWS.fields]).add("segment", "string").add("bucket", "integer"))
        rows = read.parquet(*[f"{self.path}/segments/segment={k}" for k in sorted(named)])
        for k, v in named.items():
            if v["without"]:
                rows = rows.where(~((F.col("segment") == k) & F.col("bucket").isin(v["without"])))
        log = self.spark.createDataFrame([(k, v["version"], v["base"]) for k, v in named.items()], "segment string, version long, _base long")
        return rows.join(F.broadcast(log), "segment").withColumn("index", F.col("index") + F.col("_base")).drop("_base")

    def _live(self, state: State) -> DataFrame:
        rows = self._scan(state).where("not gone")
        replacing = [v for v in state.segments.values() if v["replaces"]]
        if not replacing:
            return rows
        ended = self._scan(state, True).groupBy(F.col("doc_id").alias("_id")).agg(F.max("version").alias("_ended"))
        if sum(v["bytes"] for v in replacing) <= SENT:
            ended = F.broadcast(ended)
        return rows.join(ended, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") < F.col("_ended")), "left_anti")

    def rows(self, version: int | None = None) -> DataFrame:
        """(id, content, metadata, doc_id, embedding, index) as of a version; index is the order of addition."""
        return self._live(self.state(version)).select(*ROWS.fieldNames()[:-1])

    def view(self, version: int | None = None) -> VectorStore:
        """The rows as a store to search in."""
        return VectorStore(self.spark, self.rows(version), self.embedder)

    # ---- upkeep

    def compact(self, everything: bool = False) -> bool:
        """Rewrite the buckets that replacing segments touch, or all, as one segment without what is dead. Changes that are
        committed meanwhile stay as they are: the new rows count from the version that was read. Whether the store changed."""
        began = self.state()
        held = {k: set(v["buckets"]) - set(v["without"]) for k, v in began.segments.items()}
        buckets = {b for k, v in began.segments.items() if v["replaces"] or everything for b in held[k]}
        over = [k for k in held if held[k] & buckets]
        if not buckets or (len(over) == 1 and not began.segments[over[0]]["replaces"]):
            return False
        line = self._write(self._live(began).where(F.col("bucket").isin(sorted(buckets))))
        line |= {"replaces": False, "as_of": began.version, "base": 0, "over": over, "count": 0, "buckets": sorted(buckets)}
        while True:
            now = self.state()
            if any(k not in now.segments or now.segments[k] != began.segments[k] for k in over):
                return False  # another compaction was first
            version = now.version + 1
            now.take(version, line)
            if self._put(version, {"state": vars(now)}):
                return True

    def _remove(self, *parts: str) -> None:
        at = self._file(*parts)
        at.getFileSystem(self._conf).delete(at, True)

    def vacuum(self) -> int:
        """Remove segments that the last version does not read: how many. Older versions cannot be read afterwards, and no
        writer may be at work."""
        folder, known = self._file("segments"), self.state().segments
        fs = folder.getFileSystem(self._conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        dead = [n for n in names if n.removeprefix("segment=") not in known]
        for n in dead:
            self._remove("segments", n)
        return len(dead)
