"""A stored BM25 index ordered by impact, and exact ranking that reads only blocks which can matter.

Documents are dealt into shards of a bounded number. Within a shard the postings of a term stand in order of their impact
(the part of the score that a term gives a document, without its idf), cut into blocks; each block has its largest impact
beside it. A document of a block can score no more than the block's maximum plus, for every other term of the question,
the shard's maximum of that term. First the leading blocks of a question's strongest terms give a score that k documents
reach at least; blocks whose bound is below it hold no document of the top k and are never read. Documents that are in the
top k have all their postings in blocks that are read, so their scores are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import TOKEN, nfc, tokens
from corpusloom.operators.lexical import term_counts, weight  # noqa: F401
from corpusloom.session import bounded_batches
from corpusloom.tables import stored

#: Folders of the stored blocks; a question reads only those of its terms.
BUCKETS = 64
#: Rows that a shard has in a folder at most; only those of the terms asked for are unpacked.
PARTS = 1024
#: Terms that may be sent to every task; more are joined by a shuffle.
SENT = 100_000

_KINDS = {"bucket": "int", "part": "int", "shard": "long", "term": "string", "block": "int", "n": "long", "top": "double", "at": "array<long>", "impact": "array<double>"}


@dataclass
class ImpactIndex:
    """rows (id, index), packed blocks, the number of documents and how the index was made.

    A packed row (bucket, part, shard, term, block, n, top, at, impact) has all blocks of a shard whose terms share a hash:
    for each block its term, number, size and largest impact, and the lists of all blocks one after the other. at has the
    documents' indexes."""

    rows: DataFrame
    packed: DataFrame
    n: int
    compose: bool

    @property
    def blocks(self) -> DataFrame:
        """(bucket, part, shard, term, block, n, top, at, impact), a row for each block."""
        return _unpacked(self.packed, list(_KINDS))

    def asked(self, queries: DataFrame) -> DataFrame:
        """(qid, term, idf) of the different terms of queries (qid, question) that the index knows."""
        words = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("question"), self.compose))).alias("term"))
        words = stored(words, "impact-words")
        # Terms are counted when they are asked for; all others stay in their folders.
        df = self.of_terms(words, "term", "n").groupBy("term").agg(F.sum("n").alias("df"))
        return words.join(df, "term").select("qid", "term", weight(F.lit(self.n), F.col("df")).alias("idf"))

    def of_terms(self, asked: DataFrame, *columns: str) -> DataFrame:
        """Blocks of the terms asked for; only their folders are read."""
        terms = asked.select("term").distinct()
        some = [r["term"] for r in terms.limit(SENT + 1).collect()]
        if len(some) > SENT:
            return self.blocks.select(*columns).join(terms, "term", "left_semi")
        parts = np.unique(_place(pa.array(some, pa.string())))
        these = self.packed.sparkSession.createDataFrame(pa.table({"part": parts}))
        found = self.packed.where(F.col("bucket").isin(np.unique(parts % BUCKETS).tolist())).join(F.broadcast(these), "part", "left_semi")
        return _unpacked(found, list(columns), some)


def _place(terms: pa.Array) -> np.ndarray:
    """The part of each term; its remainder is the bucket."""
    return (pd.util.hash_array(terms.to_numpy(zero_copy_only=False).astype(object), categorize=False) % (BUCKETS * PARTS)).astype(np.int32)


def _unpacked(packed: DataFrame, columns: list[str], terms: list[str] | None = None) -> DataFrame:
    """columns of blocks (of all terms, or of those stated) of packed rows."""
    lists = [c for c in ("at", "impact") if c in columns]
    needed = list(dict.fromkeys(["term", *columns, *(["n"] if lists else [])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if terms is None else pa.array(terms, pa.string())
        for batch in batches:
            column = dict(zip(needed, batch.columns, strict=True))
            flat = {c: pc.list_flatten(x) for c, x in column.items() if pa.types.is_list(x.type)}
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(column["term"]).to_numpy())
            keep = np.arange(len(of)) if known is None else np.flatnonzero(pc.is_in(flat["term"], value_set=known).to_numpy(zero_copy_only=False))
            size = flat["n"].to_numpy() if lists else of
            ends = np.cumsum(size)
            for i in range(0, len(keep), 20_000):
                some, out = keep[i : i + 20_000], {}
                n = size[some]
                cuts = np.append(0, np.cumsum(n))
                which = pa.array(np.arange(cuts[-1]) + np.repeat(ends[some] - n - cuts[:-1], n)) if lists else None
                for c in columns:
                    if c in lists:
                        out[c] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat[c].take(which))
                    else:
                        out[c] = flat[c].take(pa.array(some)) if c in flat else column[c].take(pa.array(of[some]))
                yield pa.RecordBatch.from_pydict(out)

    return packed.select(*needed).mapInArrow(run, ", ".join(f"{c} {_KINDS[c]}" for c in columns))


def _numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, number of each word, whether a word can be in a pair) of all words one after the other."""
    coded = words.dictionary_encode()
    digit = pc.match_substring_regex(coded.dictionary, "^\\p{Nd}").to_numpy(zero_copy_only=False).astype(bool)
    code = coded.indices.to_numpy().astype(np.int64)
    return coded.dictionary, code, ~digit[code]


def _paired(of: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Places of words that make a pair with the next one: both are of one row and start with no digit."""
    return np.flatnonzero((of[1:] == of[:-1]) & plain[1:] & plain[:-1])


def _counted(words: pa.Array, of: np.ndarray, rows: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term of each posting, its row, how often the row has the term, terms of each row) of all words of some rows."""
    known, code, plain = _numbered(words)
    at = _paired(of, plain)
    pair, which = np.unique(code[at] * len(known) + code[at + 1], return_inverse=True)
    left, right = np.divmod(pair, max(len(known), 1))
    # A pair may read like a word or another pair.
    terms = pa.concat_arrays([known, pc.binary_join_element_wise(known.take(pa.array(left)), known.take(pa.array(right)), "_")]).dictionary_encode()
    number = terms.indices.to_numpy().astype(np.int64)
    key, tf = np.unique(np.concatenate([number[code] * rows + of, number[len(known) + which] * rows + of[at]]), return_counts=True)
    return terms.dictionary, *np.divmod(key, rows), tf, np.bincount(of, minlength=rows) + np.bincount(of[at], minlength=rows)


def build(docs: DataFrame, per_shard: int = 5_000, block: int = 128, k1: float = 1.5, b: float = 0.75, compose: bool = False, most: int = 2_000_000) -> ImpactIndex:
    """Index docs (id, index, content) and store it; indexes must differ. Statistics cover all docs. A shard has at most
    `per_shard` documents and ends once it has half of `most` words, which make `most` postings at most. A document without
    content counts with no terms.

    Words leave the text once; their pairs are made of numbers of words, and only different pairs of a shard are written out."""
    content = F.col("content")
    words = F.regexp_extract_all(F.lower(nfc(content) if compose else content), F.lit(TOKEN), F.lit(0))
    found = docs.select("id", F.col("index").cast("long").alias("index"), words.alias("w"))
    # A mark for each word; two neighbours without a digit in front make a pair.
    marks = F.array_join(F.transform("w", lambda x: F.when(x.rlike("^\\p{Nd}"), F.lit("1")).otherwise(F.lit("0"))), "")
    size = F.coalesce(F.size("w") + F.regexp_count(marks, F.lit("0(?=0)")), F.lit(0))
    toks = stored(found.withColumn("len", size), "impact-words-of", compression="zstd")
    n, avg_len = toks.agg(F.count(F.lit(1)), F.coalesce(F.avg("len"), F.lit(0.0))).first()
    bounded_batches(docs.sparkSession)
    avg = float(avg_len) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, made, task = [], 0, 0, 0, TaskContext.get().partitionId()

        def out() -> Iterator[pa.RecordBatch]:
            index = np.concatenate([x[0] for x in held])
            of = np.repeat(np.arange(len(index)), np.concatenate([x[1] for x in held]))
            terms, code, row, tf, sizes = _counted(pa.concat_arrays([x[2] for x in held]), of, len(index))
            if not len(code):
                return
            impact, index = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / avg)), index[row]
            # Terms of a part lie together, and parts of a bucket.
            part = _place(terms)
            by_part, many = np.lexsort((part, part % BUCKETS)), np.bincount(code)
            first, many = (np.cumsum(many) - many)[by_part], many[by_part]
            nth = np.arange(len(code)) - np.repeat(np.cumsum(many) - many, many)
            order = np.repeat(first, many) + nth
            # Terms with one posting are in order by now.
            more = np.flatnonzero(np.repeat(many, many) > 1)
            of_term = np.repeat(np.arange(len(many)), many)[more]
            order[more] = order[more][np.lexsort((index[order[more]], -impact[order[more]], of_term))]
            code, index, impact = code[order], index[order], impact[order]
            starts = np.flatnonzero(nth % block == 0)
            ends, part = np.append(starts[1:], len(code)), part[code[starts]]
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(starts))
            for i in range(0, len(cuts) - 1, 1000):
                cut = cuts[i : i + 1001]
                u, v = cut[0], cut[-1]
                head, all_ = starts[u:v], slice(starts[u], ends[v - 1])
                by_block = [terms.take(pa.array(code[head])), pa.array((nth[head] // block).astype(np.int32)), pa.array(ends[u:v] - head), pa.array(impact[head])]
                by_posting = [pa.array(index[all_]), pa.array(impact[all_])]
                blocks = pa.array(cut - u, pa.int32())
                postings = pa.array(np.append(starts[cut[:-1]], ends[v - 1]) - starts[u], pa.int32())
                lists = [pa.ListArray.from_arrays(blocks, x) for x in by_block] + [pa.ListArray.from_arrays(postings, x) for x in by_posting]
                these = part[cut[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(these % BUCKETS), pa.array(these), pa.array(np.full(len(these), (task << 32) + made)), *lists], names=list(_KINDS))

        for batch in batches:
            # A shard has a bounded number of documents and of postings, so what a task holds is bounded.
            i = 0
            while i < len(batch):
                part = batch.slice(i, max(1, min(per_shard - rows, len(batch) - i)))
                i += len(part)
                sizes = pc.list_value_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
                held.append((part.column(0).to_numpy(), sizes, pc.list_flatten(part.column(1))))
                rows, size = rows + len(part), size + int(sizes.sum())
                if rows >= per_shard or 2 * size >= most:
                    yield from out()
                    held, rows, size, made = [], 0, 0, made + 1
        if held:
            yield from out()

    # Documents of a shard are those that lie together, so no posting moves before it is in its block.
    kind = ", ".join(f"{c} {k if c in ('bucket', 'part', 'shard') else f'array<{k}>' if not k.startswith('array') else k}" for c, k in _KINDS.items())
    packed = stored(toks.select("index", "w").mapInArrow(run, kind), "impact-blocks", partitionBy=["bucket"], compression="zstd")
    return ImpactIndex(toks.select("id", "index"), packed, n, compose)


def bounds(ix: ImpactIndex, asked: DataFrame, k: int, seeds: int = 8) -> DataFrame:
    """(qid, term, shard, block, idf, n, read): every block of the questions' terms and whether it can hold a document of
    the top k. The score to reach comes from the leading blocks of a question's `seeds` strongest terms."""
    meta = stored(ix.of_terms(asked, "term", "shard", "block", "n", "top"), "impact-meta")
    each = asked.join(meta, "term").withColumn("most", F.col("idf") * F.col("top"))
    lead = each.where("block = 0").select("qid", "term", "shard", "most")
    caps = lead.groupBy("qid", "shard").agg(F.sum("most").alias("cap"))
    strong = lead.groupBy("qid", "term").agg(F.max("most").alias("most")).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("most"), "term"))).where(F.col("place") <= seeds)
    strong = stored(strong.join(asked, ["qid", "term"]).select("qid", "term", "idf"), "impact-seeds")
    first = ix.of_terms(strong, "term", "block", "at", "impact").where("block = 0")
    seen = first.join(strong, "term").select("qid", "idf", F.explode(F.arrays_zip("at", "impact")).alias("p")).select("qid", F.col("p.at").alias("index"), (F.col("idf") * F.col("p.impact")).alias("part"))
    score = seen.groupBy("qid", "index").agg(F.sum("part").alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "index"))
    reach = score.withColumn("place", place).where(F.col("place") == k).select("qid", F.col("score").alias("reach"))
    bound = F.col("most") + F.col("cap") - F.col("lead")
    out = each.join(lead.withColumnRenamed("most", "lead"), ["qid", "term", "shard"]).join(caps, ["qid", "shard"]).join(reach, "qid", "left")
    # Sums are taken in any order, so what is only just below is read too.
    return out.select("qid", "term", "shard", "block", "idf", "n", (F.col("reach").isNull() | (bound >= F.col("reach") * (1 - 1e-9))).alias("read"))


def ranking(ix: ImpactIndex, queries: DataFrame, k: int = 20, digits: int = 12, seeds: int = 8) -> DataFrame:
    """(qid, id, score, rank) of the k best documents with a positive score for queries (qid, question); scores that are
    equal to `digits` places are equals, and index decides between them.

    Blocks that are read travel once, whole, to the task of their shard, whatever number of questions ask for them; a task
    holds a shard's blocks and one score for each of its documents, and sends k rows for each question."""
    kind = queries.schema["qid"].dataType.simpleString()
    asked = stored(ix.asked(queries), "impact-asked")
    wanted = stored(bounds(ix, asked, k, seeds).where("read").select("shard", "term", "block", "qid", "idf"), "impact-wanted")
    read = ix.of_terms(wanted, "shard", "term", "block", "at", "impact").join(wanted.select("shard", "term", "block").distinct(), ["shard", "term", "block"], "left_semi")

    def score(asks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "index": [], "score": []})]
        if not len(asks):
            return out[0]
        number = {key: i for i, key in enumerate(zip(blocks["term"], blocks["block"], strict=True))}
        sizes = np.array([len(x) for x in blocks["at"]], dtype=np.int64)
        names, place = np.unique(np.concatenate(blocks["at"].to_list()), return_inverse=True)
        impact, ends = np.concatenate(blocks["impact"].to_list()), np.cumsum(sizes)
        for qid, rows in asks.groupby("qid", sort=False):
            total = np.zeros(len(names))
            for term, block, idf in zip(rows["term"], rows["block"], rows["idf"], strict=True):
                i = number[term, block]
                part = slice(ends[i] - sizes[i], ends[i])
                total[place[part]] += idf * impact[part]  # a document stands in a term's list once
            some = np.flatnonzero(total)
            best = some[np.lexsort((names[some], -np.round(total[some], digits)))[:k]]
            out.append(pd.DataFrame({"qid": [qid] * len(best), "index": names[best], "score": total[best]}))
        return pd.concat(out[1:])

    found = wanted.groupBy("shard").cogroup(read.groupBy("shard")).applyInPandas(score, f"qid {kind}, index long, score double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", digits)), "index"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(ix.rows, "index").select("qid", "id", "score", "rank")
