"""Language-model scores by a weighted backoff automaton.

Every word and every pair of neighbouring words of the training texts is a state. From a state with count c, a word
that followed it n times has an arc of weight log10((n + MASS * p) / (c + MASS)), where p is the word's probability in
the state's shorter context; for every other word a failure arc of weight log10(MASS / (c + MASS)) leads to that shorter
context. The start state has an arc for every word, known or not, of the weight that the base score gives it. So the
probabilities that leave a state sum to one. Nothing is left out: all words, pairs and triples of training are counted,
and the model grows with the corpus.

Counts meet texts without a table of the model that one machine must hold. Texts are stored as slices of token numbers.
A slice asks for the counts of its distinct words, pairs and triples in blocks, one for each bucket of hashes, and says
how often training has them in the slice; a bucket adds up and answers every block; a slice's part of the automaton is
then complete, and one pass from left to right scores its texts. Blocks are the largest thing on disk, and noise that cannot be
compressed; buckets are therefore asked in turns, and a turn's blocks are gone before the next one's are made. Buckets and slices follow the number of tokens; a word
of any frequency is asked for once a slice. Words, pairs and triples are known by 64 bits of hash.

Null and blank texts consist of the end token alone. Repeated rows are scored one by one. A null doc_id is not held out.
With no training text every word is unknown and has probability one. A text longer than a slice is a slice of its own,
and is scored in windows that carry the state. Other columns of docs are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import arrow_slices, bounded_batches, crc_mod, dropped, stored

#: The end token is a byte that no text in UTF-8 has.
END = b"\xff"
#: Observations that the shorter context is worth.
MASS = 4.0

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def tokens(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased, and the end token."""
    return [*(text or "").encode().lower().split(), END]


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of grams: of a pair from the hashes of its words, of a triple from the keys of its two pairs."""
    x = (a ^ (a >> np.uint64(31))) * _A + (b ^ (b >> np.uint64(29))) * _B
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def packed(x: np.ndarray) -> bytes:
    """Numbers in the fewest whole bytes that hold them all, first bytes first, which compresses well."""
    size = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    size = len(raw) // n if n else 0
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T
    return out.view("<u8").ravel()


def keys_packed(k: np.ndarray) -> bytes:
    """Sorted keys: the first one, then the steps from each to the next in the fewest whole bytes, first bytes first. Steps
    are mostly far below the largest, so their last byte has few values and is compressed; the others are noise."""
    if len(k) < 2:
        return k.astype("<u8").tobytes()
    raw, n = packed(np.diff(k)), len(k) - 1
    return k[:1].astype("<u8").tobytes() + bytes([len(raw) // n]) + raw[:-n] + pa.Codec("zstd").compress(raw[-n:], asbytes=True)


def keys_unpacked(raw: bytes, n: int) -> np.ndarray:
    if n < 2:
        return np.frombuffer(raw, dtype="<u8").astype(np.uint64)
    last = 9 + (raw[8] - 1) * (n - 1)
    steps = raw[9:last] + pa.Codec("zstd").decompress(raw[last:], n - 1, asbytes=True)
    return np.cumsum(np.append(np.frombuffer(raw[:8], dtype="<u8"), unpacked(steps, n - 1).astype(np.uint64)), dtype=np.uint64)


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, hash of each different word, word number of each token) of a column of texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    words, which = coded.dictionary, coded.indices.to_numpy()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    real = pc.binary_length(words).to_numpy(zero_copy_only=False)[which] > 0 if len(which) else np.zeros(0, dtype=bool)
    which, sizes = which[real], np.bincount(of[real], minlength=len(texts))
    # The last number is the end token's.
    which = np.insert(which, np.cumsum(sizes), len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in [*words.cast(pa.binary()).to_pylist(), END]), dtype=np.uint64)
    # Frequent words get small numbers.
    order = np.argsort(-np.bincount(which, minlength=len(hashes)), kind="stable")
    number = np.empty(len(order), dtype=np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    used = len(np.flatnonzero(np.bincount(which, minlength=len(hashes))))
    return sizes + 1, hashes[order][:used], number[which]


_SLICE = T.StructType().add("slice", "long").add("lengths", T.ArrayType(T.IntegerType())).add("words", "binary").add("numbers", "binary")
_BLOCK = T.StructType().add("bucket", "integer").add("slice", "long").add("window", "integer").add("n_words", "integer").add("n_grams", "integer").add("words", "binary").add("word_counts", "binary").add("grams", "binary").add("gram_counts", "binary")
_ANSWER = T.StructType().add("slice", "long").add("window", "integer").add("bucket", "integer").add("n_words", "integer").add("word_counts", "binary").add("n_grams", "integer").add("gram_counts", "binary").add("tokens", "long").add("different", "long")


def slices(docs: DataFrame, out_of: Column, slice_bytes: int) -> DataFrame:
    """The stored slices: doc_ids, held and token numbers of runs of texts."""
    bounded_batches(docs.sparkSession, 10_000)
    kind = docs.schema["doc_id"].dataType
    full = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), *_SLICE.fields])
    schema = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, j in arrow_slices(b.column(2), slice_bytes):
                lengths, words, numbers = numbered(b.column(2)[i:j])
                row = {"ids": b.column(0)[i:j].to_pylist(), "held": b.column(1)[i:j].to_pylist(), "slice": number, "lengths": lengths, "words": words.astype("<u8").tobytes(), "numbers": packed(numbers)}
                yield pa.RecordBatch.from_pylist([row], schema=schema)
                number += 1

    return stored(docs.select("doc_id", out_of.alias("held"), "text").mapInArrow(run, full), "lm-slices", compression="zstd")


class Window:
    """A run of a slice's tokens, with the two before it, and the sorted keys of its words, pairs and triples."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, text: np.ndarray, start: int, stop: int):
        low = max(0, start - 2)
        self.start, self.low, self.stop = start, low, stop
        self.numbers, self.text = numbers[low:stop], text[low:stop]
        present = np.flatnonzero(np.bincount(self.numbers, minlength=len(hashes)))
        order = np.argsort(hashes[present])
        self.present = present[order]
        self.words = hashes[self.present]
        h = hashes[self.numbers]
        pairs = combined(h[:-1], h[1:])
        # Where the last word of each pair and triple stands; grams do not cross texts.
        self.at2 = np.flatnonzero(self.text[1:] == self.text[:-1]) + 1
        self.at3 = np.flatnonzero(self.text[2:] == self.text[:-2]) + 2
        keys = np.concatenate([pairs[self.at2 - 1], combined(pairs[self.at3 - 2], pairs[self.at3 - 1])])
        self.order = np.argsort(keys)
        ranked = keys[self.order]
        self.first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, dtype=np.int64)
        self.grams = ranked[self.first]

    def training(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often training has each word and each gram here, given which texts are training."""
        flag = train[self.text]
        flag[: self.start - self.low] = False
        words = np.bincount(self.numbers[flag], minlength=int(self.present.max()) + 1)[self.present]
        flags = np.concatenate([flag[self.at2], flag[self.at3]])[self.order].astype(np.int64)
        return words, np.add.reduceat(flags, self.first) if len(flags) else flags

    def blocks(self, train: np.ndarray, buckets: int, turns: int = 1, turn: int = 0) -> Iterator[tuple]:
        """(bucket, number of words and of grams, word keys and counts, gram keys and counts) of the buckets of a turn; keys
        are in order within and across buckets."""
        words, grams = self.training(train)
        cuts = [np.searchsorted((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64)).tolist() for k in (self.words, self.grams)]
        for k in range(turn, buckets, turns):
            (a, b), (c, d) = cuts[0][k : k + 2], cuts[1][k : k + 2]
            if b > a or d > c:
                yield k, b - a, d - c, keys_packed(self.words[a:b]), packed(words[a:b]), keys_packed(self.grams[c:d]), packed(grams[c:d])

    def scores(self, word_counts: np.ndarray, gram_counts: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base, score) of each token from `start` on: the arcs that the traversal takes.

        The state before a token is the longest known run of up to two words before it. Failure arcs are taken, and
        their weights added, until the state has an arc for the token; the arc's target is the next token's state."""
        by_number = np.zeros(int(self.present.max()) + 1, dtype=np.float64)
        by_number[self.present] = word_counts
        one = by_number[self.numbers]
        sizes = np.diff(np.append(self.first, len(self.order)))
        found = np.empty(len(self.order), dtype=np.float64)
        found[self.order] = np.repeat(gram_counts, sizes)
        two, three = np.zeros(len(one)), np.zeros(len(one))
        two[self.at2], three[self.at3] = found[: len(self.at2)], found[len(self.at2) :]
        start = np.log10((one + 0.5) / scale)
        inside = np.zeros(len(one), dtype=bool)
        inside[self.at2] = True
        before = np.where(inside, np.append(0.0, one[:-1]), 0.0)
        pair_before = np.where(inside, np.append(0.0, two[:-1]), 0.0)
        # 2: a pair's state, 1: a word's, 0: the start state.
        state = np.where(pair_before > 0, 2, np.where(before > 0, 1, 0))
        low = (one + 0.5) / scale
        middle = (two + MASS * low) / (before + MASS)
        from_word = np.where(two > 0, np.log10(middle), np.log10(MASS / (before + MASS)) + start)
        from_word = np.where(state >= 1, from_word, start)
        top = (three + MASS * middle) / (pair_before + MASS)
        from_pair = np.where(three > 0, np.log10(top), np.log10(MASS / (pair_before + MASS)) + from_word)
        skip = self.start - self.low
        return (one > 0)[skip:], start[skip:], np.where(state == 2, from_pair, from_word)[skip:]


def _opened(words: bytes, numbers: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words, word number of each token, text number of each token) of a stored slice."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    return np.frombuffer(words, dtype="<u8").astype(np.uint64), unpacked(numbers, len(text)).astype(np.int64), text


def asked(parts: DataFrame, buckets: int, window: int, turns: int = 1, turn: int = 0) -> DataFrame:
    """Blocks of keys and training counts, one for each window of a slice and bucket of a turn."""
    schema = to_arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, held, lengths, words, numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hashes, numbers, text = _opened(words, numbers, np.array(lengths))
                train = ~np.array(held, dtype=bool)
                for w, at in enumerate(range(0, len(numbers), window)):
                    got = [*Window(hashes, numbers, text, at, min(at + window, len(numbers))).blocks(train, buckets, turns, turn)]
                    if not got:
                        continue
                    columns = list(zip(*got, strict=True))
                    n = len(got)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([number] * n, pa.int64()), pa.array([w] * n, pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[3:])], schema=schema)

    bounded_batches(parts.sparkSession, 8)
    return parts.select("slice", "held", "lengths", "words", "numbers").mapInArrow(run, _BLOCK)


def answered(blocks: DataFrame, buckets: int) -> DataFrame:
    """The stored answers: for every block the training counts of its keys in the whole corpus; the first row of a task
    has the number of tokens and of different words of its buckets, others 0."""
    schema = to_arrow_schema(_ANSWER)

    def total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        k, c = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k)
        k = k[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
        sums = np.add.reduceat(c[order].astype(np.int64), first) if len(k) else np.zeros(0, dtype=np.int64)
        out = np.empty(len(k), dtype=np.int64)
        out[order] = np.repeat(sums, np.diff(np.append(first, len(k))))
        return np.split(out, np.cumsum([len(x) for x in keys])[:-1]), sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, counts = [], ([], []), ([], [])
        for b in batches:
            names += list(zip(*(b.column(c).to_pylist() for c in (1, 2, 0)), strict=True))
            for which in (0, 1):
                for n, x, y in zip(*(b.column(c).to_pylist() for c in (3 + which, 5 + 2 * which, 6 + 2 * which)), strict=True):
                    keys[which].append(keys_unpacked(x, n))
                    counts[which].append(unpacked(y, n).astype(np.uint32))
        if not names:
            return
        words, known = total(keys[0], counts[0])
        keys[0].clear()
        grams, _ = total(keys[1], counts[1])
        keys[1].clear()
        stats = [(int(known.sum()), int((known > 0).sum()))] + [(0, 0)] * (len(names) - 1)
        for i in range(0, len(names), 64):
            some = [{"slice": s, "window": w, "bucket": k, "n_words": len(x), "word_counts": packed(x), "n_grams": len(y), "gram_counts": packed(y), "tokens": t, "different": d} for (s, w, k), x, y, (t, d) in zip(names[i : i + 64], words[i : i + 64], grams[i : i + 64], stats[i : i + 64], strict=True)]
            yield pa.RecordBatch.from_pylist(some, schema=schema)

    bounded_batches(blocks.sparkSession, 1000)
    return stored(blocks.repartition(buckets, "bucket").mapInArrow(run, _ANSWER), "lm-answers", compression="zstd")


def lm_scores(docs: DataFrame, held_out_mod: tuple[int, int] = (5, 1), tokens_per_bucket: int = 700_000, slice_bytes: int = 6 << 20, window: int = 5 << 18, turns: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text). Every
    bucket is asked in one of `turns` turns."""
    spark = docs.sparkSession
    mod, rest = held_out_mod
    out_of = F.coalesce(crc_mod(F.col("doc_id"), mod) == rest, F.lit(False))
    parts = slices(docs, out_of, slice_bytes)
    size = parts.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(32, size // tokens_per_bucket)
    every = [answered(asked(parts, buckets, window, turns, k), -(-buckets // turns)) for k in range(turns)]
    answers = functools.reduce(DataFrame.unionByName, every)
    n, v = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("different")).first())
    scale = n + 0.5 * (v + 1)
    out = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}

        def close() -> None:
            """Score the window whose answers are complete."""
            if now.get("words"):
                at = now["window"] * window
                w = Window(now["hashes"], now["numbers"], now["text"], at, min(at + window, len(now["numbers"])))
                known, base, score = w.scores(np.concatenate(now["words"]), np.concatenate(now["grams"]), scale)
                for name, x in (("known", known), ("base", base), ("score", score)):
                    now[name] += np.bincount(now["text"][w.start : w.stop], x, len(now["ids"]))
            now.update(words=[], grams=[])

        def done() -> pa.RecordBatch:
            lengths = now["lengths"]
            return pa.RecordBatch.from_arrays([pa.array(now["ids"], schema.field(0).type), pa.array(now["held"], pa.bool_()), pa.array(lengths), pa.array(now["known"].astype(np.int64)), pa.array(np.full(len(lengths), n, dtype=np.int64)), pa.array(now["base"]), pa.array(now["score"])], schema=schema)

        for b in batches:
            for r in b.to_pylist():
                if r["window"] < 0:
                    if now:
                        close()
                        yield done()
                    lengths = np.array(r["own"], dtype=np.int64)
                    hashes, numbers, text = _opened(r["word_counts"], r["gram_counts"], lengths)
                    now = {"ids": r["ids"], "held": r["held"], "lengths": lengths, "hashes": hashes, "numbers": numbers, "text": text, "window": 0, "words": [], "grams": []} | {k: np.zeros(len(lengths)) for k in ("known", "base", "score")}
                    continue
                if r["window"] != now["window"]:
                    close()
                    now["window"] = r["window"]
                now["words"].append(unpacked(r["word_counts"], r["n_words"]).astype(np.float64))
                now["grams"].append(unpacked(r["gram_counts"], r["n_grams"]).astype(np.float64))
        if now:
            close()
            yield done()

    # A slice's own row comes first, then its windows in order, each with its buckets in the order of keys.
    none = F.lit(0).cast("int")
    first = parts.select("slice", F.lit(-1).alias("window"), none.alias("bucket"), none.alias("n_words"), F.col("words").alias("word_counts"), none.alias("n_grams"), F.col("numbers").alias("gram_counts"), "ids", "held", F.col("lengths").alias("own"))
    both = first.unionByName(answers.drop("tokens", "different"), allowMissingColumns=True)
    bounded_batches(spark, 256)
    scored = stored(both.repartition("slice").sortWithinPartitions("slice", "window", "bucket").mapInArrow(run, out), "lm-scores")
    dropped(spark, parts, *every)
    return scored
