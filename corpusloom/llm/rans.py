"""Token ids as binary files: static range asymmetric numeral systems over interleaved lanes.

Documents are dealt into ranges of doc_id. A range is cut into segments; a segment has one frequency table, shared by
its blocks, and each block is a run of whole documents, coded on its own by `LANES` interleaved 32-bit states that
renormalise by 16-bit words. A block carries a CRC-32 of its ids and, every `EVERY` steps, a checkpoint (all lane
states and the word offset), so that workers decode blocks, or parts of one, without reading what lies before.

Files are Parquet tables of such blocks in the shared folder, in ascending order of doc_id, so any store that Spark
reaches can hold them. Null texts are empty and consist of the end id alone. Rows of one doc_id are written in any
order beside each other; a null doc_id comes first.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import arrow_slices, bounded_batches, stored, whole
from corpusloom.llm.idtable import IdTable

BITS = 16
LANES = 4096
EVERY = 32
BLOCK_IDS = 1 << 19
SEGMENT_IDS = 1 << 22


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^BITS, at least 1 for every id that occurs."""
    total, used = 1 << BITS, np.flatnonzero(counts)
    freq = np.zeros(len(counts), dtype=np.int64)
    if not len(used):
        return freq
    if len(used) > total:
        raise ValueError(f"{len(used)} different ids do not fit a table of {total}")
    freq[used] = np.maximum(1, counts[used] * total // counts.sum())
    # The remainder goes to, or comes from, the most frequent ids.
    order = used[np.argsort(-counts[used], kind="stable")]
    spare = int(total - freq.sum())
    while spare:
        if spare > 0:
            freq[order[0]] += spare
            break
        take = np.minimum(freq[order] - 1, np.maximum(1, (freq[order] - 1) // 2))
        take = np.where(np.cumsum(take) <= -spare, take, np.maximum(0, -spare - (np.cumsum(take) - take)))
        freq[order] -= take
        spare += int(take.sum())
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes]:
    """(words, checkpoints) of one block; step t codes ids[t * LANES : (t + 1) * LANES]."""
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, 1 << BITS, dtype=np.uint64)
    chunks, offsets, marks = [], [], []
    f_all, s_all = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    for t in range(steps - 1, -1, -1):
        f, s = f_all[t * LANES : (t + 1) * LANES], s_all[t * LANES : (t + 1) * LANES]
        x = state[: len(f)]
        full = x >= (f << np.uint64(16))
        chunks.append((x[full] & np.uint64(0xFFFF)).astype("<u2"))
        x = np.where(full, x >> np.uint64(16), x)
        state[: len(f)] = ((x // f) << np.uint64(BITS)) + x % f + s
        if t % EVERY == 0:
            marks.append(state.astype("<u4"))
            offsets.append(t)
    chunks.reverse()
    ends = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype("<u4")
    table = b"".join(ends[t].tobytes() + m.tobytes() for t, m in zip(reversed(offsets), reversed(marks), strict=True))
    return (np.concatenate(chunks).tobytes() if chunks else b""), table


def decode_block(words: bytes, checkpoints: bytes, n: int, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of one block, or of its checkpoint intervals first to last (exclusive)."""
    stream = np.frombuffer(words, dtype="<u2").astype(np.uint64)
    size = 4 * (LANES + 1)
    steps, out = -(-n // LANES), []
    stop = steps if last is None else min(steps, last * EVERY)
    if first * EVERY >= steps:
        return np.zeros(0, dtype=np.uint32)
    head = np.frombuffer(checkpoints[first * size : (first + 1) * size], dtype="<u4")
    at, state = int(head[0]), head[1:].astype(np.uint64)
    freq, start = freq.astype(np.uint64), start.astype(np.uint64)
    for t in range(first * EVERY, stop):
        x = state[: min(LANES, n - t * LANES)]
        slot = x & np.uint64(0xFFFF)
        sym = slots[slot.astype(np.int64)]
        out.append(sym)
        x = freq[sym] * (x >> np.uint64(BITS)) + slot - start[sym]
        low = np.flatnonzero(x < (1 << 16))
        x[low] = (x[low] << np.uint64(16)) | stream[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    return np.concatenate(out).astype(np.uint32)


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each id, id of each slot)."""
    return np.concatenate([[0], np.cumsum(freq)[:-1]]), np.repeat(np.arange(len(freq)), freq)


PUNCTUATION = ".,;:!?"


class Encoder:
    """A tokenizer of the library with a bounded memory of what it has encoded.

    A place before a blank that is followed by another character than white space always separates pre-tokens of
    byte-level BPE, so texts are cut there and each different piece is encoded once. The memory is one array of ids and
    a table of where each piece's ids lie in it; beyond `most` pieces it starts anew. Pieces that are one run of
    letters, with or without a final mark, are whole pre-tokens: these go to the library's model in one call for many,
    all others through the whole tokenizer."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # The same model behind a splitter at blanks, without its own memory.
        self.words = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special, (self.mark, self.mark_id) = list(added), next(iter(added.items()))
        # Byte-level BPE writes each byte as a letter: printable ones as they are, the others from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.blank = letters[32]
        # Units of a line are parted by \0, which no run of letters holds.
        self.mapped = letters | {0: " "}
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(self.blank)]] = True
        self.alone = vocab[self.blank]
        self.forget()

    def forget(self) -> None:
        """Start the memory anew. rows gives each piece's row in the table; -1 stands for no piece."""
        self.rows: dict[str, int] = {"": -1}
        self.table = IdTable()

    @staticmethod
    def cut(text: str) -> list[str]:
        """The keys (see _key) of the pieces of any text, in order."""
        if not text:
            return []
        first, *rest = text.split(" ")
        out = [first]
        for x in rest:
            if not x or x[0].isspace():
                out[-1] += " " + x
            else:
                out.append(" " + x)
        return [_key(x) for x in out if x]

    @staticmethod
    def subpieces(piece: str) -> list[str]:
        """A new piece, cut where pre-tokens always part: around a single line end, and before final punctuation."""
        lines = piece.split("\n")
        if len(lines) > 1 and (not all(lines) or any(x[0].isspace() for x in lines[1:]) or any(x[-1].isspace() for x in lines[:-1])):
            return [piece]
        out = []
        for k, x in enumerate(lines):
            if k:
                out.append("\n")
            if len(x) > 2 and x[-1] in PUNCTUATION and x[1:-1].isalpha():
                out += [x[:-1], x[-1]]
            else:
                out.append(x)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        ids, sizes = self.column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a column one after the other, number of ids of each)."""
        if self.table.rows > self.most:
            self.forget()
        texts = texts.fill_null("")
        if not len(texts):
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        # A line end after a character that is no white space parts pre-tokens as well.
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        coded = lists.flatten().dictionary_encode()
        words, get = [w if w[:1] != "\n" else " " + w if len(w) > 1 else "" for w in coded.dictionary.to_pylist()], self.rows.get
        firsts = [" " + x for x in pc.list_element(lists, 0).to_pylist()]
        odd = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        # Texts with other white space than single blanks and line ends between words are odd, too: see cut().
        new = {w for w, r in zip(words, map(get, words), strict=True) if r is None and not (w[0].isspace() and (w[0] != " " or len(w) < 3 or w[2].isspace()))}
        new.update(x for x in firsts if len(x) > 1 and x not in self.rows and not x[1].isspace())
        if odd.any():
            new = {w for w in new if not any(s in w for s in self.special)}
        self.learn([w for w in new if not w[-1].isspace()])
        rows = np.fromiter(map(get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))[coded.indices.to_numpy()]
        rows[bounds[:-1]] = [get(x, -1) for x in firsts]
        odd |= np.logical_or.reduceat(rows < 0, bounds[:-1])
        if odd.any():
            rows, bounds = self._mixed(texts, rows, bounds, odd)
        return self.table.joined(rows, np.diff(bounds))

    def _mixed(self, texts: pa.Array, rows: np.ndarray, bounds: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and bounds with those of odd texts put right."""
        parts = []
        for i, strange in enumerate(odd.tolist()):
            if not strange:
                parts.append(rows[bounds[i] : bounds[i + 1]])
                continue
            text = texts[i].as_py()
            if any(s in text for s in self.special):
                # The ids of a whole text; nothing else asks for this row.
                ids = self.tok.encode(text, add_special_tokens=False).ids
                parts.append(np.array(self.table.append(np.array(ids, dtype=np.uint32), np.array([len(ids)]))))
                continue
            keys = self.cut(text)
            self.learn(list({k for k in keys if k not in self.rows}))
            parts.append(np.array([self.rows[k] for k in keys], dtype=np.int64))
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def _remember(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.rows.update(zip(keys, self.table.append(ids, sizes), strict=True))

    def _letters(self, keys: list[str], lines: list[str], bare: bool) -> None:
        """Learn pieces of letters from their units. Ids that open with a blank mark where the next one begins; where
        pieces have none (bare), a blank alone stands behind each."""
        for i in range(0, len(keys), 500):
            line = "".join(lines[i : i + 500])
            line = line.replace(" ", self.blank).replace("\0", " ") if line.isascii() else line.encode().decode("latin-1").translate(self.mapped)
            ids = np.array(self.words.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=np.uint32)
            if bare:
                ends = np.flatnonzero(ids == self.alone)
                ids, sizes = np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
            else:
                sizes = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
            self._remember(keys[i : i + 500], ids, sizes)

    def learn(self, keys: list[str]) -> None:
        """Remember the ids of new, different pieces."""
        opening, bare, cuts, whole = [[], []], [], [], []
        for key in keys:
            if key.isalpha() or key[-1] in PUNCTUATION and key[:-1].isalpha():
                opening[key.isascii()].append(key)
            elif key[0] == " " and key[1:].isalpha():
                bare.append(key)
            elif key[:2] == " \n" and len(key) > 2 and not key[2].isspace():
                cuts.append((key, [" \n", " " + key[2:]]))
            else:
                piece = _piece(key)
                sub = self.subpieces(piece)
                if len(sub) > 1:
                    cuts.append((key, [_key(x) for x in sub]))
                else:
                    whole.append(piece)
        for some in opening:
            self._letters(some, [f"\0 {k}" if k.isalpha() else f"\0 {k[:-1]}\0{k[-1]}" for k in some], False)
        self._letters(bare, [f"\0{k[1:]}\0 " for k in bare], True)
        for i in range(0, len(whole), 2000):
            # A special token between the pieces keeps them apart, and marks where each one's ids end.
            part = whole[i : i + 2000]
            ids = np.array(self.tok.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(ids == self.mark_id)
            self._remember([_key(q) for q in part], np.delete(ids, ends), np.diff(np.append(ends, len(ids)), prepend=-1) - 1)
        if cuts:
            self.learn(list({k for _, sub in cuts for k in sub if k not in self.rows}))
            rows = np.array([self.rows[k] for _, sub in cuts for k in sub], dtype=np.int64)
            self._remember([k for k, _ in cuts], *self.table.joined(rows, np.array([len(sub) for _, sub in cuts])))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, which keeps its memory from task to task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _key(piece: str) -> str:
    """A piece's name in the memory: without its blank if it has exactly one, which most have, else behind a blank."""
    return piece[1:] if len(piece) > 1 and piece[0] == " " and piece[1] != " " else " " + piece


def _piece(key: str) -> str:
    return key[1:] if key[0] == " " else " " + key


BLOCK = T.StructType().add("part", "integer").add("seg", "integer").add("block", "integer").add("n_ids", "long").add("doc_ids", T.ArrayType(T.LongType())).add("lengths", T.ArrayType(T.IntegerType())).add("words", "binary").add("checkpoints", "binary").add("crc", "long").add("table", "binary")


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, range_bytes: int = 48 << 20) -> DataFrame:
    """The stored files: one row for each block, in ascending order of doc_id within and across parts.

    The first block of a segment holds the table that the segment's blocks share (compressed), others a null."""
    spark = docs.sparkSession
    bounded_batches(spark, 4500)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.select("doc_id", whole(F.col("text")).alias("text")).repartitionByRange(max(1, -(-size // range_bytes)), "doc_id").sortWithinPartitions("doc_id")
    schema = to_arrow_schema(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seg = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seg, total
            names = [d for part in held for d in part[0]]
            ids, sizes = (np.concatenate([part[k] for part in held]) for k in (1, 2))
            held.clear()
            freq = quantised(np.bincount(ids))
            start, _ = tables(freq)
            packed, block, i = zlib.compress(freq.astype("<u4").tobytes(), 1), 0, 0
            ends = np.append(0, np.cumsum(sizes))
            while i < len(names):
                # A block holds as many whole documents as fit, and one at least.
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_IDS, "right")) - 1)
                some = ids[ends[i] : ends[j]]
                words, marks = encode_block(some, freq, start)
                yield pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "block": block, "n_ids": len(some), "doc_ids": names[i:j], "lengths": sizes[i:j], "words": words, "checkpoints": marks, "crc": zlib.crc32(some.astype("<u4").tobytes()), "table": packed if block == 0 else None}], schema=schema)
                i, block = j, block + 1
            seg, total = seg + 1, 0

        for b in batches:
            for i, j in arrow_slices(b.column(1), 12 << 20):
                ids, sizes = enc.column(b.column(1)[i:j])
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                held.append((b.column(0)[i:j].to_pylist(), ids.astype(np.uint32), sizes + 1))
                total += len(ids)
                if total >= SEGMENT_IDS:
                    yield from flush()
        if held:
            yield from flush()

    return stored(dealt.mapInArrow(run, BLOCK), "rans")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files, checksums verified."""
    spark = files.sparkSession
    bounded_batches(spark, 16)
    heads = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each file: its number of ids.
    before = heads.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("seg", "block")
    places = files.select("part", "seg", "block", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("offset")).join(before, "part").select("part", "seg", "block", (F.col("offset") + F.col("part_start")).alias("at"))
    shared = files.where("block = 0").select("part", "seg", F.col("table").alias("shared"))
    blocks = files.drop("table").join(shared, ["part", "seg"]).join(places, ["part", "seg", "block"]).drop("part", "seg", "block")
    out = T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None,)
        for b in batches:
            for r in b.to_pylist():
                if r["shared"] != last[0]:
                    freq = np.frombuffer(zlib.decompress(r["shared"]), dtype="<u4").astype(np.int64)
                    last = (r["shared"], freq, *tables(freq))
                ids = decode_block(r["words"], r["checkpoints"], r["n_ids"], *last[1:]).astype("<u4")
                if zlib.crc32(raw := ids.tobytes()) != r["crc"]:
                    raise ValueError("a block's checksum differs")
                ends = np.cumsum([0, *r["lengths"]])
                crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(ends[:-1] + r["at"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    return blocks.mapInArrow(run, out)
