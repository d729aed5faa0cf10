"""SentencePiece encoding and decoding by suffix-array matching.

The distinct runs of known characters of a batch are concatenated and indexed by a suffix array; every piece of the
vocabulary is binary-searched for its range of occurrences; the occurrences become edges, sorted by the position where
they end, and are relaxed from left to right. The model's pieces are merges (BPE), so an edge is accepted if the
tokens before and after its start could not merge otherwise; exactly one edge into each position passes, and the path
is the library's own encoding. No piece holds a blank mark after another character, so a text is cut before blank
marks and every different part is encoded once; parts are remembered up to a bound. Characters that no piece has fall
back to bytes.

Null texts are empty and have no ids. Whole texts are encoded, of any length; repeated rows one by one.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import arrow_slices, bounded_batches
from corpusloom.llm.idtable import IdTable

BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, BYTE = 1, 6
LONGEST = 16
CHAR_BITS = 15
#: Characters of new units that are matched at once.
MATCHED = 300_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            x = raw[at]
            at += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while at < len(raw):
        key = number()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if size is None else size
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    """A merge model: `order` numbers characters first and then merges by priority."""

    texts: list[str]
    ids: np.ndarray
    chars: dict[str, int]
    left: list[int]
    right: list[int]
    pair: dict[tuple[int, int], int]
    out: list[bytes]
    byte_ids: list[int]
    unk: int
    searched: list[int]

    @staticmethod
    def load(path: str) -> Model:
        """Read a BPE model file with identity normalisation, a dummy prefix and kept blanks."""
        with open(path, "rb") as f:
            raw = f.read()
        pieces = []
        for k, v in _fields(raw):
            if k == 1:
                d = dict(_fields(v))
                pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == NORMAL]
        single = [(i, p, s) for i, p, s in normal if len(p) == 1]
        # Runs of blanks are merged last, by a rule of their own (see run_ids), and take no part in the relaxation.
        multi = sorted((x for x in normal if len(x[1]) > 1 and set(x[1]) != {BLANK}), key=lambda x: (-x[2], x[0]))
        rows = [*single, *multi]
        at = {p: k for k, (_, p, _) in enumerate(rows)}
        pair = {(a, b): k for k, (_, p, _) in enumerate(rows) for i in range(1, len(p)) if (a := at.get(p[:i])) is not None and (b := at.get(p[i:])) is not None}
        left, right, searched = list(range(len(rows))), list(range(len(rows))), []
        for k in range(len(single), len(rows)):
            parts = [at[c] for c in rows[k][1] if c in at]
            if len(parts) < len(rows[k][1]):
                continue
            while len(parts) > 2:
                best = min(((m, i) for i in range(len(parts) - 1) if (m := pair.get((parts[i], parts[i + 1]))) is not None and m < k), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            if len(parts) == 2 and pair.get(tuple(parts)) == k:
                left[k], right[k] = parts
                searched.append(k)
        by_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        out = [b"" if kind not in (NORMAL, BYTE) else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(BLANK, " ").encode() for p, _, kind in pieces]
        if len(single) + 2 > 1 << CHAR_BITS or max((len(p) for _, p, _ in multi), default=0) > LONGEST:
            raise ValueError("the vocabulary has too many characters or too long pieces")
        model = Model([p for _, p, _ in rows], np.array([i for i, _, _ in rows], dtype=np.int64), {p: k for k, (_, p, _) in enumerate(single)}, left, right, pair, out, [by_byte.get(b, 0) for b in range(256)], 0, searched)
        model.blank_runs = {len(p): i for i, p, _ in normal if set(p) == {BLANK}}
        return model

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when merging the text of both, by undoing their last merges."""
        limit = len(self.texts) + 1
        left, right, pair = self.left, self.right, self.pair
        while True:
            m = pair.get((a, b))
            if m is not None and m < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True


class Matcher:
    """Encodes columns of texts; remembers the ids of at most `most` different parts, and then starts anew."""

    def __init__(self, model: Model, most: int = 250_000):
        self.m, self.most, self.runs = model, most, {}
        self.table = np.zeros(max(map(ord, model.chars)) + 2, dtype=np.int64)
        for c, k in model.chars.items():
            self.table[ord(c)] = k + 1
        # Which characters stand beside each other in some piece; a text can be cut anywhere else.
        self.beside = np.zeros((len(model.chars) + 1,) * 2, dtype=bool)
        for k in model.searched:
            c = [model.chars[x] + 1 for x in model.texts[k]]
            self.beside[c[:-1], c[1:]] = True
        self.part = re.compile(f"{BLANK}*[^{BLANK}]*")
        # Pieces as four keys of four characters each; absent characters are 0, or the largest code for the upper end.
        codes = np.zeros((len(model.searched), LONGEST), dtype=np.int64)
        self.lengths = np.array([len(model.texts[k]) for k in model.searched], dtype=np.int32)
        for row, k in enumerate(model.searched):
            codes[row, : self.lengths[row]] = [model.chars[c] + 1 for c in model.texts[k]]
        top = np.where(np.arange(LONGEST) < self.lengths[:, None], codes, (1 << CHAR_BITS) - 1)
        self.low, self.high = self._keys(codes), self._keys(top)
        self.searched = np.array(model.searched, dtype=np.int32)
        self.sizes = np.array([len(t) for t in model.texts])
        # What each id decodes to, in one array.
        self.out_sizes = np.array([len(x) for x in model.out], dtype=np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self.out_bytes = np.frombuffer(b"".join(model.out), dtype=np.uint8)
        # Verdicts on pairs of tokens: a table by hash, in which a pair may take another's place.
        self.pairs, self.verdicts = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)
        self.forget()

    def forget(self) -> None:
        """Start the memory of parts and of units anew. Row 0 has no ids; -1 stands for no part."""
        self.ids = IdTable()
        self.ids.append(np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))
        self.seen, self.units = {"": -1}, {}

    @staticmethod
    def _keys(codes: np.ndarray) -> np.ndarray:
        shaped = codes.reshape(len(codes), 4, 4)
        return (shaped << (CHAR_BITS * np.array([3, 2, 1, 0]))).sum(axis=2)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        ids, sizes = self.column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a column one after the other, number of ids of each)."""
        if self.ids.rows > self.most:
            self.forget()
        texts = texts.fill_null("")
        if not len(texts):
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        # Parts are known by what follows their blank mark; one that has no mark follows a line end, which no piece has.
        lines = not self.table[10]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n") if lines else texts, " ")
        bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        coded = lists.flatten().dictionary_encode()
        words, get = coded.dictionary.to_pylist(), self.seen.get
        # Texts with neighbouring blanks, with blank marks of their own or with a line end in front are odd.
        odd = pc.or_(pc.match_substring(texts, BLANK), pc.or_(pc.starts_with(texts, "\n"), pc.equal(texts, ""))).to_numpy(zero_copy_only=False)
        strange = bool(odd.any())
        self._learn([w for w, r in zip(words, map(get, words), strict=True) if r is None and not (strange and BLANK in w)], lines)
        rows = np.fromiter(map(get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))[coded.indices.to_numpy()]
        odd = odd | np.logical_or.reduceat(rows < 0, bounds[:-1])
        if odd.any():
            rows, bounds = self._mixed(texts, rows, bounds, odd)
        return self.ids.joined(rows, np.diff(bounds))

    def _mixed(self, texts: pa.Array, rows: np.ndarray, bounds: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and bounds with those of odd texts put right: cut before every run of blanks."""
        parts = []
        for i, strange in enumerate(odd.tolist()):
            if not strange:
                parts.append(rows[bounds[i] : bounds[i + 1]])
                continue
            text = texts[i].as_py()
            found = [x for x in self.part.findall(BLANK + text.replace(" ", BLANK)) if x] if text else []
            new = {p for p in found if (BLANK, p) not in self.seen}
            if new:
                self._blanks(list(new))
            parts.append(np.array([self.seen[BLANK, p] for p in found], dtype=np.int64))
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def _learn(self, words: list[str], lines: bool) -> None:
        """Remember the ids of new words: each behind a blank mark, but those that begin with a line end."""
        if words:
            self.seen.update(zip(words, self._rows([w if lines and w[0] == "\n" else BLANK + w for w in words]), strict=True))

    def _blanks(self, parts: list[str]) -> None:
        """Remember parts that may begin with several blank marks: extra ones are left out and encoded by themselves."""
        runs = [len(p) - len(p.lstrip(BLANK)) for p in parts]
        rows = self._rows([p[n - 1 :] if n > 1 else p for p, n in zip(parts, runs, strict=True)])
        for p, n, row in zip(parts, runs, rows, strict=True):
            if n > 1:
                ids, _ = self.ids.gather(np.array([row]))
                alone = int(ids[0] == self.m.blank_runs[1])
                ids = np.append(self.run_ids(n if alone else n - 1), ids[alone:]).astype(np.uint32)
                row = self.ids.append(ids, np.array([len(ids)]))[0]
            self.seen[BLANK, p] = row

    def _rows(self, bodies: list[str]) -> range:
        """Rows of new parts: each is cut into units where no piece can reach across, and new units are matched."""
        text = "\0".join(bodies) + "\0"
        codes = self._codes(text)
        ends = np.append(np.flatnonzero(~self.beside[codes[:-1], codes[1:]]) + 1, len(text))
        starts = np.append(0, ends[:-1])
        names = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        units, get = self.units, self.units.get
        new = dict.fromkeys(u for u, r in zip(names, map(get, names), strict=True) if r is None)
        known = [u for u in new if u[0] in self.m.chars]
        # Edges are several times as many as characters, so what is matched at once is bounded.
        lots = np.cumsum([len(u) + 1 for u in known]) // MATCHED
        for _, some in itertools.groupby(zip(lots.tolist(), known, strict=True), key=lambda x: x[0]):
            part = [u for _, u in some]
            units.update(zip(part, self.ids.append(*self._match(part)), strict=True))
        if other := [u for u in new if u not in units]:
            raw = [u.encode("utf-8", "surrogatepass") for u in other]
            ids = np.array(self.m.byte_ids, dtype=np.uint32)[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            units.update(zip(other, self.ids.append(ids, np.array([len(x) for x in raw])), strict=True))
        rows = np.fromiter(map(get, names), dtype=np.int64, count=len(names))
        # A part ends by its length, as its own text may hold the separator; separators have no ids.
        seps = np.cumsum([len(x) + 1 for x in bodies]) - 1
        last = np.searchsorted(starts, seps)
        rows[last] = 0
        return self.ids.append(*self.ids.joined(rows, np.diff(last, prepend=-1)))

    def _codes(self, text: str) -> np.ndarray:
        """1 and more for the characters of pieces, 0 for others."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return self.table[np.minimum(points, len(self.table) - 1)]

    def run_ids(self, n: int) -> list[int]:
        """Ids of n blanks: all merges of blanks are of equal priority, so the leftmost possible goes first."""
        if n not in self.runs:
            have = self.m.blank_runs
            size, after, before = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
            heap = [(i, 2, 1) for i in range(n - 1)] if 2 in have else []
            while heap:
                i, total, own = heapq.heappop(heap)
                j = after[i]
                if size[i] != own or j < 0 or size[j] == 0 or size[i] + size[j] != total:
                    continue
                size[i], size[j] = total, 0
                after[i] = after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                for a, b in ((before[i], i), (i, after[i])):
                    if a >= 0 and b >= 0 and size[a] + size[b] in have:
                        heapq.heappush(heap, (a, size[a] + size[b], size[a]))
            got = [have[s] for s in size if s]
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[n] = got
        return self.runs[n]

    def _match(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of units: suffix array, occurrence ranges, sorted edges, relaxation."""
        m = self.m
        # A separator of code 0 stands before each unit and LONGEST of them at the end.
        codes = self._codes("\0".join(["", *names]))
        n = len(codes)
        codes = np.concatenate([codes, np.zeros(2 * LONGEST, dtype=np.int64)])
        first = sum(codes[i : i + n + LONGEST] << (CHAR_BITS * (3 - i)) for i in range(4))
        quads = [first[4 * i : 4 * i + n] for i in range(4)]
        key, width = first[:n], 4
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            if width >= LONGEST:
                break
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            key = rank * (n + 1) + np.concatenate([rank[width:] + 1, np.zeros(min(width, n), dtype=np.int64)])[:n]
            width *= 2
        sorted_quads = [q[order] for q in quads]
        lo, hi = self._bound(sorted_quads, self.low, False), self._bound(sorted_quads, self.high, True)
        count = np.maximum(hi - lo, 0)
        hit = np.flatnonzero(count)
        which = np.repeat(hit.astype(np.int32), count[hit])
        # Where each occurrence stands in the suffix array.
        inside = np.arange(len(which), dtype=np.int32) + np.repeat((lo[hit] - np.cumsum(count[hit]) + count[hit]).astype(np.int32), count[hit])
        starts = order[inside].astype(np.int32)
        alone = np.flatnonzero(codes[:n]).astype(np.int32)
        starts, ends, kinds = np.concatenate([starts, alone]), np.concatenate([starts + self.lengths[which], alone + 1]), np.concatenate([self.searched[which], (codes[alone] - 1).astype(np.int32)])
        sizes = np.array([len(u) for u in names])
        begins = np.cumsum(sizes + 1) - sizes
        last = self._relaxed(starts, ends, kinds, begins, sizes, n)
        # Paths are walked back from the ends of all units at once.
        steps = np.zeros(n + 1, dtype=bool)
        at, stop = begins + sizes, begins
        while len(at):
            steps[at] = True
            at = at - self.sizes[last[at]]
            at, stop = at[at > stop], stop[at > stop]
        taken = np.flatnonzero(steps)
        return m.ids[last[taken]].astype(np.uint32), np.diff(np.searchsorted(taken, np.append(begins, n + 1)))

    def _relaxed(self, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, begins: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
        """The token that ends at each position. Edges are taken by the distance of their end from the beginning of its
        unit, in all units at once, the longest edge into a position first; very long units follow by themselves."""
        last = np.full(n + 1, -1, dtype=np.int64)
        last[begins] = -2
        depth = np.zeros(n + 1, dtype=np.int64)
        unit = np.repeat(np.arange(len(begins)), sizes)
        places = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[unit] + 1
        depth[places] = places - begins[unit]
        long = np.zeros(n + 1, dtype=bool)
        long[places] = (sizes > 200)[unit]
        order = np.lexsort((starts, ends, depth[ends], long[ends]))
        starts, ends, kinds = starts[order], ends[order], kinds[order]
        short = int((~long[ends]).sum())
        # Edges into one position are neighbours; `nth` counts them.
        place = np.arange(len(ends))
        nth = place - np.maximum.accumulate(np.where(np.append(True, ends[1:] != ends[:-1]), place, 0)) if len(ends) else place
        cuts = np.searchsorted(depth[ends[:short]], np.arange(1, 202))
        for a, b in itertools.pairwise(cuts.tolist()):
            if a == b:
                break
            some, rank = np.arange(a, b), nth[a:b]
            for r in range(int(rank.max()) + 1):
                try_ = some[rank == r]
                before = last[starts[try_]]
                try_ = try_[(last[ends[try_]] == -1) & (before != -1)]
                before = last[starts[try_]]
                good = before == -2
                inner = np.flatnonzero(~good)
                good[inner] = self._apart(before[inner], kinds[try_[inner]])
                took = try_[good]
                last[ends[took]] = kinds[took]
        if short < len(ends):
            out, apart = last.tolist(), self.m.apart
            for s, e, k in zip(starts[short:].tolist(), ends[short:].tolist(), kinds[short:].tolist(), strict=True):
                if out[e] == -1 and out[s] != -1 and (out[s] == -2 or apart(out[s], k)):
                    out[e] = k
            last = np.array(out)
        return last

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Model.apart for many pairs: verdicts that the table has, else worked out once for each different pair."""
        key = (a.astype(np.int64) << 20) | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.verdicts[slot]
        missing = np.flatnonzero(self.pairs[slot] != key)
        if len(missing):
            new, which = np.unique(key[missing], return_inverse=True)
            apart = self.m.apart
            found = np.array([apart(k >> 20, k & 0xFFFFF) for k in new.tolist()])
            out[missing] = found[which]
            at = ((new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            # Of several pairs for one slot the last stays, with its own verdict.
            self.pairs[at], self.verdicts[at] = new, found
        return out

    @staticmethod
    def _bound(sorted_quads: list[np.ndarray], keys: np.ndarray, upper: bool) -> np.ndarray:
        """For each row of keys, the first suffix that is not below it (upper: that is above it), by binary search."""
        n = len(sorted_quads[0])
        lo, hi = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), n, dtype=np.int64)
        for _ in range(max(1, n.bit_length())):
            mid = np.minimum((lo + hi) >> 1, n - 1)
            before, equal = np.zeros(len(keys), dtype=bool), np.ones(len(keys), dtype=bool)
            for q in range(4):
                x, y = sorted_quads[q][mid], keys[:, q]
                before |= equal & (x < y)
                equal &= x == y
            before |= equal & upper
            live = lo < hi
            lo, hi = np.where(live & before, mid + 1, lo), np.where(live & ~before, mid, hi)
        return lo

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding puts in front goes, invalid bytes become U+FFFD."""
        return self.decoded(ids, np.array([len(ids)]))[0].as_py()

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of runs of ids; counts has the number of ids of each."""
        sizes = self.out_sizes[ids]
        ends = np.cumsum(sizes)
        where = np.repeat((self.out_starts[ids] - ends + sizes).astype(np.int32), sizes)
        where += np.arange(len(where), dtype=np.int32)
        raw = self.out_bytes[where]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        full = np.flatnonzero(np.diff(bounds))
        blank = full[raw[bounds[full]] == 32]
        raw = np.delete(raw, bounds[blank])
        gone = np.zeros(len(counts), dtype=np.int64)
        gone[blank] = 1
        bounds = bounds - np.append(0, np.cumsum(gone))
        whole = raw.tobytes()
        try:
            whole.decode()
            # Each text alone must be valid, too: none may begin inside a character.
            if not ((raw[bounds[:-1][np.diff(bounds) > 0]] & 0xC0) == 0x80).any():
                return pa.StringArray.from_buffers(len(counts), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(whole))
        except UnicodeDecodeError:
            pass
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(bounds.tolist())], pa.string())


RESULT = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string").add("n_ids", "long").add("ids_crc32", "long").add("round_trip", "boolean").add("decoded_chars", "long")


_MATCHERS: dict[str, Matcher] = {}


def _matcher(path: str, shared) -> Matcher:
    """This worker's matcher for a broadcast model, which keeps its memory from task to task."""
    if path not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[path] = Matcher(shared.value)
    return _MATCHERS[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """All columns of docs but text, with ids, decoded (the text of the ids), n_ids, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), round_trip (decoding gives the text back; blank marks in the text itself
    decode to blanks) and decoded_chars. Columns of these names in docs are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model.load(model_path))
    bounded_batches(spark)
    added = RESULT.fieldNames()
    keep = [c for c in docs.columns if c != "text" and c not in added]
    schema = T.StructType([docs.schema[c] for c in keep] + RESULT.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(model_path, shared)
        for b in batches:
            texts = b.column("text").fill_null("")
            for i, j in arrow_slices(texts, 3 << 20):
                ids, counts = matcher.column(texts[i:j])
                back = matcher.decoded(ids, counts)
                bounds = np.append(0, np.cumsum(counts))
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = [b.column(c)[i:j] for c in keep]
                columns += [
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))),
                    back,
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in itertools.pairwise(bounds.tolist())], pa.int64()),
                    pc.equal(back, pc.replace_substring(texts[i:j], BLANK, " ")),
                    pc.utf8_length(back),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return docs.select(*keep, "text").mapInArrow(run, schema)
