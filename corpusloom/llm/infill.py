"""Fill-in-the-middle transformation on ropes.

A text is cut into units (blanks and the word behind them; blanks at the end are one unit). Its rope is a balanced tree
whose leaves hold a stretch of the text and cache its numbers of units and of code points, and whose inner nodes cache the
sums. Two splits at unit ranks give prefix, middle and suffix; joining the subtrees with sentinel leaves gives the output.
The inverse builds the rope of the output, splits it at the code-point ranks of the sentinels and joins the parts in their
old order. Subtrees are shared, never copied, so a split or a join touches one path.

Where to cut, and in what form, follows from a SHA-256 of seed and doc_id, so a lost task gives the same rows again.
Every row is worked on by itself: nothing is shuffled. A null text is an empty one; empty texts and texts that hold a
sentinel stay as they are (plain). A null doc_id hashes as no digits. Rows with equal ids are cut at the same draws;
repeated rows are returned as often as they occur, and other columns of the table are not carried over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.common import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that are looked at together, and units of a leaf.
SLAB, LEAF = 1 << 20, 512


class Leaf:
    """A stretch of text; ends has the code-point rank behind each of its units (a unit that a cut went through counts
    in both stretches)."""

    __slots__ = ("chars", "ends", "text", "units")
    height = 0

    def __init__(self, text: str, ends: np.ndarray):
        self.text, self.ends, self.units, self.chars = text, ends, len(ends), len(text)

    def cut(self, at: int) -> tuple[Leaf | None, Leaf | None]:
        """Before and behind a code-point rank."""
        if at <= 0 or at >= self.chars:
            return (None, self) if at <= 0 else (self, None)
        k = int(np.searchsorted(self.ends, at))
        return Leaf(self.text[:at], np.append(self.ends[:k], at)), Leaf(self.text[at:], self.ends[np.searchsorted(self.ends, at, "right") :] - at)


class Node:
    __slots__ = ("chars", "height", "left", "right", "units")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.units, self.chars = left.units + right.units, left.chars + right.chars
        self.height = max(left.height, right.height) + 1


Rope = Leaf | Node | None


def join(a: Rope, b: Rope) -> Rope:
    """a and then b; heights of siblings differ by one at most."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        low = join(a.right, b)
        if low.height <= a.left.height + 1:
            return Node(a.left, low)
        if low.left.height <= low.right.height:
            return Node(Node(a.left, low.left), low.right)
        return Node(Node(a.left, low.left.left), Node(low.left.right, low.right))
    if b.height > a.height + 1:
        low = join(a, b.left)
        if low.height <= b.right.height + 1:
            return Node(low, b.right)
        if low.right.height <= low.left.height:
            return Node(low.left, Node(low.right, b.right))
        return Node(Node(low.left, low.right.left), Node(low.right.right, b.right))
    return Node(a, b)


def split(rope: Rope, rank: int, by: str) -> tuple[Rope, Rope]:
    """The first `rank` units or code points (by: "units" or "chars"), and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if isinstance(rope, Leaf):
        return rope.cut(rank if by == "chars" else int(rope.ends[rank - 1]))
    here = getattr(rope.left, by)
    if rank <= here:
        left, right = split(rope.left, rank, by)
        return left, join(right, rope.right)
    left, right = split(rope.right, rank - here, by)
    return join(rope.left, left), right


def unit_ends(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(from, code-point ranks behind the units that end there) of slabs of a text."""
    for start in range(0, len(text), SLAB):
        # One more on the right shows whether a word ends with the slab.
        c = np.frombuffer(text[start : start + SLAB + 1].encode("utf-32-le"), dtype=np.uint32)
        word = ~((c == 32) | ((c >= 9) & (c <= 13)))
        last = start + SLAB >= len(text)
        ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        if last:  # what stands at the end of the text ends a unit, word or blanks
            ends = np.append(ends, len(c))
        yield start, ends


def rope_of(text: str) -> Rope:
    leaves: list[Rope] = []
    done = 0
    # A leaf ends where a unit ends, also one that reaches over slabs.
    for start, ends in unit_ends(text):
        for k in range(0, len(ends), LEAF):
            part = ends[k : k + LEAF] + start
            leaves.append(Leaf(text[done : part[-1]], part - done))
            done = int(part[-1])
    while len(leaves) > 1:
        leaves = [Node(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        if len(leaves) > 1 and leaves[-1].height < leaves[-2].height - 1:
            leaves[-2:] = [join(leaves[-2], leaves[-1])]
    return leaves[0] if leaves else None


def text_of(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, Leaf):
            out.append(x.text)
        elif x is not None:
            todo += (x.right, x.left)
    return "".join(out)


def _sentinel(text: str) -> Leaf:
    return Leaf(text, np.array([len(text)]))


def draws(doc_id, seed: int = 42) -> tuple[int, ...]:
    """The four numbers that decide about a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def transform(text: str, h: tuple[int, ...], rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of a whole text. `rate` of 100 texts are rearranged, and
    of these `spm` of 100 have the suffix first."""
    rope = rope_of(text)
    n = 0 if rope is None else rope.units
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, rest = split(rope, first, "units")
    middle, suffix = split(rest, second - first, "units")
    suffix_first = h[3] % 100 < spm
    head = (_sentinel(SUFFIX), suffix, _sentinel(PREFIX), prefix) if suffix_first else (_sentinel(PREFIX), prefix, _sentinel(SUFFIX), suffix)
    out = None
    for part in (*head, _sentinel(MIDDLE), middle):
        out = join(out, part)
    return n, "spm" if suffix_first else "psm", prefix.chars if prefix else 0, middle.chars if middle else 0, text_of(out)


def restore(output: str, form: str) -> str:
    """The text that transform made output of. Parts hold no sentinel, nor can their ends make one with it, so the first
    that is found is the one put there."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    cut, last = output.index(two), output.index(MIDDLE)
    _, rope = split(rope_of(output), len(one), "chars")
    a, rope = split(rope, cut - len(one), "chars")
    _, rope = split(rope, len(two), "chars")
    b, rope = split(rope, last - cut - len(two), "chars")
    _, middle = split(rope, len(MIDDLE), "chars")
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return text_of(join(join(prefix, middle), suffix))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [transform(t.as_py() or "", draws(i.as_py(), seed), rate, spm) for i, t in zip(b.column(0), b.column(1), strict=True)]
            n, form, prefix, middle, out = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    return docs.select("doc_id", "text").mapInArrow(run, kind.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string"))


def fill_back(made: DataFrame) -> DataFrame:
    """made (with form and output) and the text that each row was made of, rebuilt from these two, as column restored
    (which replaces one of that name). A null output stays null."""
    bounded_batches(made.sparkSession)
    made = made.drop("restored")
    names = made.columns
    form, output = names.index("form"), names.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = [None if o.as_py() is None else restore(o.as_py(), f.as_py()) for f, o in zip(b.column(form), b.column(output), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], names=[*names, "restored"])

    return made.mapInArrow(run, T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())]))
