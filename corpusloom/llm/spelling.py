"""Spelling variants: words of a corpus that differ by one character, grouped under their most frequent form.

Words are counted in all texts first. Two words that differ by one code point meet in exactly one group: for the shorter
length n of the two, the places where the shorter word can be hit are cut into windows, and words of n or n + 1 code
points that agree before and behind a window are a group. A group begins with half a word as its window; one of more than
`crowded` words is cut again, window by window, until a window is a single place. What shares all but one place is at most
an alphabet of words (squared for the longer ones), so no group grows with the corpus and none is cut off.

Inside a group an errata trie finds the pairs. The words form a trie. At every node inside the window the heaviest child
stays where it is, and only the light ones are merged, smaller into larger: a light subtree is laid over the heavy one
(the character replaced), over the node itself (the light character skipped), and the node's other children are laid over
the heavy subtree (the heavy character skipped); light subtrees are gathered in a trie of their own, where they meet each
other (replaced). Two terminals that coincide are a pair. A word is light at most log2 of the group's size times, and a
heavy subtree is never copied. The place where two words part is their one node, so each pair is found once.

Null and empty texts have no words. Repeated rows count as often as they occur, rows without doc_id hash as no digits.
Other columns of the table are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bounded_batches, dropped, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def observed(run: str, prefix: int, every: int = 97) -> str:
    """A lower-cased run as it is counted: one of `every` loses a code point. prefix is the crc32 of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, least: int = 3, shortest: int = 5, every: int = 97, most: int = 200_000) -> DataFrame:
    """(word, n) of all words of docs (doc_id, text) with at least `shortest` code points and `least` occurrences. A task
    adds up its words before it sends them, at most `most` at a time."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                doc_id, text = i.as_py(), t.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes.lower changes A-Z only.
                for w, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    w = observed(w, prefix, every)
                    if len(w) >= shortest:
                        seen[w] += n
                if len(seen) > most:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _windows(edges: list[tuple[Column, Column]]) -> Column:
    """Of a word, the context (what stands before and behind) of each window [from, to) of places of a word of m."""
    word, m = F.col("word"), F.col("m")
    tail = lambda to: F.greatest(m - to, F.lit(0))
    behind = lambda to: F.when(tail(to) > 0, F.substring(word, F.length(word) - tail(to) + 1, tail(to))).otherwise("")
    return F.array(*[F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"), F.substring(word, F.lit(1), a.cast("int")).alias("before"), behind(b).alias("behind")) for a, b in edges])


GROUP = ["m", "lo", "hi", "before", "behind"]


def groups(words: DataFrame, shortest: int = 5, crowded: int = 20_000) -> DataFrame:
    """(m, lo, hi, before, behind, word, n): each word in its groups, none of which is crowded unless its window is one
    place wide."""
    both = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1))).where(F.col("m") >= shortest)
    m, half = F.col("m"), F.floor(F.col("m") / 2)
    now = both.withColumn("w", F.explode(_windows([(F.lit(0), half), (half, m + 1)]))).select("word", "n", "m", "w.*")
    done = None
    while True:
        now = stored(now, "spelling-groups")
        sizes = now.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        full = stored(sizes.where((F.col("size") > crowded) & (F.col("hi") - F.col("lo") > 1)).select(*GROUP), "spelling-crowded")
        if full.isEmpty():
            return now if done is None else done.unionByName(now)
        rest = now.join(full, GROUP, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        now = now.join(full, GROUP, "left_semi").withColumn("w", F.explode(_windows([(F.col("lo"), mid), (mid, F.col("hi"))]))).select("word", "n", "m", "w.*")


class Trie:
    """A trie of the words of a group. A node is [children by character, number of the word that ends there or None, words
    below]; pairs are collected in `pairs`."""

    def __init__(self, words: list[str], lo: int = 0):
        self.root, self.pairs = [{}, None, 0], []
        for k, w in enumerate(words):
            node = self.root
            for c in w[lo:]:
                node[2] += 1
                node = node[0].setdefault(c, [{}, None, 0])
            node[1], node[2] = k, node[2] + 1

    def find(self, places: int) -> list[tuple[int, int]]:
        """Pairs of words that part at one of the first `places` levels and differ by one character there."""
        level = [self.root]
        for _ in range(places):
            level = [x for node in level for x in self.part(node)]
        return self.pairs

    def part(self, node: list) -> list[list]:
        """All pairs that part at this node; its children."""
        children = node[0]
        if len(children) > 1:
            heavy = max(children, key=lambda c: children[c][2])
            light: list = [{}, [], 0]
            for c, x in children.items():
                if c != heavy:
                    self.meet(x, children[heavy])  # replaced, against the heavy subtree
                    if len(children) > 2:
                        self.merge(x, light)  # replaced, against other light ones
        if len(children) + (node[1] is not None) > 1:
            for c, x in children.items():
                self.meet(x, node, but=c)  # c skipped, against all that does not begin with c
        return list(children.values())

    def meet(self, a: list, b: list, but: str | None = None) -> None:
        """Lay subtree a over b, without b's child `but`, along what both have; terminals that coincide are pairs."""
        todo = [(a, b, but)]
        while todo:
            a, b, but = todo.pop()
            if a[1] is not None and b[1] is not None:
                self.pairs.append((a[1], b[1]))
            small, other = (a[0], b[0]) if len(a[0]) <= len(b[0]) else (b[0], a[0])
            todo += [(a[0][c], b[0][c], None) for c in small if c in other and c != but]

    def merge(self, a: list, into: list) -> None:
        """Lay a light subtree over those gathered so far, whose terminals are lists of words, and add it to them."""
        todo = [(a, into)]
        while todo:
            a, b = todo.pop()
            if a[1] is not None:
                self.pairs += [(a[1], y) for y in b[1]]
                b[1].append(a[1])
            todo += [(x, b[0].setdefault(c, [{}, [], 0])) for c, x in a[0].items()]


def one_edit_pairs(words: list[str], lo: int, hi: int, shorter: int) -> list[tuple[int, int]]:
    """Pairs of numbers of different words that differ by one code point at a place in [lo, hi), the shorter one of
    `shorter` code points; the words agree before lo."""
    if len(words) < 2:
        return []
    found = Trie(words, lo).find(hi - lo)
    return [(i, j) for i, j in found if min(len(words[i]), len(words[j])) == shorter]


def near_words(grouped: DataFrame) -> DataFrame:
    """(word, near, most, best) for words of groups: in a group, how many words are near, the largest n of these, and the
    first word in code-point order that has it. Groups arrive in order and are held one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((),) * 4
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "most", "best"])
            out.clear()
            return made

        def settle(key: tuple, words: list[str], counts: list[int]) -> None:
            facts: dict[int, list] = {}
            for pair in one_edit_pairs(words, key[1], key[2], key[0]):
                for i, j in (pair, pair[::-1]):
                    rank = (-counts[j], words[j])
                    had = facts.get(i)
                    facts[i] = [1, rank] if had is None else [had[0] + 1, min(had[1], rank)]
            out.extend((words[i], near, -best[0], best[1]) for i, (near, best) in facts.items())

        key, words, counts = None, [], []
        for b in batches:
            for *here, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if here != key:
                    if len(words) > 1:
                        settle(key, words, counts)
                    key, words, counts = here, [], []
                words.append(word)
                counts.append(n)
                if len(out) > 50_000:
                    yield rows()
        if len(words) > 1:
            settle(key, words, counts)
        yield rows()

    ordered = grouped.select(*GROUP, "word", "n").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return ordered.mapInArrow(run, "word string, near long, most long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) that follow one another end. Steps double, and n at least doubles with
    every form, so the turns are about the logarithm of the logarithm of the largest n."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        dropped(now.sparkSession, now)
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least: int = 3, shortest: int = 5, ratio: int = 2, crowded: int = 20_000, every: int = 97) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of docs. A word's form is its near word of largest n (ties:
    the first in code-point order), if that has at least `ratio` times the word's n; root is where forms end, the word
    itself if it has none."""
    words = stored(word_counts(docs, least, shortest, every), "spelling-words")
    near = near_words(groups(words, shortest, crowded)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("most")).alias("less"), "best")).alias("x"))
    facts = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("x.best").alias("best"), (-F.col("x.less")).alias("most"))
    strong = F.col("most") >= ratio * F.col("n")
    facts = stored(facts.select("word", "n", "n_near", F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("most")).alias("form_n")), "spelling-forms")
    ends = roots(facts.where("form is not null").select("word", "form"))
    return facts.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
