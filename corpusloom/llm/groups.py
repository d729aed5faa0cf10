"""Links between members of many overlapping groups, without all pairs of a group.

Whoever may be linked shares a key. A key's members first meet one of them, its head. Pairs of members that verified links
already join need no link of their own, so what is left to look at are pairs of a key whose members have different labels
(the smallest member they are known to be joined with). They are counted before any is made. Keys with more than `crowded`
of them can be handed to another way (`other`) of finding the links among their members, and the rest to one that looks at
them in place (`within`), so that pairs which fail never become rows. Without these, while there are more
than `dense` of them for each member, members meet a further head of each key, drawn at random. Then the rest is paired
exactly, so no link between components is missed. A group of n near copies takes about n pairs and not n * n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dropped, stored


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labels(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, label): the smallest label among a member and those it is linked with."""
    held = members.groupBy("id").agg(F.min("label").alias("own")) if "label" in members.columns else None
    ends = found.select(F.col("a").alias("id"), F.col("b").alias("with")).unionByName(found.select(F.col("b").alias("id"), F.col("a").alias("with")))
    if held is not None:
        ends = ends.join(held.withColumnRenamed("id", "with"), "with", "left").select("id", F.coalesce("own", "with").alias("with"))
    least = ends.groupBy("id").agg(F.min("with").alias("least"))
    own = F.col("label") if held is not None else F.col("id")
    return members.join(least, "id", "left").select("key", "id", F.least(own, F.col("least")).alias("label"))


def linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], name: str, crowded: int = 1000, other: Callable[[DataFrame], DataFrame] | None = None, within: Callable[[DataFrame], DataFrame] | None = None, turns: int = 3, dense: int = 8) -> DataFrame:
    """Links (a, b) among members (key, id) that give the components of all pairs that share a key and that `verify`, of
    distinct pairs (a, b) with a < b, returns. `within` gets the rest (key, id, label, all: the key's members) of keys that
    were not handed to `other` and returns the links that it finds in it; without, the rest is paired by a join."""
    heads = stored(members.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head"), f"{name}-heads")
    members = stored(members.join(heads, "key"), f"{name}-members")
    tested = stored(members.where("id <> head").select(*_ordered("head", "id")).distinct(), f"{name}-pairs")
    found = stored(verify(tested), f"{name}-links")
    label, turn = members.select("key", "id"), 0
    while True:
        label = stored(_labels(label, found), f"{name}-labels")
        sizes = label.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.col("n").cast("double") * F.col("n")).alias("same"), F.count(F.lit(1)).alias("kinds"))
        mixed = stored(sizes.where("kinds > 1").select("key", "all", ((F.col("all").cast("double") * F.col("all") - F.col("same")) / 2).alias("cross")), f"{name}-mixed")
        full, cross, held = mixed.agg(F.count(F.when(F.col("cross") > crowded, 1)), F.sum("cross"), F.sum("all")).first()
        if not cross:
            return found
        if other is not None or within is not None or turn == turns or cross <= dense * held:
            break
        drawn = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "label"))
        heads = stored(label.join(mixed, "key", "left_semi").groupBy("key").agg(drawn.alias("x")).select("key", F.col("x.id").alias("head"), F.col("x.label").alias("at")), f"{name}-heads")
        pairs = label.join(heads, "key").where("label <> at").select(*_ordered("head", "id")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), f"{name}-pairs")
        found = stored(found.unionByName(verify(pairs)), f"{name}-links")
        tested = tested.unionByName(pairs)
        turn += 1
    if other is not None and full:
        crowd = label.join(mixed.where(F.col("cross") > crowded).select("key"), "key", "left_semi").select("id").distinct()
        found = found.unionByName(other(stored(crowd, f"{name}-crowd")))
        mixed = mixed.where(F.col("cross") <= crowded)
    label = stored(label.join(mixed.select("key"), "key", "left_semi"), f"{name}-labels")
    if within is not None:
        return found.unionByName(stored(within(label.join(mixed.select("key", "all"), "key")), f"{name}-links"))
    one, two = label.alias("one"), label.alias("two")
    rest = one.join(two, "key").where((F.col("one.id") < F.col("two.id")) & (F.col("one.label") != F.col("two.label")))
    rest = rest.select(F.col("one.id").alias("a"), F.col("two.id").alias("b")).distinct()
    rest = stored(rest.join(tested, ["a", "b"], "left_anti"), f"{name}-rest")
    out = found.unionByName(stored(verify(rest), f"{name}-links"))
    dropped(label.sparkSession, rest, label)
    return out


def similar_sets(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b) whose sets (id, s: size of the whole set, hs: all members that other sets can have) have a
    similarity of `share` (a fraction) or more."""
    p, q = share
    one, two = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}"), F.col("hs").alias(f"h{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b")
    # o / (sa + sb - o) >= p / q; sizes alone rule out most others before sets are compared.
    fit = (F.col("sa") * q >= F.col("sb") * p) & (F.col("sb") * q >= F.col("sa") * p)
    return both.where(fit).where((p + q) * F.size(F.array_intersect("ha", "hb")) >= p * (F.col("sa") + F.col("sb"))).select("a", "b")


def bitmaps(sets: DataFrame) -> DataFrame:
    """(id, s, n: members in hs, bits) of sets (id, s, hs): a bit for each member's hash modulo the length of bits, a power
    of two of at least four bits a member. A bit that only one of two sets has is a member that the other lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, out = [], []
            for x in b.column(2):
                h = x.values.to_numpy().view(np.uint64)
                full = np.zeros(max(64, 1 << (4 * len(h) - 1).bit_length()) if len(h) else 64, dtype=bool)
                full[h & np.uint64(len(full) - 1)] = True
                sizes.append(len(h))
                out.append(np.packbits(full, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["id", "s", "n", "bits"])

    return sets.select("id", F.col("s").cast("long").alias("s"), "hs").mapInArrow(run, "id long, s long, n long, bits binary")


def _possible(own: np.ndarray, label: np.ndarray, s: np.ndarray, n: np.ndarray, bits: list[bytes], share: tuple[int, int], cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of different labels that sizes and bitmaps do not rule out; with `cross`, of different
    own only. Of two bitmaps the longer is folded to the length of the other."""
    p, q = share
    words = np.array([len(x) // 8 for x in bits])
    out = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
    for width in np.unique(words).tolist():
        at = np.flatnonzero((words >= width) & (words <= width * 2 * q // p))
        at = at[np.argsort(s[at], kind="stable")]
        rows = np.empty((len(at), width), dtype=np.uint64)
        for i, k in enumerate(at.tolist()):
            rows[i] = np.bitwise_or.reduce(np.frombuffer(bits[k], dtype=np.uint64).reshape(-1, width), axis=0)
        size, lost, here = s[at], n[at] - np.bitwise_count(rows).sum(axis=1, dtype=np.int64), words[at] == width
        step = max(1, (1 << 20) // max(1, len(at) * width))
        for i in range(0, len(at), step):
            one = slice(i, i + step)
            # Sizes ascend, so those within the bound are one run.
            two = slice(i, int(np.searchsorted(size * p, size[one][-1] * q, "right")))
            fit = (size[one, None] * q >= size[None, two] * p) & (label[at[one], None] != label[None, at[two]]) & (here[one, None] | here[None, two])
            fit &= np.arange(i, i + fit.shape[0])[:, None] < np.arange(i, i + fit.shape[1])[None]
            if cross:
                fit &= own[at[one], None] != own[None, at[two]]
            x, y = np.nonzero(fit)
            x, y = x + i, y + i
            for k in range(0, len(x), max(1, (1 << 20) // width)):
                u, v = (z[k : k + max(1, (1 << 20) // width)] for z in (x, y))
                most = np.bitwise_count(rows[u] & rows[v]).sum(axis=1, dtype=np.int64) + np.minimum(lost[u], lost[v])
                left = (p + q) * most >= p * (size[u] + size[v])
                out.append((at[u[left]], at[v[left]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def possible_within(dealt: DataFrame, sets: DataFrame, share: tuple[int, int], dense: int = 8) -> DataFrame:
    """What is left of dealt (key, x, y, own, id, label), with `with`: of a group (key, x, y) in which bitmaps leave at most
    `dense` pairs for each member, a row for each pair; of others, a row without `with` for each member of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None

        def left() -> Iterator[pa.RecordBatch]:
            own, ids, label, s, n = (np.array([g[k] for g in group], dtype=np.int64) for k in range(5))
            if len(group) > 1 and (label != label[0]).any():
                i, j = _possible(own, label, s, n, [g[5] for g in group], share, at[1] != at[2])
                many = len(i) > dense * len(group)
                if many:
                    i = np.unique(np.concatenate([i, j]))
                key, x, y = (pa.array(np.full(len(i), v, dtype=np.int64)) for v in at)
                partner = pa.nulls(len(i), pa.int64()) if many else pa.array(ids[j])
                yield pa.RecordBatch.from_arrays([key, x, y, pa.array(own[i]), pa.array(ids[i]), pa.array(label[i]), partner], names=["key", "x", "y", "own", "id", "label", "with"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, x, y, *rest_of in zip(*columns, strict=True):
                if (key, x, y) != at:
                    yield from left()
                    group, at = [], (key, x, y)
                group.append(rest_of)
        yield from left()

    both = dealt.join(bitmaps(sets), "id").select("key", "x", "y", "own", "id", "label", "s", "n", "bits")
    return both.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "key long, x long, y long, own long, id long, label long, with long")


def joining(near: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs of a symmetric matrix that join all labels that its pairs join: a link for each label but
    one of what is joined."""
    code = np.unique(label, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(code[order])) + 1)
    seen, out = np.zeros(len(members), dtype=bool), ([], [])
    for k in np.unique(code[near.any(axis=1)]).tolist():
        if seen[k]:
            continue
        seen[k], queue = True, members[k].tolist()
        for i in queue:
            at = np.flatnonzero(near[i] & ~seen[code])
            if not len(at):
                continue
            reached, first = np.unique(code[at], return_index=True)
            seen[reached] = True
            out[0].extend([i] * len(reached))
            out[1].extend(at[first].tolist())
            for m in reached.tolist():
                queue.extend(members[m].tolist())
    return np.array(out[0], dtype=np.int64), np.array(out[1], dtype=np.int64)


def similar_within(rest: DataFrame, sets: DataFrame, share: tuple[int, int], most: int = 1500, joined: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of one key and different labels in rest (key, id, label, all) whose sets (id, s, hs) are that
    similar. A key with more than `most` members is cut into blocks of about that many, and every two blocks meet in a task
    of their own. Bitmaps of the sets meet first and rule out pairs by an upper bound of what two sets share. The few pairs
    left are compared one by one; where many are, their sets meet in a task and are compared by matrix products. With
    `joined` these return links enough to join the labels that their pairs join, fewer than there are labels, not all
    pairs."""
    p, q = share
    blocks = F.ceil(F.col("all") / most).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = rest.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"x": F.least("own", "with"), "y": F.greatest("own", "with")}).select("key", "x", "y", "own", "id", "label")
    left = stored(possible_within(dealt, sets, share), "within-left")
    pairs = left.where(F.col("with").isNotNull()).select(*_ordered("id", "with")).distinct()

    def compared(own: np.ndarray, ids: np.ndarray, label: np.ndarray, s: np.ndarray, hs: list[np.ndarray], cross: bool) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(h) for h in hs])
        _, code, n = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(hs)), sizes), n[code] > 1
        row, code = row[shared], (np.cumsum(n > 1) - 1)[code[shared]]
        both = np.zeros((len(hs), len(hs)), dtype=np.float32)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for k in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
            i, j = np.searchsorted(code, (k, k + 2048))
            part = np.zeros((len(hs), 2048), dtype=np.float32)
            part[row[i:j], code[i:j] - k] = 1
            both += part @ part.T
        # o / (sa + sb - o) >= p / q
        near = (p + q) * both.astype(np.int64) >= p * (s[:, None] + s[None])
        near &= label[:, None] != label[None]
        if cross:
            near &= own[:, None] != own[None]
        a, b = joining(near, label) if joined else np.nonzero(near & (ids[:, None] < ids[None]))
        return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None

        def found() -> Iterator[pa.RecordBatch]:
            own, ids, label, s = (np.array([g[k] for g in group], dtype=np.int64) for k in range(4))
            if len(group) > 1 and (label != label[0]).any():
                a, b = compared(own, ids, label, s, [g[4] for g in group], at[1] != at[2])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(7)]
            for k, (key, x, y, *rest_of) in enumerate(zip(*columns, strict=True)):
                if (key, x, y) != at:
                    yield from found()
                    group, at = [], (key, x, y)
                group.append((*rest_of, batch.column(7)[k].values.to_numpy()))
        yield from found()

    both = left.where(F.col("with").isNull()).join(sets, "id").select("key", "x", "y", "own", "id", "label", "s", "hs")
    exact = both.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")
    return exact.unionByName(similar_sets(pairs, sets, share)).distinct()


def prefix_heads(sets: DataFrame) -> DataFrame:
    """(key, id): the first k members of sets (id, k, hs: rarest first), one of which two similar sets have in common."""
    return sets.select(F.explode(F.slice("hs", F.lit(1), F.col("k").cast("int"))).alias("key"), "id")
