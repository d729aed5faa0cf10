"""HyperMinHash near-duplicates against exact similarities of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import groups, minhash, near
from corpusloom.llm.hashing import components


def shingles(text, size=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows):
    """doc_id, n_shingles, component_id and kept, by all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    kinds = {}
    for s in sets:
        if s:
            kinds.setdefault(frozenset(s), len(kinds))
    parent = list(range(len(kinds)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, i in kinds.items():
        for b, j in kinds.items():
            if j < i and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            k = root(kinds[frozenset(s)])
            least[k] = min(least.get(k, doc_id), doc_id)
    out = []
    for (doc_id, _), s in zip(rows, sets, strict=True):
        c = None if doc_id is None else least[root(kinds[frozenset(s)])] if s else doc_id
        out.append((doc_id, len(s), c, doc_id == c))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out, common = [], " ".join(word() for _ in range(40))
    for g in range(40):
        base = [word() for _ in range(r.choice([2, 3, 5, 6, 8, 12, 60, 200, 900]))]
        out.append((10 * g, " ".join(base)))
        for k in range(1, 7):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            out.append((10 * g + k, " ".join(w).upper() if k == 6 else "\n".join(w)))
    # A chain: each differs from the next by little, the ends by much.
    chain = [word() for _ in range(120)]
    for k in range(20):
        out.append((1000 + k, " ".join(chain)))
        chain[5 * k : 5 * k + 3] = [word() for _ in range(3)]
    # Texts that share most of themselves, but less than the bound.
    out += [(1100 + i, " ".join(word() for _ in range(18)) + " " + common) for i in range(40)]
    out += [(1200, None), (1201, ""), (1202, " \n"), (1203, "one two"), (1204, "ONE two"), (1205, "x " * 50_000), (1206, "z" * 300_000)]
    out += [(0, out[9][1] + " own end"), (0, "a text of its own"), out[3], out[3], (None, out[0][1]), (None, None)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"crowded": 0}])
def test_whole_table_by_all_pairs(spark, rows, options):
    """Whatever way pairs are looked for: by bands, or by the rarest members wherever a key has any left."""
    docs = spark.createDataFrame([(*x, "own", "x") for x in rows], "doc_id long, text string, kept string, id string").repartition(4)
    out = minhash.minhash_components(docs, **options)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(rows)
    assert sorted((tuple(x) for x in out.collect()), key=repr) == want
    assert sum(not x[3] for x in want) > 100
    if not options:
        assert minhash.minhash_components(docs.limit(0)).count() == 0


def test_estimates_follow_similarity():
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        got = []
        for _ in range(40):
            n = int(r.integers(200, 5000))
            whole = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
            both = int(share * n)
            cut = (both + n) // 2
            a, b = np.sort(whole[:cut]), np.sort(np.concatenate([whole[:both], whole[cut:]]))
            x = [minhash.registers(s).reshape(1, -1) for s in (a, b)]
            e, m = minhash.estimates(*x, np.array([len(a)]), np.array([len(b)]))
            got.append(float(e[0]))
            assert m[0] > 100 and (share < 0.8 or minhash.promising(e, m)[0])
        assert abs(np.mean(got) - share) < 0.03
    assert not minhash.promising(np.array([0.3]), np.array([250]))[0]


def test_registers_by_plain_arithmetic():
    r = random.Random(2)
    h = sorted({r.getrandbits(64) for _ in range(400)} | {5 << 56, (7 << 56) + 1, (9 << 56) + 1234567})
    got = minhash.registers(np.array(h, dtype=np.uint64))
    for k in range(256):
        rest = [x & ((1 << 56) - 1) for x in h if x >> 56 == k]
        if not rest:
            assert got[k] == 0
            continue
        bits = format(min(rest), "056b")
        zeros = len(bits) - len(bits.lstrip("0"))
        assert got[k] == (zeros << 10) + int((bits[zeros + 1 : zeros + 11]).ljust(10, "0") or "0", 2) + 1


@pytest.mark.parametrize("options", [{}, {"dense": 0}, {"dense": 0, "turns": 0}])
def test_groups_of_copies_take_few_pairs(spark, options):
    """A group of n that all are linked takes about n pairs; members of a second component are still found."""
    edges = [(k, i) for k in range(3) for i in range(400)] + [(9, 399), (9, 1000), (9, 1001)]
    members = spark.createDataFrame(edges, "key long, id long")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where((F.col("b") < 400) | (F.col("a") >= 1000) | ((F.col("a") == 399) & (F.col("b") == 1001)))

    found = {(x["id"], x["component"]) for x in components(groups.linked(members, verify, "t", **options)).collect()}
    assert found == {(i, 0) for i in range(400)} | {(1000, 0), (1001, 0)}
    assert sum(asked) < 500


@pytest.mark.parametrize("most", [1500, 4])
def test_sets_of_a_key_compared_in_place(spark, most):
    """By one matrix product, and by blocks that meet pairwise."""
    r = random.Random(4)
    base = [r.getrandbits(40) for _ in range(60)]
    sets = {i: sorted({x for x in base if r.random() < 0.93} | {r.getrandbits(40) for _ in range(r.randint(0, 6))}) for i in range(30)}
    sets[30] = sets[3]
    df = spark.createDataFrame([(i, len(x), x) for i, x in sets.items()], "id long, s long, hs array<long>")
    rest = [(7, i, i // 2, len(sets)) for i in sets] + [(9, 1, 1, 2), (9, 30, 1, 2)]
    got = groups.similar_within(spark.createDataFrame(rest, "key long, id long, label long, all long").repartition(3), df, (4, 5), most).collect()
    near = lambda a, b: 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})
    want = {(i, j) for i in sets for j in sets if i < j and i // 2 != j // 2 and near(sets[i], sets[j])}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 20


def test_sets_ruled_out_by_bitmaps_do_not_travel(spark):
    """Of a key's members whose sets are unlike none is left to compare, near copies leave a row each and not one for each
    pair, and what is similar is found whatever the sizes."""
    r = random.Random(6)
    unlike = {i: sorted(r.getrandbits(63) for _ in range(r.randint(60, 300))) for i in range(120)}
    base = [r.getrandbits(63) for _ in range(100)]
    alike = {1000 + i: sorted({*base[: 100 - i % 3]} | {r.getrandbits(63)}) for i in range(60)}
    mixed = {2000 + i: sorted(base[: r.randint(1, 100)]) for i in range(60)}
    sets = unlike | alike | mixed
    df = spark.createDataFrame([(i, len(x), x) for i, x in sets.items()], "id long, s long, hs array<long>")
    dealt = lambda part, key: spark.createDataFrame([(key, 0, 0, 0, i, i) for i in part], "key long, x int, y int, own int, id long, label long")
    assert groups.possible_within(dealt(unlike, 1), df, (4, 5)).count() == 0
    left = groups.possible_within(dealt(alike, 2), df, (4, 5)).collect()
    assert sorted(x["id"] for x in left) == sorted(alike) and {x["with"] for x in left} == {None}
    rest = [(3, i, i, len(sets)) for i in sets]
    near = lambda a, b: 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})
    want = {(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j])}
    for most in (1500, 50):
        got = groups.similar_within(spark.createDataFrame(rest, "key long, id long, label long, all long"), df, (4, 5), most).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want) > 1770


def test_short_texts_without_a_common_shingle_share_no_key(spark):
    """A short text fills one register of a band; unlike ones must not meet because that register is small."""
    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"{r.getrandbits(40):x}" for _ in range(12))) for i in range(4000)], "doc_id long, text string")
    keys = minhash.bands(minhash.sketches(docs).withColumnRenamed("sig", "id"))
    assert keys.count() > 20_000
    assert keys.groupBy("key").count().where("count > 1").count() == 0


def test_copies_of_a_key_return_links_and_not_pairs(spark):
    """Near copies of several keys, in one block or many: a link for each label at most, and the same components."""
    r = random.Random(9)
    base = [[r.getrandbits(63) for _ in range(60)] for _ in range(3)]
    sets = {i: sorted({*base[i % 3][: 60 - i % 4]} | {r.getrandbits(63)}) for i in range(120)}
    df = spark.createDataFrame([(i, len(x), x) for i, x in sets.items()], "id long, s long, hs array<long>")
    rest = spark.createDataFrame([(7, i, i - i % 6 if i % 6 == 3 else i, len(sets)) for i in sets], "key long, id long, label long, all long")
    for most in (1500, 40):
        got = groups.similar_within(rest, df, (4, 5), most, joined=True)
        known = rest.where("label <> id").select(F.col("label").alias("a"), F.col("id").alias("b"))
        assert {(x["id"], x["component"]) for x in components(got.unionByName(known)).collect()} == {(i, i % 3) for i in sets}
        assert most < 1500 or got.count() < 120


def test_members_that_several_sets_hold(spark):
    r = random.Random(10)
    sets = {i: sorted({r.randrange(-300, 300) for _ in range(r.randint(0, 40))}) for i in range(60)}
    df = spark.createDataFrame([*sets.items()], "id long, hs array<long>").repartition(3)
    often = {h: sum(h in x for x in sets.values()) for x in sets.values() for h in x}
    got = sorted((x["id"], x["h"], x["df"]) for x in near.shared_members(df, 100, per_bucket=10).collect())
    assert got == sorted((i, h, often[h]) for i, x in sets.items() for h in x if often[h] > 1)


def test_a_crowd_with_a_common_passage_makes_no_row_for_each_shingle(spark, monkeypatch):
    """What texts share is counted and answered in blocks: no table between has a row for each shingle of each text."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(400))
    rows = [(i, passage + " " + " ".join(word() for _ in range(300))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " an end of its own") for i in range(30)]
    made = {}
    for module in (minhash, groups, near):

        def stored(df, name, real=module.stored, **options):
            out = real(df, name, **options)
            made[name] = max(made.get(name, 0), out.count())
            return out

        monkeypatch.setattr(module, "stored", stored)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(x) for x in minhash.minhash_components(docs, crowded=0).collect()), key=repr)
    assert got == brute(rows) and sum(not x[3] for x in got) == 30
    # 51 bands for each text, and not the 397 shingles that it shares.
    assert "minhash-crowd" in made and max(made.values()) <= 60 * len(rows), made


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_prefixes_of_sets_by_plain_counts(spark, most):
    """In one part and in many, with sets that several parts have: each set that has a prefix once, its members rarest first."""
    r = random.Random(12)
    word = lambda: r.choice("abcdefghijklmnop")
    texts = [" ".join(word() for _ in range(r.randint(1, 12))) for _ in range(60)]
    texts += [t + " " + word() for t in texts[:40]] + texts[:30] + ["", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    sets = {near._sig(h): set(h.tolist()) for h in map(near.Shingler(2), texts) if len(h)}
    often = {h: sum(h in x for x in sets.values()) for x in sets.values() for h in x}
    answers = near.texts_answered(docs, 100, 2, per_bucket=2, most=most)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = []
    for key, x in sets.items():
        held = sorted((often[h], signed(h)) for h in x if often[h] > 1)
        k = len(held) - (4 * len(x) + 4) // 5 + 1
        if k > 0:
            want.append((signed(key), len(x), k, [h for _, h in held]))
    assert sorted(tuple(x) for x in near.prefix_sets(answers, (4, 5)).collect()) == sorted(want)
    assert 20 < len(want) < len(sets)
