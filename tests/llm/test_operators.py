"""The ten operators against brute force on a small table with nulls, empty and long texts, repeats and ties."""

import gzip
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import common, contamination, hashing, language, lm, pieces, pii, quality, rans, repeats, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus() -> list[tuple]:
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeèß") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows = [(i, text(r.randint(1, 150)), "en" if i % 2 else "fr") for i in range(40)]
    rows += [(40 + i, text(20) + " " + passage + " " + text(20), "en") for i in range(12)]
    rows += [(60, rows[3][1], "en"), (61, rows[3][1] + " x", "en"), (62, None, None), (63, "", "en"), (64, " \n ", "en"), (65, "a b " * 4000, "fr"), (66, "x" * 5000, "en")]
    rows += [(67, "mail me@ex.org or +1 (743) 555-3824, card 4111 1111 1111 1111 at 10.0.0.255!", "en"), (68, "SHOUT!! AGAIN!! " * 30 + "\nl\nl\nl", "en"), (69, "日本語 テキスト 😀\nab  c", "en"), (None, text(60), "en")]
    return rows + [rows[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # Columns whose names clash with what operators add.
    return df.withColumns({"n_words": F.lit("own"), "kept": F.lit("own"), "marks": F.lit(1), "score": F.lit("s"), "items": F.lit(2)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def got(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=repr)


def expected(rows, f):
    return sorted((f(*r) for r in rows), key=repr)


def test_quality_statistics(docs, rows, empty):
    def one(i, t, _):
        t = t or ""
        w, g = re.findall(r"[^\x20\x09-\x0D]+", t), defaultdict(list)
        for k in range(len(w) - 2):
            g[tuple(w[k : k + 3])].append(k)
        rep = len({k + o for v in g.values() if len(v) > 1 for k in v for o in range(3)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)

    keys = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(quality.text_statistics(docs), *keys) == expected(rows, one)
    assert quality.text_statistics(empty).count() == 0


def test_quality_learns_a_threshold(spark, docs):
    good, bad = "the cat sat on a mat and looked out ", "the* cat$ sat# on% a& mat| and< looked> "
    data = [(i, (bad if i % 4 == 0 else good) * (8 + i % 5) + str(i)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(None, 0), (3, None)], "doc_id long, quality int")
    out, rules = quality.quality_rules(spark.createDataFrame(data, "doc_id long, text string"), labels)
    assert rules.rules and all(r["rule"] > 0 for r in out.where("doc_id % 4 = 0").collect())
    assert out.where("doc_id % 4 <> 0 and rule > 0").count() == 0
    none, rules = quality.quality_rules(docs, labels.limit(0))
    assert not rules.rules and none.where("kept = base_failed").count() == 0


def test_contamination(spark, docs, rows, empty):
    item = rows[45][1].split()
    bench = [(1, " ".join(item[30:45])), (2, rows[10][1]), (3, "unseen words only"), (4, None), (5, "!!"), (6, " ".join(item[30:41]).upper()), (7, "a b")]
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {(i, tuple(w[k : k + 10])) for i, t in bench if (w := words(t)) for k in range(max(1, len(w) - 9))}

    def one(i, t, _):
        w, hit, items = words(t), set(), set()
        for n in {len(g) for _, g in windows}:
            at = defaultdict(list)
            for k in range(len(w) - n + 1):
                at[tuple(w[k : k + n])].append(k)
            for item, g in windows:
                if len(g) == n and i is not None:
                    for k in at.get(g, ()):
                        hit |= set(range(k, k + n))
                        items.add(str(item))
        return i, len(w), len(hit), len(items), ",".join(sorted(items))

    b = spark.createDataFrame(bench, "item_id long, text string")
    out = contamination.decontaminate(docs, b).withColumn("joined", F.array_join("items", ","))
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "joined") == expected(rows, one)
    assert contamination.decontaminate(empty, b).count() == 0
    assert contamination.decontaminate(docs, b.limit(0)).where("contaminated").count() == 0
    w, _ = contamination.phrases(b)
    index = contamination.build_index(docs, w.select(F.explode("words").alias("term")).distinct())
    exact, near = contamination.exact_matches(docs, w, index), contamination.proximity_matches(index, w)
    assert exact.select("doc_id", "wid", "start").exceptAll(near).isEmpty()


def test_contamination_by_row(spark):
    """Rows that share a doc_id, or have none, are judged by their own texts."""
    passage = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    data = [(1, "clean text " * 9), (1, passage + " x"), (1, "y " + passage + " " + passage), (None, passage), (None, "nothing here"), (1, passage + " x"), (2, ("z " * 60_000) + passage)]
    out = got(contamination.decontaminate(spark.createDataFrame(data, "doc_id long, text string"), items), "doc_id", "n_words", "n_hit", "contaminated")
    assert out == sorted([(1, 18, 0, False), (1, 15, 14, True), (1, 29, 28, True), (None, 14, 14, True), (None, 2, 0, False), (1, 15, 14, True), (2, 60_014, 14, True)], key=repr)


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_components(spark, hot):
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:12]:
        for _ in range(6):
            p ^= 1 << r.randrange(64)
            prints.add(p)
    base = r.getrandbits(32)
    prints |= {(base << 32) | (1 << k) for k in range(20)} | {0, 1, 3, 7}
    ids = {p: i for i, p in enumerate(sorted(prints))}
    signed = [(i, p - (1 << 64) if p >= 1 << 63 else p) for p, i in ids.items()]
    edges = hashing.links(spark.createDataFrame(signed, "id long, fp long"), hot)
    have = {r["id"]: r["component"] for r in hashing.components(edges).collect()}
    parent = {i: i for i in ids.values()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, i in ids.items():
        for b, j in ids.items():
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert {i: have.get(i, i) for i in parent} == {i: root(i) for i in parent}


def test_components_of_long_chains(spark):
    r = random.Random(12)
    edges, want = [], {}
    for start, n in ((0, 1000), (5000, 300), (9000, 2)):
        ids = [start + k for k in range(n)]
        r.shuffle(ids)
        edges += list(zip(ids, ids[1:], strict=False))
        want |= dict.fromkeys(ids, start)
    edges += [(20_000, 20_000 + k) for k in range(1, 400)] + [(30_000 + k, 30_999) for k in range(400)]
    want |= {20_000 + k: 20_000 for k in range(400)} | {30_000 + k: 30_000 for k in (*range(400), 999)}
    out = hashing.components(spark.createDataFrame(edges + edges[:5], "a long, b long"))
    assert {r["id"]: r["component"] for r in out.collect()} == want and out.count() == len(want)
    assert hashing.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(docs, rows, empty):
    def one(i, t, _):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    out = hashing.simhash_components(docs)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64)) for r in out.collect()), key=repr) == expected(rows, one)
    same = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert same[60] == same[3] == 3 and same[None] is None and same[62] == same[63] == same[64] == 62
    assert hashing.simhash_components(empty).count() == 0


def test_runs_of_slices_of_any_size(monkeypatch):
    """Places take as many bits as they need."""
    raws = [np.random.default_rng(k).integers(97, 123, 3000, dtype=np.uint8).tobytes() for k in range(3)]
    want = [x.tolist() for x in repeats.runs_of(raws, 200, 40, (repeats.Hasher(1), repeats.Hasher(2)))]
    monkeypatch.setattr(repeats, "_PLACE_BITS", 1)
    have = [x.tolist() for x in repeats.runs_of(raws, 200, 40, (repeats.Hasher(1), repeats.Hasher(2)))]
    assert have[:4] == want[:4] and sum(have[2]) == 3 * (3000 - 199)


@pytest.mark.parametrize("hot", [512, 1])
def test_repeats(spark, docs, rows, empty, hot):
    raws, seen = [(t or "").encode() for _, t, _ in rows], Counter()
    for x in raws:
        seen.update(x[k : k + 200] for k in range(len(x) - 199))

    def one(i, t, _):
        x = (t or "").encode()
        starts = [(k, 1) for k in range(len(x) - 199) if seen[x[k : k + 200]] > 1]
        gone = repeats.covered(len(x), starts, 200)
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        return i, len(x), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()

    assert got(repeats.remove_repeats(docs, hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected(rows, one)
    assert repeats.remove_repeats(empty).count() == 0


def test_refine_is_exact():
    r = np.random.default_rng(3)
    data = np.concatenate([r.integers(97, 100, 400), np.full(300, 97), r.integers(97, 99, 400)]).astype(np.uint8)
    data = np.concatenate([data, data[100:500]])
    for length in (8, 13, 64):
        bucket, raw = repeats.refine(data, length), data.tobytes()
        by = defaultdict(set)
        for k in range(len(raw) - length + 1):
            by[bucket[k]].add(raw[k : k + length])
        assert all(len(v) == 1 for v in by.values()) and len(by) == len({raw[k : k + length] for k in range(len(raw) - length + 1)})


def test_pii(docs, rows, empty):
    def base(t):
        out = [("email", m) for m in pii.EMAIL.finditer(t)] + [("ip", m) for m in pii.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", m) for m in pii.CARD.finditer(t) if 13 <= len(pii._digits(m[0])) <= 19 and pii.luhn(pii._digits(m[0]))]
        out += [("phone", m) for m in pii.PHONE.finditer(t) if 9 <= len(pii._digits(m[0])) <= 15]
        return [(k, m.start(), m.end()) for k, m in out]

    r = random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice("a.@-1 9+()%é@.0") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(s) == base(s)
    out = pii.find_pii(docs)
    assert got(out, "doc_id", "base_sha256", "n_email") == expected(rows, lambda i, t, _: (i, hashlib.sha256(pii.listed(base(t or "")).encode()).hexdigest(), sum(k == "email" for k, *_ in base(t or ""))))
    masked = pii.find_pii(docs, replace=True).where("doc_id = 67").first()["text"]
    assert masked == "mail <email> or <phone>, card <card> at <ip>!"
    assert pii.find_pii(empty).count() == 0


def test_pii_field_generalises(spark):
    field = pii.train(pii.labelled_table(spark, rows=500))
    held = defaultdict(list)
    for r in pii.labelled_table(spark, rows=200, seed=77).collect():
        held[r["sentence"]].append((r["position"], r["token"], r["tag"]))
    held = [sorted(x) for x in held.values()]
    found = field.decode([[t for _, t, _ in s] for s in held])
    right = sum([pii.TAGS[k] for k in tags] == [t for *_, t in s] for tags, s in zip(found, held, strict=True))
    assert right / len(held) > 0.93
    assert pii.added_spans(field, ["call (743) 555-3824 now", "clean text"], [[], []]) == [[("phone", 5, 19)], []]


def test_pii_viterbi_by_enumeration(spark):
    field = pii.train(pii.labelled_table(spark, rows=150))
    r = random.Random(5)
    words = ["call", "(743)", "555-3824", "743-555-3824", "x[at]y.com", "0033", "12", "1234", "Version", "2.1", "me", "(at)", "ab.org,", "$$$", "9"]
    for _ in range(25):
        s = [r.choice(words) for _ in range(r.randint(1, 4))]
        emit = np.array([sum((field.emit[field.names[f]] for f in fs if f in field.names), np.zeros(len(pii.TAGS))) for fs in pii.features(s)])
        assert np.allclose(field.scores(s, np.array([len(s)])), emit)

        def value(path):
            return field.start[path[0]] + sum(emit[t, k] for t, k in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(itertools.product(range(len(pii.TAGS)), repeat=len(s)), key=value)
        assert math.isclose(value(best), value(field.decode([s])[0].tolist()), abs_tol=1e-9)
    # Windows give what one pass over the whole sequence gives; batches do not change results.
    long = [[r.choice(words) for _ in range(n)] for n in (1, 700, 2000, 3)]
    found = field.decode([*long, []])
    assert len(found[-1]) == 0
    for s, tags in zip(long, found, strict=False):
        emit = field.scores(s, np.array([len(s)]))
        emit[0] += field.start
        assert field._best(emit, np.array([0]), np.array([len(s)]))[0].tolist() == tags.tolist()
        assert not any(pii.TAGS[b].startswith("I-") and (t == 0 or pii.TAGS[tags[t - 1]][2:] != pii.TAGS[b][2:]) for t, b in enumerate(tags))


def test_pii_of_very_long_texts(spark):
    field = pii.train(pii.labelled_table(spark, rows=100))
    for text in ("x" * 1_000_000, "7" * 1_000_000, "1." * 500_000, "7 " * 500_000, "a@" * 200_000, "+1 " * 200_000, "漢字" * 300_000):
        began = time.time()
        base = pii.base_spans(text)
        pii.added_spans(field, [text], [base])
        assert time.time() - began < 60
    assert len(pii.base_spans("1." * 500_000 + "1")) == 125_000


def test_pii_other_writings(spark):
    """Personal data as the labelled table does not write it, and numbers that are none."""
    field = pii.train(pii.labelled_table(spark))
    data = ["Reach Ana on (212) 555-0147 after six", "her desk: 415-555-0132, thanks", "mail joan[at]museum.org today", "write to k.lee (at) lab9.net please", "ping 10[.]0[.]3[.]17 first", "card 4539.1488.0343.6467 expired"]
    clean = ["in 1999 and 2004 we met 12 people", "chapter 3.2, page 114", "on 2021-05-17 at 10:45", "it cost $1,204.50 or 15%", "version 2.0.1 of the code", "the cat sat on a mat"]
    assert sum(bool(x) for x in pii.added_spans(field, data, [pii.base_spans(t) for t in data])) >= 5
    assert sum(bool(x) for x in pii.added_spans(field, clean, [pii.base_spans(t) for t in clean])) == 0


def lm_by_brute_force(all_rows):
    """(probability of a word after a context, known words, training counts, results of every row) by plain recursion."""
    held = {i for i, *_ in all_rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 1}
    toks = [lm.tokens(t) for _, t, _ in all_rows]
    train = [w for (i, *_), w in zip(all_rows, toks, strict=True) if i not in held]
    seen = {m: Counter(tuple(w[k : k + m]) for w in train for k in range(len(w) - m + 1)) for m in (1, 2, 3)}
    n, scale = sum(seen[1].values()), sum(seen[1].values()) + 0.5 * (len(seen[1]) + 1)

    def p(ctx, w):
        if not ctx:
            return (seen[1][(w,)] + 0.5) / scale
        c = seen[len(ctx)][ctx]
        return (seen[len(ctx) + 1][(*ctx, w)] + lm.MASS * p(ctx[1:], w)) / (c + lm.MASS) if c else p(ctx[1:], w)

    out = []
    for (i, *_), w in zip(all_rows, toks, strict=True):
        base = sum(math.log10(p((), x)) for x in w)
        out.append((i, i in held, len(w), sum((x,) in seen[1] for x in w), n, base, sum(math.log10(p(tuple(w[max(0, k - 2) : k]), x)) for k, x in enumerate(w))))
    return p, seen, sorted(out, key=repr)


def test_lm_probabilities_sum_to_one(rows):
    p, seen, _ = lm_by_brute_force(rows[60:])
    words = [w for (w,) in seen[1]]
    for ctx in [(), *list(seen[1])[:20], *list(seen[2])[:40], (b"never", words[0])]:
        if ctx[-1:] != (lm.END,):
            assert math.isclose(sum(p(ctx, w) for w in [*words, b"unseen"]), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 2000, "window": 70}, {"slice_bytes": 1, "window": 3}])
def test_lm_scores_by_brute_force(docs, rows, sizes):
    some = [r for r in rows if sizes.get("window", 9) > 5 or len(r[1] or "") < 1000]
    df = docs if len(some) == len(rows) else docs.where("length(coalesce(text, '')) < 1000")
    have = got(lm.lm_scores(df, **sizes), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    _, _, want = lm_by_brute_force(some)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    for x, y in zip(have, want, strict=True):
        assert math.isclose(x[5], y[5], rel_tol=1e-9) and math.isclose(x[6], y[6], rel_tol=1e-9)


def test_lm_rare_grams_count(spark, empty):
    # Pairs that are a far smaller share of all tokens than 1e-5 count as well.
    a, b, c, d = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 != 1][:4]
    many = [(a, "x " * 500_000, "en"), (b, "rare pair here", "en"), (c, "rare pair here", "en"), (d, "a rare pair", "en")]
    have = got(lm.lm_scores(spark.createDataFrame(many, "doc_id long, text string, lang string")), "doc_id", "score")
    assert all(x[0] == y[0] and math.isclose(x[1], y[-1], rel_tol=1e-9) for x, y in zip(have, lm_by_brute_force(many)[2], strict=True))
    assert lm.lm_scores(empty).count() == 0


def test_lm_numbers_survive_packing():
    r = np.random.default_rng(3)
    for top in (2, 300, 70_000, 1 << 40):
        x = r.integers(0, top, 1000)
        assert np.array_equal(lm.unpacked(lm.packed(x), 1000), x)
    for top in (2000, 1 << 20, 1 << 56, (1 << 64) - 1):
        k = np.unique(r.integers(0, top, 1000, dtype=np.uint64))
        assert all(np.array_equal(lm.keys_unpacked(lm.keys_packed(k[:n]), n), k[:n]) for n in (0, 1, 2, len(k)))


def test_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, at, want = Tokenizer.from_file(path), 0, []
    some = [r for r in rows if r[0] is not None]
    for i, t, _ in sorted(some, key=lambda r: r[0]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    out = rans.read_ids(rans.write_ids(docs.where("doc_id is not null"), path, range_bytes=20_000))
    assert sorted(got(out, "doc_id", "start", "n_tokens", "ids_crc32")) == sorted(want)
    assert rans.read_ids(rans.write_ids(empty, path)).count() == 0


def test_rans_blocks():
    r = np.random.default_rng(1)
    for n in (1, 7, rans.LANES, 3 * rans.LANES * rans.EVERY + 5):
        ids = np.minimum(r.geometric(0.01, n), 60000).astype(np.uint32)
        freq = rans.quantised(np.bincount(ids))
        start, slots = rans.tables(freq)
        words, marks = rans.encode_block(ids, freq, start)
        assert np.array_equal(rans.decode_block(words, marks, n, freq, start, slots), ids)
        part = rans.LANES * rans.EVERY
        assert np.array_equal(rans.decode_block(words, marks, n, freq, start, slots, 1, 2), ids[part : 2 * part])
    for counts in (np.array([0, 5]), np.ones(60000), np.r_[10**9, np.ones(50000)]):
        assert rans.quantised(counts.astype(np.int64)).sum() == 1 << rans.BITS


def test_byte_bpe_pieces_match_the_library():
    e, r = rans.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", ".", ",", " b", "'s", "12", "é", "漢", "\t", " ", "　", "!", "x y", "\0", "\x1c", "_", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


def test_language(spark, docs, empty):
    fr, en = "le chat est sur la table et il mange ", "the cat is on the table and it eats "
    data = [(i, (fr if i % 2 else en) * (1 + i % 3), "fr" if i % 2 else "en") for i in range(200)] + [(900, None, "en"), (901, "12 !!", None), (902, "", "fr")]
    out = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(out[i]["lang_pred"] == x and 0 <= out[i]["score"] <= 1 for i, _, x in data[:200])
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert out[3]["held_out"] == (zlib.crc32(b"3") % 3 == 1)
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_letters_and_of_many_languages(spark):
    data = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q{chr(97 + i // 676)} " * 3, f"l{i:04d}") for i in range(1200) for _ in range(2)]
    data = [(k, t, x) for k, (_, t, x) in enumerate(data)] + [(9000, "² ½ ①", "x"), (9001, "1_2", None), (9002, "\u0301", None), (9003, "l\u0301e", None)]
    out = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string"), max_rows=600, columns=256).collect()}
    assert [out[i]["lang_pred"] for i in (9000, 9001, 9002)] == ["und"] * 3 and out[9003]["lang_pred"] != "und"
    learned = {x for i, _, x in data if x and zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r["lang_pred"] for r in out.values()} - {"und"} <= learned and len(learned) > 1000
    one = language.identify(spark.createDataFrame([(i, "le chat", "fr") for i in range(9)], "doc_id long, text string, lang string"))
    assert {(r["lang_pred"], r["score"]) for r in one.collect()} == {("fr", 1.0)}


def test_language_cleans_in_one_pass():
    slow = regex.compile(r"[^\p{L}\p{M}]+|(?<!\p{L}\p{M}*)\p{M}+")
    r = np.random.default_rng(5)
    for _ in range(2000):
        t = "".join(r.choice(list("ab\u0301\u0302 1!"), r.integers(0, 12)))
        assert language.NOT_LETTERS.sub(" ", t).split() == slow.sub(" ", t).split() and "  " not in language.NOT_LETTERS.sub(" ", t).strip()
    began = time.time()
    assert len(language.NOT_LETTERS.sub(" ", "e" + "\u0301" * 1_000_000)) == 1_000_001
    assert language.NOT_LETTERS.sub(" ", "1" + "\u0301" * 1_000_000) == language.NOT_LETTERS.sub(" ", "\u0301" * 1_000_000) == " "
    assert time.time() - began < 5


def test_language_frequencies_cover_all_rows(spark):
    data = [(i, "ab" if i % 4 else "zz", "en") for i in range(400)]
    idf = language.inverse_frequencies(spark.createDataFrame(data, "doc_id long, text string, lang string"), 1 << 12)
    c, _ = language.grams(["zz"], 1 << 12)
    assert np.allclose(idf[c[0]], math.log(401 / 401) + 1) and math.isclose(max(idf[x] for x in set(c.tolist())), math.log(401 / 101) + 1)


def test_warc(spark):
    long = "<p>" + "x" * 1200
    pages = [(1, "http://A.com/x", long), (2, None, long), (3, "http://b.org/y\r\nz", "short"), (4, "http://b.org/", None), (5, "http://a.com/x", "short"), (6, "http://a.com/q", long), (6, "http://a.com/q", long), (7, "u", "é" * 600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = warc.merge_index(warc.index_runs(warc.write_archives(df)), range_rows=3)

    def one(i, _, h):
        raw = (h or "").encode()
        other = 6 if h == long and i != 6 else None
        return i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", other

    assert got(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(pages, one)
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in out.orderBy("position").collect()]
    assert order == sorted(order) and sorted(r["position"] for r in out.collect()) == list(range(len(pages)))
    assert warc.merge_index(warc.index_runs(warc.write_archives(df.limit(0)))).count() == 0


def test_segments_open_with_gzip_and_read_in_one_pass(spark):
    pages = [(i, f"http://h/{i % 7}", f"<p>{i}" + "é" * (i % 400)) for i in range(300)] + [(900, "http://h/long", "z" * 3_000_000), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").select("page_id", "url", "html", F.lit("x").alias("digest"), F.lit(1).alias("run"))
    out = warc.write_archives(df)
    for r in out.collect():
        plain = gzip.decompress(bytes(r["content"]))
        assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC/1.1\r\nWARC-Type: ") == len(list(warc.records(bytes(r["content"]))))
    history = warc.merge_index(warc.index_runs(out), range_rows=40)
    rows = sorted(((r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0), r["position"]) for r in history.collect())
    assert [p for _, p in rows] == list(range(len(pages)))
    many = b"".join(gzip.compress(warc.record(i, "http://h/", b"x" * 50, "d", None), 1, mtime=0) for i in range(20_000))
    began = time.time()
    assert sum(1 for _ in warc.records(many)) == 20_000 and time.time() - began < 20
    with pytest.raises(ValueError):
        list(warc.records(many[:-4]))


def test_loser_tree():
    r = random.Random(0)
    for k in range(0, 9):
        runs = [sorted(r.randint(0, 9) for _ in range(r.randint(0, 6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(x for run in runs for x in run)


def test_pieces_match_the_library(docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m, r = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Matcher(pieces.Model.load(path)), random.Random(5)
    texts = [t or "" for _, t, _ in rows] + ["".join(r.choice("abcdehtr▁ .,\nénИ漢😀") for _ in range(r.randint(1, 60))) for _ in range(800)] + [" " * 37 + "x" + " " * 200, "<s> <0x41> </s>"]
    ids = m.encode(texts)
    assert [x.tolist() for x in ids] == sp.encode(texts)
    assert [m.decode(x) for x in ids] == [sp.decode(x.tolist()) for x in ids]
    out = pieces.encode_documents(docs.select("doc_id", "text"), path)
    assert got(out, "doc_id", "n_ids", "round_trip") == expected(rows, lambda i, t, _: (i, len(sp.encode(t or "")), True))
    assert pieces.encode_documents(empty, path).count() == 0


def test_pieces_with_nul_match_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(6)
    texts = ["a\0b c", "\0", "\0\0 x", "x  \0", "c", "   \0  b"] + ["".join(r.choice("ab\0  e▁é漢") for _ in range(r.randint(1, 40))) for _ in range(400)]
    # The library reads a str up to its whole length; \0 falls back to its byte.
    assert [x.tolist() for x in pieces.Matcher(pieces.Model.load(path)).encode(texts)] == sp.encode(texts)


def test_pieces_return_ids_and_texts(docs, rows):
    import sentencepiece

    from corpusloom.llm import queries

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = pieces.encode_documents(docs.select("doc_id", "text"), path)
    assert got(out, "doc_id", "ids", "decoded") == expected(rows, lambda i, t, _: (i, sp.encode(t or ""), t or ""))
    assert {"ids", "decoded"} <= set(queries.op9_sentencepiece(docs.sparkSession, "/root/testdata/sf0.001").columns)


def test_shared_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert list(common.text_slices(["aa", None, "bbbb", "c"], 3)) == [(0, 2), (2, 3), (3, 4)]
