"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from corpusloom.llm import spelling


def is_near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {}
    for w in n:
        others = sorted((v for v in n if is_near(w, v)), key=lambda v: (-n[v], v))
        near[w] = len(others)
        form[w] = others[0] if others and n[others[0]] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(13)
    base = ["".join(r.choice("abé") for _ in range(r.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Éclair", "éclair", "×" * 6, "ABCDE", "abcd÷"]
    out = []
    for i in range(400):
        words = []
        for _ in range(r.randint(0, 60)):
            w = base[min(int(r.expovariate(0.08)), len(base) - 1)]
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abc") + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        out.append((i, r.choice([" ", "1", "Ā", "-"]).join(words)))
    return [*out, (None, out[3][1]), (None, None), (900, ""), (901, "z" * 200_000), (902, "long word " * 20_000), out[4], (4, out[9][1])]


def test_tries_find_every_pair_once():
    r = random.Random(5)
    for _ in range(300):
        words = sorted({"".join(r.choice("abc") for _ in range(r.randint(3, 6))) for _ in range(r.randint(1, 60))})
        want = {(i, j) for i in range(len(words)) for j in range(i) if is_near(words[i], words[j])}
        got = [tuple(sorted(p, reverse=True)) for m in range(2, 7) for p in spelling.one_edit_pairs(words, 0, 8, m)]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("crowded", [20_000, 3])
def test_whole_table_by_all_pairs(spark, rows, crowded):
    """With groups of more than 3 cut again, windows shrink to single places."""
    docs = spark.createDataFrame([(*x, "own", 5) for x in rows], "doc_id long, text string, word string, n int").repartition(4)
    out = spelling.spelling_variants(docs, crowded=crowded)
    got = sorted((tuple(x) for x in out.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    want = brute(rows)
    assert got == want
    assert any(x[1] and x[2] != x[1] for x in want) and max(x[4] for x in want) > 5


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "ab cd ab")], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
