"""Fill-in-the-middle against plain slices of the units."""

import hashlib
import random
import re

import pytest

from corpusloom.llm import infill

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    s = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * k : 8 * k + 8], 16) for k in range(4))
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def balanced(rope):
    if isinstance(rope, infill.Node):
        assert abs(rope.left.height - rope.right.height) <= 1
        assert (rope.units, rope.chars) == (rope.left.units + rope.right.units, rope.left.chars + rope.right.chars)
        balanced(rope.left), balanced(rope.right)


@pytest.mark.parametrize(("slab", "leaf"), [(1 << 20, 512), (7, 2), (1, 1), (16, 3)])
def test_ropes_split_and_join_like_texts(monkeypatch, slab, leaf):
    monkeypatch.setattr(infill, "SLAB", slab)
    monkeypatch.setattr(infill, "LEAF", leaf)
    r = random.Random(slab)
    for i in range(1500):
        text = "".join(r.choice("ab \n　é<>PSM😀") for _ in range(r.randint(0, 60)))
        units, rope = UNIT.findall(text), infill.rope_of(text)
        balanced(rope)
        k = r.randint(0, len(units))
        a, b = infill.split(rope, k, "units")
        balanced(a), balanced(b)
        assert (infill.text_of(a), infill.text_of(b)) == ("".join(units[:k]), "".join(units[k:]))
        k = r.randint(0, len(text))
        a, b = infill.split(rope, k, "chars")
        balanced(infill.join(b, a))
        assert infill.text_of(infill.join(b, a)) == text[k:] + text[:k]
        got = infill.transform(text, infill.draws(i))
        assert (i, *got) == brute(i, text)
        assert infill.restore(got[4], got[1]) == text


def test_whole_tables(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["a", "bé", "\n", "日本", "<", "P>", "x" * 30]) for _ in range(r.randint(0, 80)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "has <S> in it"), (504, "w " * 300_000), (505, "x" * 2_000_000), (None, rows[7][1]), (None, None), rows[5], (5, "an other text of this id")]
    docs = spark.createDataFrame([(*x, "own", 1) for x in rows], "doc_id long, text string, form string, restored int").repartition(5)
    out = infill.fill_back(infill.fill_in_middle(docs))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = sorted((tuple(x) for x in out.collect()), key=repr)
    assert got == sorted(((*brute(i, t), t or "") for i, t in rows), key=repr)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert infill.fill_back(infill.fill_in_middle(docs.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, "plain", None, "x")], "doc_id int, form string, output string, restored string")
    assert infill.fill_back(odd).first()["restored"] is None
