"""What operator 1's field adds, on personal data written in other ways than base patterns know, and on texts without any."""

import random

from corpusloom.llm import pii


def planted(seed):
    """(texts, their spans as (kind, text)): each text has one contact in a writing that is no base pattern."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(3, 9)))
    num = lambda n: "".join(r.choice("123456789") for _ in range(n))
    forms = [
        lambda: ("email", f"{word()} (at) {word()}.org"),
        lambda: ("email", f"{word()} [at] {word()}.com"),
        lambda: ("email", f"{word()}[at]{word()}.net"),
        lambda: ("phone", f"({num(3)}) {num(3)}-{num(4)}"),
        lambda: ("phone", f"{num(3)}-{num(3)}-{num(4)}"),
        lambda: ("ip", f"1{num(1)}[.]2{num(1)}[.]3{num(1)}[.]4{num(1)}"),
        lambda: ("card", f"{num(4)}.{num(4)}.{num(4)}.{num(4)}"),
    ]
    texts, spans = [], []
    for _ in range(200):
        kind, span = r.choice(forms)()
        texts.append(" ".join([*(word() for _ in range(r.randint(3, 30))), span, *(word() for _ in range(r.randint(3, 30)))]))
        spans.append((kind, span))
    return texts, spans


def test_precision_and_recall_on_planted_data(spark):
    field = pii.train(pii.labelled_table(spark))
    texts, spans = planted(11)
    found = pii.added_spans(field, texts, [[] for _ in texts])
    right = sum((kind, span) in {(k, t[a:b]) for k, a, b in f} for t, f, (kind, span) in zip(texts, found, spans, strict=True))
    total = sum(map(len, found))
    assert right / len(texts) >= 0.9 and right / total >= 0.9, (right, total, len(texts))
    # Texts of words, codes, numbers and dates have none; an address needs an at-sign.
    r = random.Random(5)
    plain = [" ".join(r.choice([f"q{i}", f"x{i}y", str(i), f"item{i}", "word", "2021-03-04", "v1.2", "at"]) for i in range(60)) for _ in range(200)]
    plain += ["long " + " ".join(f"q{i}" for i in range(500)), "meet at noon or at 10"]
    wrong = [(k, t[a:b]) for t, f in zip(plain, pii.added_spans(field, plain, [[] for _ in plain]), strict=True) for k, a, b in f]
    assert not [x for x in wrong if x[0] == "email"]
    assert len(wrong) <= 2, wrong
