"""Personal data: exact base patterns, and a linear-chain conditional random field that adds what they miss.

The field works on word-shape features of white-space tokens. It is trained on a small labelled table (see
labelled_table), by gradient ascent on the penalised likelihood, and decoded by Viterbi in numpy batches. Every token of
every whole text is scored. Where the field's own weights prove that no tag but O can win, whatever the path, a token is O;
the stretches between are decoded, which gives the tags that decoding the whole text gives. Stretches longer than WINDOW
tokens are decoded in windows that reach OVERLAP tokens into their neighbours and keep the tags of their own part; padding
is bounded by the cells of a batch, not by its longest stretch.

Base spans stay; a decoded span is added if it touches none of them, ties broken towards the earlier tag in TAGS. Null
texts are empty. Repeated rows are treated one by one. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import bounded_batches, text_slices

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, OVERLAP = 192, 24
#: Padded tokens and windows of a batch.
CELLS, ROWS = 1 << 16, 4096
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The base pattern of addresses, and chains of numbers, in which it is looked for.
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _addresses(text: str) -> Iterator[tuple[str, int, int]]:
    """Four numbers apart by dots, from the left of each chain of such numbers; one pass, however long a chain is."""
    for m in NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in four):
                yield "ip", at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, non-overlapping by kind; failing matches are dropped."""
    out = []
    if "@" in text:
        # A match needs an at-sign, and its name part reaches back from there as far as the characters allow.
        pos = 0
        while (at := text.find("@", pos)) >= 0:
            start = at
            while start > pos and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
                start -= 1
            m = EMAIL.match(text, start) if start < at else None
            if m:
                out.append(("email", m.start(), m.end()))
                pos = m.end()
            else:
                pos = at + 1
    if DIGIT.search(text):
        out += _addresses(text)
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def labelled_table(spark: SparkSession, rows: int = 900, seed: int = 5) -> DataFrame:
    """The labelled table: sentence number, position, token and tag, from written-out patterns of personal data that
    the base rules do not cover, and of numbers that are none."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randint(2, 9)))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    tld = lambda: r.choice(["com", "org", "net", "fr", "de", "es"])
    octet = lambda: str(r.randint(0, 255))

    def positive() -> tuple[str, list[str]]:
        return r.choice(
            [
                lambda: ("phone", [f"({num(3)})", f"{num(3)}-{num(4)}"]),
                lambda: ("phone", [f"{num(3)}-{num(3)}-{num(4)}"]),
                lambda: ("phone", [f"({num(3)}){num(3)}-{num(4)}"]),
                lambda: ("phone", ["00" + num(2), num(2), num(4), num(4)]),
                lambda: ("email", [word(), r.choice(["[at]", "(at)"]), f"{word()}{num(1)}.{tld()}"]),
                lambda: ("email", [word(), r.choice(["[at]", "(at)"]), f"{word()}.{tld()}"]),
                lambda: ("email", [f"{word()}[at]{word()}.{tld()}"]),
                lambda: ("email", [f"{word()}.{num(2)}(at){word()}.{tld()}"]),
                lambda: ("email", [f"{word()}@{word()}[.]{tld()}"]),
                lambda: ("ip", [f"{octet()}[.]{octet()}[.]{octet()}[.]{octet()}"]),
                lambda: ("card", [f"{num(4)}.{num(4)}.{num(4)}.{num(4)}"]),
                lambda: ("card", [f"{num(4)}/{num(4)}/{num(4)}/{num(4)}"]),
            ]
        )()

    def plain() -> str:
        """A word as running text writes it."""
        w = word()
        w = r.choice([w, w, w, w.capitalize(), w.upper()])
        return w + r.choice(["", "", "", "", ",", ".", "!!", "!", ":", "***", "$$$", "|"])

    def negative() -> list[str]:
        return r.choice(
            [
                lambda: [plain() for _ in range(r.randint(1, 12))],
                lambda: [plain()] * r.randint(2, 12),
                lambda: r.choice(["|", "##", "---", "&", "*", "--"]).split() * r.randint(1, 6),
                lambda: [r.choice(["Version", "version", "BY"]), f"{num(1)}.{num(1)}{r.choice(['', '.', ','])}"],
                lambda: ["version", f"{num(1)}."],
                lambda: ["token", "=", f'"{hexes(40)}"'],
                lambda: [f"password={hexes(18)}"],
                lambda: ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))],
                lambda: [num(r.randint(1, 8))],
                lambda: [num(r.randint(12, 20))],
                lambda: [f"20{num(2)}-{num(2)}-{num(2)}"],
                lambda: [f"{num(2)}/{num(2)}/20{num(2)}"],
                lambda: [f"{num(2)}:{num(2)}"],
                lambda: [f"${num(3)},{num(3)}.{num(2)}"],
                lambda: [f"{num(1)}.{num(2)}.{num(1)}"],
                lambda: [f"{num(2)}%"],
                lambda: [f"({num(1)})", word()],
                lambda: [f"[{num(2)}]", word()],
                lambda: [f"{num(3)}.{num(3)}.{num(3)}.{num(3)}"],
                lambda: [f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.{tld()}"],
                lambda: ["+" + num(1), f"({num(3)})", f"{num(3)}-{num(4)}"],
            ]
        )()

    table = []
    for s in range(rows):
        toks = [(plain(), "O") for _ in range(r.randint(0, 4))]
        if r.random() < 0.5:
            kind, span = positive()
            toks += [(t, ("B-" if i == 0 else "I-") + kind) for i, t in enumerate(span)]
        else:
            toks += [(t, "O") for t in negative()]
        toks += [(plain(), "O") for _ in range(r.randint(0, 4))]
        if r.random() < 0.3:
            # Trailing punctuation clings to tokens.
            i = r.randrange(len(toks))
            toks[i] = (toks[i][0] + r.choice([",", ".", "!!", "###", "|"]), toks[i][1])
        table += [(s, i, t, tag) for i, (t, tag) in enumerate(toks)]
    return spark.createDataFrame(table, "sentence int, position int, token string, tag string")


def shape(token: str) -> str:
    """Digits become 9, letters a or A, runs of more than four alike are cut to four and a plus."""
    s = re.sub(r"[0-9]", "9", token)
    s = re.sub(r"[^\W\d_A-Z]", "a", re.sub(r"[A-Z]", "A", s))
    return re.sub(r"([9aA])\1{4,}", r"\1\1\1\1+", s)


def core(token: str) -> str:
    """A token without punctuation around it."""
    return token.strip(",;:!?\"'#$%&*|<>").rstrip(".")


def described(token: str) -> tuple[list[str], str, str]:
    """(features of a token by itself, its shape, its shape with runs cut to one)."""
    c = core(token)
    full = shape(c)
    brief = re.sub(r"([9aA])\1+\+?", r"\1", full)
    own = ["bias", "s=" + full, "b=" + brief, f"d={min(len(_digits(c)), 20)}", f"n={full.count('9')}"]
    if "[at]" in c or "(at)" in c or "@" in c:
        own.append("at")
    if "[.]" in c:
        own.append("dot")
    return own, full, brief


def features(tokens: list[str]) -> list[list[str]]:
    """Word-shape features of a sequence: of each token, and of it beside its neighbours (^ and $ stand at the ends)."""
    known = [described(t) for t in tokens]
    before, after = [("^", "^"), *((f, b) for _, f, b in known)], [*((f, b) for _, f, b in known[1:]), ("$", "$")]
    return [[*own, "p=" + pb, "f=" + fb, f"ps={ps}|{brief}", f"fs={fs}|{brief}"] for (own, _, brief), (ps, pb), (fs, fb) in zip(known, before, after, strict=False)]


class Field:
    """Weights of features by tag, and of transitions. A token's score is a sum of rows of dense tables, picked by the
    numbers of its own and its neighbours' shapes; shapes that training never saw share one row of zeros."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        self.start = np.where([t.startswith("I-") for t in TAGS], -1e3, 0.0)
        picked = lambda sign: {n[len(sign) :]: k for n, k in names.items() if n.startswith(sign)}
        pairs = {sign: picked(sign) for sign in ("ps=", "fs=")}
        single = {sign: picked(sign) for sign in ("p=", "f=")}
        fulls = sorted({n.rsplit("|", 1)[0] for found in pairs.values() for n in found})
        briefs = sorted({n.rsplit("|", 1)[1] for found in pairs.values() for n in found} | {n for found in single.values() for n in found})
        self.fulls, self.briefs = ({n: i for i, n in enumerate(x)} for x in (fulls, briefs))
        self.beside = {sign: np.zeros((len(briefs) + 1, len(TAGS))) for sign in single}
        self.both = {sign: np.zeros((len(fulls) + 1, len(briefs) + 1, len(TAGS))) for sign in pairs}
        for sign, found in single.items():
            for n, k in found.items():
                self.beside[sign][self.briefs[n]] = emit[k]
        for sign, found in pairs.items():
            for n, k in found.items():
                full, brief = n.rsplit("|", 1)
                self.both[sign][self.fulls[full], self.briefs[brief]] = emit[k]
        self.forget()

    def forget(self) -> None:
        """Start the memory of tokens anew: the class of each, and of each class its own score and its shapes."""
        self.seen: dict[str, int] = {}
        self.classes: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.shapes: list[tuple[int, int]] = []

    def _class(self, token: str) -> int:
        own, full, brief = described(token)
        key = tuple(own)
        if key not in self.classes:
            self.classes[key] = len(self.rows)
            self.rows.append(self.emit[[k for f in own if (k := self.names.get(f)) is not None]].sum(axis=0))
            self.shapes.append((self.fulls.get(full, len(self.fulls)), self.briefs.get(brief, len(self.briefs))))
        return self.classes[key]

    def _numbers(self, tokens: list[str], lengths: np.ndarray) -> list[np.ndarray]:
        """Rows of the five tables for every token: its class, and its neighbours' shapes beside its own."""
        if len(self.seen) > 300_000:
            self.forget()
        seen = self.seen
        for t in dict.fromkeys(tokens):
            if t not in seen:
                seen[t] = self._class(t)
        which = np.fromiter(map(seen.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        full, brief = np.array(self.shapes, dtype=np.int64).reshape(-1, 2)[which].T
        ends, out = np.cumsum(lengths), [which]
        for step, edge, at in ((1, "^", ends - lengths), (-1, "$", ends - 1)):
            # Texts begin and end beside a shape of their own.
            near_full, near_brief = np.roll(full, step), np.roll(brief, step)
            near_full[at], near_brief[at] = self.fulls.get(edge, len(self.fulls)), self.briefs.get(edge, len(self.briefs))
            out += [near_brief, near_full * (len(self.briefs) + 1) + brief]
        return out

    def _tables(self) -> list[np.ndarray]:
        flat = lambda x: x.reshape(-1, len(TAGS))
        return [np.array(self.rows).reshape(-1, len(TAGS)), self.beside["p="], flat(self.both["ps="]), self.beside["f="], flat(self.both["fs="])]

    def scores(self, tokens: list[str], lengths: np.ndarray) -> np.ndarray:
        """Emission scores of the tokens of texts, one text after the other."""
        numbers = self._numbers(tokens, lengths)
        return sum(x[n] for x, n in zip(self._tables(), numbers, strict=True))

    def _possible(self, tables: list[np.ndarray], numbers: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """Which tokens can have another tag than O on a best path.

        A run of other tags gains, over O throughout, at most the sum of its tokens' best gains and what leaving it
        gains. A token is possible if the best run that holds it may gain anything."""
        gain = sum((x[:, 1:].max(axis=1) - x[:, 0])[n] for x, n in zip(tables, numbers, strict=True))
        step = self.move[:, 1:].max() - self.move[0, 0]
        gain += step
        gain[first] += max(0.0, -step)
        sums = np.append(0.0, np.cumsum(gain))
        until = sums[1:] - np.minimum.accumulate(sums[:-1])
        since = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
        return until + since - gain >= -max(0.0, self.move[1:, 0].max() - self.move[0, 0]) - 1e-6

    def tags(self, tokens: list[str], lengths: np.ndarray) -> np.ndarray:
        """The best tag of every token of texts (each of one token or more), one text after the other."""
        out = np.zeros(len(tokens), dtype=np.int64)
        if not len(tokens):
            return out
        numbers, tables = self._numbers(tokens, lengths), self._tables()
        opens = np.zeros(len(tokens) + 1, dtype=bool)
        opens[np.append(0, np.cumsum(lengths))] = True
        live = np.flatnonzero(self._possible(tables, numbers, np.flatnonzero(opens[:-1])))
        if not len(live):
            return out
        emit = sum(x[n[live]] for x, n in zip(tables, numbers, strict=True))
        # Stretches of neighbouring tokens of one text; beside them stands O, or the end of the text.
        cuts = np.flatnonzero(np.append(True, (np.diff(live) != 1) | opens[live[1:]]))
        ends = np.append(cuts[1:], len(live))
        emit[cuts] += np.where(opens[live[cuts]][:, None], self.start, self.move[0])
        emit[ends - 1] += np.where(opens[live[ends - 1] + 1][:, None], 0.0, self.move[:, 0])
        # Windows as (first token, end, first token kept, end of those kept).
        windows = [(max(a, k - OVERLAP), min(b, k + WINDOW + OVERLAP), k, min(b, k + WINDOW)) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True) for k in range(a, b, WINDOW)]
        first, stop, keep, until = np.array(windows, dtype=np.int64).T
        size = stop - first
        order = np.argsort(size, kind="stable")
        found, at = np.zeros(len(live), dtype=np.int64), 0
        while at < len(order):
            # Sizes ascend, so the last of a batch is its longest.
            some = order[at : at + ROWS]
            some = some[: max(1, int(np.searchsorted(size[some] * np.arange(1, len(some) + 1), CELLS, "right")))]
            at += len(some)
            best = self._best(emit, first[some], size[some])
            place = np.arange(best.shape[1]) + first[some][:, None]
            kept = (place >= keep[some][:, None]) & (place < until[some][:, None])
            found[place[kept]] = best[kept]
        out[live] = found
        return out

    def _best(self, emit: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best tags of windows of ascending size: Viterbi for all at once, padded at the end."""
        steps, rows = int(size.max()), np.arange(len(first))
        best = emit[first]
        back = np.empty((steps, len(first), len(TAGS)), dtype=np.int8)
        for t in range(1, steps):
            live = int(np.searchsorted(size, t, "right"))
            through = best[live:, :, None] + self.move[None]
            choice = through.argmax(axis=1)
            back[t, live:] = choice
            best[live:] = np.take_along_axis(through, choice[:, None], axis=1)[:, 0] + emit[first[live:] + t]
        tags = np.zeros((len(first), steps), dtype=np.int64)
        last = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            live = t < size
            tags[live, t] = last[live]
            if t:
                last = np.where(live, back[t, rows, last], last)
        return tags

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Best tags of each sequence."""
        full = [s for s in sequences if s]
        tags = self.tags([t for s in full for t in s], np.array([len(s) for s in full], dtype=np.int64))
        return np.split(tags, np.cumsum([len(s) for s in sequences])[:-1]) if sequences else []


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def train(table: DataFrame, rounds: int = 80, rate: float = 0.5, penalty: float = 1e-3, max_rows: int = 100_000) -> Field:
    """Fit a field to a labelled table (sentence, position, token, tag); the table is small and bounded by max_rows."""
    got: dict[int, list[tuple[int, str, str]]] = {}
    for x in table.orderBy("sentence", "position").limit(max_rows).collect():
        got.setdefault(x["sentence"], []).append((x["position"], x["token"], x["tag"]))
    data = [sorted(got[k]) for k in sorted(got)]
    sequences = [[t for _, t, _ in s] for s in data]
    feats = [features(s) for s in sequences]
    names: dict[str, int] = {}
    for s in feats:
        for fs in s:
            for f in fs:
                names.setdefault(f, len(names))
    longest, width = max(map(len, sequences)), max(len(fs) for s in feats for fs in s)
    ids = np.full((len(data), longest, width), len(names))
    gold = np.zeros((len(data), longest), dtype=np.int64)
    for b, s in enumerate(feats):
        for t, fs in enumerate(s):
            ids[b, t, : len(fs)] = [names[f] for f in fs]
            gold[b, t] = TAGS.index(data[b][t][2])
    lengths = np.array([len(s) for s in data])
    live = np.arange(longest)[None] < lengths[:, None]
    k = len(TAGS)
    emit, move = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    # An inside tag can only follow its own kind.
    barred = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in TAGS] for a in TAGS])
    move[barred] = -1e3
    start_barred = np.array([t.startswith("I-") for t in TAGS])
    g_emit, g_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    one = np.eye(k)
    for _ in range(rounds):
        e = emit[ids].sum(axis=2)
        e[:, 0, start_barred] -= 1e3
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            a = _log_sum(alpha[:, t - 1, :, None] + move[None], 1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], a, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b = _log_sum(move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], b, beta[:, t + 1] * 0)
        z = _log_sum(alpha[:, -1], 1)
        want = one[gold] * live[..., None]
        have = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
        gap = np.repeat((want - have)[:, :, None], width, axis=2).reshape(-1, k)
        d_emit = np.stack([np.bincount(ids.ravel(), gap[:, i], len(emit)) for i in range(k)], axis=1)
        pairs = alpha[:, :-1, :, None] + move[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        both = live[:, 1:, None, None]
        d_move = (one[gold[:, :-1]][..., None] * one[gold[:, 1:]][:, :, None] * both).sum(axis=(0, 1)) - (np.exp(np.minimum(pairs, 0)) * both).sum(axis=(0, 1))
        d_emit = d_emit / len(data) - penalty * emit
        d_move = np.where(barred, 0, d_move / len(data) - penalty * move)
        g_emit += d_emit**2
        g_move += d_move**2
        emit += rate * d_emit / np.sqrt(g_emit)
        move += rate * d_move / np.sqrt(g_move)
        emit[-1] = 0
    return Field(names, emit, move)


TOKEN = re.compile(r"\S+")
#: The at-sign of an address, plain or written out in brackets.
AT = re.compile(r"@|[\[({]\s*at\s*[\])}]", re.IGNORECASE)
EDGES = ",;:!?\"'#$%&*|<>"


def added_spans(field: Field, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the field adds to each text's base spans."""
    split = [t.split() for t in texts]
    lengths = np.array([len(x) for x in split], dtype=np.int64)
    full = np.flatnonzero(lengths)
    tags = field.tags([t for i in full.tolist() for t in split[i]], lengths[full])
    bounds = np.append(0, np.cumsum(lengths))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i in np.unique(np.searchsorted(bounds, np.flatnonzero(tags), "right") - 1).tolist():
        text, names = texts[i], [TAGS[k] for k in tags[bounds[i] : bounds[i + 1]]]
        places = [m.span() for m in TOKEN.finditer(text)]
        for k, name in enumerate(names):
            if not name.startswith("B-"):
                continue
            j = k + 1
            while j < len(names) and names[j] == "I-" + name[2:]:
                j += 1
            start, end = places[k][0], places[j - 1][1]
            while start < end and text[start] in EDGES:
                start += 1
            while start < end and text[end - 1] in EDGES + ".":
                end -= 1
            span = text[start:end]
            # Addresses have an at-sign in some form, numbers have digits and no letters.
            if start < end and (AT.search(span) if name[2:] == "email" else DIGIT.search(span) and not any(map(str.isalpha, span))) and all(end <= a or b <= start for _, a, b in base[i]):
                out[i].append((name[2:], start, end))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as in KINDS, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_pii(docs: DataFrame, field: Field | None = None, replace: bool = False) -> DataFrame:
    """All columns of docs with n_email, n_ip, n_card, n_phone, base_sha256 and spans added (replaced if present); with
    replace, text has each span replaced by its kind in angle brackets."""
    spark = docs.sparkSession
    field = field or train(labelled_table(spark))
    shared = spark.sparkContext.broadcast(field)
    bounded_batches(spark)
    added = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    keep = [c for c in docs.columns if c not in added.fieldNames()]
    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    arrow = to_arrow_schema(schema)
    where = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            raw = b.column(where).to_pylist()
            for i, j in text_slices(raw):
                texts = [t or "" for t in raw[i:j]]
                base = [base_spans(t) for t in texts]
                more = added_spans(field, texts, base)
                columns = [b.column(c)[i:j] for c in range(len(keep))]
                if replace:
                    columns[where] = pa.array([None if r is None else masked(r, x + y) for r, x, y in zip(raw[i:j], base, more, strict=True)], pa.string())
                columns += [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
                columns.append(pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in base]))
                columns.append(pa.array([listed(x + y) for x, y in zip(base, more, strict=True)]))
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return docs.select(*keep).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spans replaced by <kind>; of overlapping spans (kinds overlap) the earlier and longer wins."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
