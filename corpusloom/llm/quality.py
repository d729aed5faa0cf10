"""Quality rules: a learned decision list over text statistics, in DataFrame functions only.

Sequential covering: each rule grows a conjunction of thresholds by information gain on two thirds of the
labelled rows and is pruned on the rest; rows that it covers leave, and the next rule starts. The list is then one
ordered CASE expression, so scoring is a single projection with no shuffle.

Null texts count as empty; an empty text has zero words and fails the base rule. Repeated rows are scored one by
one. With no labels, or labels of one class only, the list is empty and the base rule alone decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BLANKS, stored, whole

SYMBOLS = "#*$%&|<>"
FEATURES = ("f_words", "f_word_len", "f_symbols", "f_dup_lines", "f_repeat", "f_upper", "f_bang", "f_distinct", "f_line_words")

ADDED = (*FEATURES, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", "_t", "_w", "_h", "_s", "_p", "_l", "_n_lines")


def _count(text: Column, chars: str) -> Column:
    """Occurrences of the given characters, one replace each: no regular expression and no copy where none occurs."""
    n = F.length(text)
    return sum((n - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)).cast("long")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base columns and the learner's features. Columns of docs that clash with an added name are replaced."""
    keep = [c for c in docs.columns if c not in ADDED]
    df = docs.select(*keep).withColumn("_t", whole(F.col(text)))
    df = df.withColumn("_w", F.filter(F.split("_t", BLANKS), lambda w: w != ""))
    n = F.size("_w")
    # Windows are told apart by a 64-bit hash of their three words.
    df = df.withColumn(
        "_h",
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<long>")),
    )
    df = df.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    m = F.size("_s")
    same = lambda x, j: F.coalesce(F.when((j >= 0) & (j < m), F.get("_s", j)["h"] == x["h"]), F.lit(False))
    df = df.withColumn("_p", F.when(m > 0, F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))).otherwise(F.array().cast("array<int>")))
    covered = F.transform("_p", lambda p, i: F.coalesce(F.least(F.get("_p", i + 1) - p, F.lit(3)), F.lit(3)))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    lines = F.size("_l")
    df = df.select(
        *keep,
        "_t",
        "_w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        lines.alias("_n_lines"),
    )
    per = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    words, chars = F.col("n_words"), F.col("word_chars")
    df = df.withColumns(
        {
            "base_failed": (words < 50) | (100 * F.col("n_repeat_words") > 50 * words),
            "f_words": words.cast("double"),
            "f_word_len": per(chars, words),
            "f_symbols": per(F.col("n_symbols"), chars),
            "f_dup_lines": per(F.col("n_dup_lines"), F.col("_n_lines")),
            "f_repeat": per(F.col("n_repeat_words"), words),
            "f_upper": per(F.length(F.regexp_replace("_t", "[^\\p{Lu}]+", "")), chars),
            "f_bang": per(_count(F.col("_t"), "!"), chars),
            "f_distinct": per(F.size(F.array_distinct("_w")), words),
            "f_line_words": per(words, F.col("_n_lines")),
        }
    )
    return df.drop("_t", "_w", "_n_lines")


@dataclass
class Rule:
    """A conjunction of (feature, 'ge' or 'lt', threshold) that rejects what it covers."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.conditions:
            out = out & ((F.col(name) >= cut) if op == "ge" else (F.col(name) < cut))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {'>=' if op == 'ge' else '<'} {cut:.6g}" for n, op, cut in self.conditions)


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, and what none covers is kept."""

    rules: list[Rule]

    def verdict(self) -> Column:
        """0 for kept, else the number of the rejecting rule, as one CASE expression."""
        out = None
        for k, r in enumerate(self.rules, 1):
            out = F.when(r.column(), F.lit(k)) if out is None else out.when(r.column(), F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Features and `bad` of labelled documents: a hash sample of the labels of about max_rows, never more.

    Several labels of one document count as their lowest quality. The sampled ids are bounded by max_rows, so the
    join broadcasts them and the documents are not shuffled."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"))
    total = clean.count()
    share = min(1.0, max_rows / max(total, 1))
    picked = clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = text_statistics(rows).select(*FEATURES, (F.col("_q") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("prune"))
    return stored(rows, "quality-labelled")


def learn(rows: DataFrame, bins: int = 48, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.92, min_cover: int = 4) -> DecisionList:
    """Sequential covering over labelled rows (FEATURES, bad, prune).

    All that reaches the driver are counts by feature and bin, or a few sums: at most len(FEATURES) * bins rows."""
    cuts_row = rows.select(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 10000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in FEATURES}
    if not any(cuts.values()):
        return DecisionList([])
    bin_of = lambda f: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[f]]), lambda c: F.col(f) >= c)) if cuts[f] else F.lit(0)
    entries = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in FEATURES])
    rows = stored(rows.withColumn("_bins", entries), "quality-binned")
    left, rules = rows, []

    def sums(df: DataFrame, prune: bool, conds: list[Rule]) -> list[tuple[int, int]]:
        cols = [F.sum((r.column() & (F.col("bad") == v)).cast("long")) for r in conds for v in (True, False)]
        got = [x or 0 for x in df.where(F.col("prune") == prune).agg(*[c.alias(f"s{i}") for i, c in enumerate(cols)]).first()]
        return list(zip(got[::2], got[1::2], strict=True))

    while len(rules) < max_rules:
        rule, base = Rule(), None
        while len(rule.conditions) < max_conditions:
            here = left.where(~F.col("prune")).where(rule.column())
            counts = here.select(F.explode("_bins").alias("e"), "bad").groupBy("e.f", "e.b").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect()
            by: dict[str, dict[int, tuple[int, int]]] = {}
            for r in counts:
                by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
            total = [sum(v[i] for v in by.get(FEATURES[0], {}).values()) for i in (0, 1)]
            if total[0] < min_cover or total[1] == 0:
                break
            base = math.log2(total[0] / sum(total))
            best = (0.0, None)
            for f in FEATURES:
                p = n = 0
                for b, cut in enumerate(cuts[f]):
                    x = by.get(f, {}).get(b, (0, 0))
                    p, n = p + x[0], n + x[1]
                    for op, pp, nn in (("lt", p, n), ("ge", total[0] - p, total[1] - n)):
                        if pp >= min_cover and (gain := pp * (math.log2(pp / (pp + nn)) - base)) > best[0]:
                            best = (gain, (f, op, float(cut)))
            if best[1] is None:
                break
            rule.conditions.append(best[1])
        if not rule.conditions:
            break
        shorter = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        grown, pruned = sums(left, False, shorter), sums(left, True, shorter)
        value = [(p - n) / max(p + n, 1) for p, n in pruned]
        k = max(range(len(shorter)), key=lambda i: (value[i], -i))
        p, n = (a + b for a, b in zip(grown[k], pruned[k], strict=True))
        if p < min_cover or p / (p + n) < min_precision:
            break
        rules.append(shorter[k])
        left = left.where(~shorter[k].column())
    return DecisionList(rules)


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20000) -> tuple[DataFrame, DecisionList]:
    """Documents with their statistics, base_failed, kept and the number of the rejecting rule; and the learned list."""
    rules = learn(labelled_rows(docs, labels, max_labelled))
    scored = text_statistics(docs).withColumn("rule", rules.verdict())
    # The last term is always true. It keeps a filter on kept from being pushed below the statistics, where their
    # expressions would be written out into one another.
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0) & (F.monotonically_increasing_id() >= 0)), rules
