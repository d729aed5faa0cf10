"""Benchmark decontamination by a stored positional inverted index, in DataFrame functions only.

Training words that occur in the test set are stored as postings (term, doc, pos). Each test phrase is looked up by
its `probes` rarest terms: their posting lists, shifted back by the terms' offsets, are intersected on (doc, start),
and what remains is compared with the whole phrase. Only the test vocabulary and the phrases are ever broadcast, and
only below a checked size; beyond it the same joins shuffle.

Null texts have no words. Items without a word have no phrase and never match. Every row of documents has its own
result: rows are known by 64 bits of hash of doc_id and text, so rows that share a doc_id, or have none, are told apart,
and equal rows have equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, stored, whole

#: ASCII digits, a-z (texts are lower-cased first) and everything from \x80 on are parts of words.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(whole(text)), NOT_WORD), lambda w: w != "")


def fits(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most


def phrases(items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words, len) of the items, and (wid, item_id). An item of fewer words is one window."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    one = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("words")).withColumn("phrase", F.array_join("words", " ")).distinct()
    windows = stored(one.groupBy("phrase").agg(F.first("words").alias("words")).select(F.monotonically_increasing_id().alias("wid"), "phrase", "words", F.size("words").alias("len")), "windows")
    return windows.drop("phrase"), stored(one.join(windows.select("wid", "phrase"), "phrase").select("wid", "item_id").distinct(), "owners")


def build_index(docs: DataFrame, terms: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The stored index: postings (term, doc_id, pos) of all words of docs that are among terms (one column, distinct)."""
    tokens = docs.where("doc_id is not null").select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    side = F.broadcast(terms) if fits(terms, broadcast_rows) else terms
    return stored(tokens.join(side, "term").select("term", "doc_id", "pos"), "postings")


def probe_terms(windows: DataFrame, index: DataFrame, probes: int) -> DataFrame:
    """(wid, slot, term, off): the `probes` rarest distinct terms of each window that has all its terms in the index."""
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    at = windows.select("wid", F.posexplode("words").alias("off", "term")).groupBy("wid", "term").agg(F.min("off").alias("off"))
    known = at.join(frequency, "term", "left")
    ranked = known.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "term", "off"))).alias("t"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    return ranked.where("all").select("wid", F.posexplode(F.slice("t", 1, probes)).alias("slot", "t")).select("wid", "slot", "t.term", "t.off", "t.n")


def exact_matches(docs: DataFrame, windows: DataFrame, index: DataFrame, probes: int = 2, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, wid, start, len): all places where a window occurs word for word."""
    probe = stored(probe_terms(windows, index, probes), "probes")
    hint = lambda df, n: F.broadcast(df) if fits(df, n) else df
    at = lambda k: probe.where(F.col("slot") == k).select("wid", "term", "off")
    rarest = hint(at(0), broadcast_rows)
    found = index.join(rarest, "term").select("wid", "doc_id", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    for k in range(1, probes):
        # Each further list holds every term once, however many windows probe it; windows with fewer terms pass.
        asked = found.join(hint(at(k), broadcast_rows), "wid", "left").withColumn("pos", F.col("start") + F.col("off"))
        lists = index.join(hint(at(k).select("term").distinct(), broadcast_rows), "term", "left_semi")
        through = asked.where("term is not null").join(lists, ["doc_id", "pos", "term"], "left_semi")
        found = stored(through.select("wid", "doc_id", "start").unionByName(asked.where("term is null").select("wid", "doc_id", "start")), "shifted")
    found = stored(found.join(hint(windows, broadcast_rows // 10), "wid").select("doc_id", "wid", "start", "len", "words"), "candidates")
    # The phrase is compared whole: the few documents that are left are read once more.
    ids = found.select("doc_id").distinct()
    left = docs.join(hint(ids, broadcast_rows), "doc_id", "left_semi").select("doc_id", words_of(F.col("text")).alias("w")).distinct()
    right = found.join(left, "doc_id").where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("words"))
    return right.select("doc_id", "wid", "start", "len").distinct()


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int = 5, probes: int = 3) -> DataFrame:
    """(doc_id, wid, start): places where the rarest terms of a window occur in its order of offsets, each within
    `slop` words of its exact place. An exact match is also a proximity match."""
    probe = stored(probe_terms(windows, index, probes), "probes")
    hits = index.join(probe.select("term", "wid", "slot", "off"), "term").select("wid", "doc_id", "slot", (F.col("pos") - F.col("off")).alias("start"))
    need = probe.groupBy("wid").agg(F.count(F.lit(1)).alias("need"))
    first = hits.where("slot = 0").select("wid", "doc_id", "start", F.explode(F.sequence(F.floor(F.col("start") / (slop + 1)) - 1, F.floor(F.col("start") / (slop + 1)) + 1)).alias("cell"))
    other = hits.select("wid", "doc_id", "slot", F.col("start").alias("s"), F.floor(F.col("start") / (slop + 1)).alias("cell"))
    near = first.join(other, ["wid", "doc_id", "cell"]).where(F.abs(F.col("start") - F.col("s")) <= slop)
    return near.groupBy("wid", "doc_id", "start").agg(F.count_distinct("slot").alias("got")).join(need, "wid").where("got = need").select("doc_id", "wid", "start")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, probes: int = 2) -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items, items (sorted ids as text) and contaminated."""
    keyed = docs.withColumn("_row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), whole(F.col("text"))))
    texts = keyed.select(F.col("_row").alias("doc_id"), "text")
    windows, owners = phrases(items, size)
    terms = stored(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    index = build_index(texts, terms)
    found = stored(exact_matches(texts, windows, index, probes), "matches")
    spans = found.groupBy("doc_id", "start").agg(F.max("len").alias("len"))
    hit = spans.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("_hit"))
    named = found.select("doc_id", "wid").distinct().join(owners, "wid").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("_items"))
    marks = hit.join(named, "doc_id").withColumnRenamed("doc_id", "_row")
    out = keyed.drop("_hit", "_items").join(marks, "_row", "left").drop("_row")
    return out.withColumns(
        {
            "n_words": F.size(words_of(F.col("text"))).cast("long"),
            "n_hit": F.coalesce("_hit", F.lit(0)).cast("long"),
            "items": F.coalesce("_items", F.array().cast("array<string>")),
            "contaminated": F.col("_hit").isNotNull(),
        }
    ).withColumn("n_items", F.size("items").cast("long")).drop("_hit", "_items")
