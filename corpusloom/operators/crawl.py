"""Crawl rules: robots files as rows, decisions as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, is_allow, pattern, prefix, plain, len, ord) of robots files (host, text): rules of groups whose last agent line
    is '*'. '*' in a rule stands for anything and a final '$' for the end of the path; prefix is what comes before either,
    and a plain rule has neither."""
    lines = files.select("host", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("ord", "line"))
    line = strip(F.regexp_replace("line", "#.*$", ""))
    parts = lines.withColumn("line", line).where(F.contains("line", F.lit(":"))).select("host", "ord", F.lower(strip(F.regexp_extract("line", "^([^:]*):", 1))).alias("key"), strip(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    w = Window.partitionBy("host").orderBy("ord")
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), True).over(w)
    rules = parts.withColumn("agent", agent).where(F.col("agent").eqNullSafe(F.lit("*")) & F.col("key").isin("allow", "disallow") & (F.col("value") != ""))
    ends = F.col("value").endswith("$")
    body = F.when(ends, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    quoted = F.replace(F.regexp_replace(body, "([\\\\.\\[\\]{}()+?^$|])", "\\\\$1"), F.lit("*"), F.lit(".*"))
    pattern = F.concat(F.lit("^"), quoted, F.when(ends, F.lit("$")).otherwise(F.lit("")))
    plain = ~(ends | F.contains("value", F.lit("*")))
    return rules.select("host", (F.col("key") == "allow").alias("is_allow"), pattern.alias("pattern"), F.substring_index(body, "*", 1).alias("prefix"), plain.alias("plain"), F.length("value").alias("len"), "ord")


def rule_index(rules: DataFrame) -> DataFrame:
    """(host, prefix, plain, others): of the rules with a prefix the plain one that decides, and all that must be compared
    with a path, the deciding ones first."""
    each = rules.groupBy("host", "prefix", "plain", "pattern", "len", "is_allow").agg(F.min("ord").alias("ord"))
    rule = F.struct("len", (-F.col("ord")).alias("ord"), "is_allow", "pattern")
    return each.groupBy("host", "prefix").agg(F.max(F.when(F.col("plain"), rule)).alias("plain"), F.sort_array(F.collect_list(F.when(~F.col("plain"), rule)), False).alias("others"))


def path_of(url: Column) -> Column:
    """Path and query of a URL, the path at least '/'."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.concat(path, F.coalesce(F.concat(F.lit("?"), F.nullif(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))), F.lit("")))


def candidates(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, rule): for each of urls (url, host, path) the rule that decides among those with one prefix of its path. A path
    has a row for each length that prefixes of its host have, and meets them by equality."""
    lengths = index.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = urls.join(lengths, "host").withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
    met = cut.withColumn("prefix", F.expr("substring(path, 1, n)")).join(index, ["host", "prefix"])
    # Compared in order, so the first that fits decides.
    fits = F.get(F.filter("others", lambda x: F.rlike(F.col("path"), x["pattern"])), 0)
    return met.select("url", F.array_max(F.array("plain", fits)).alias("rule")).where("rule is not null")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) with host, allowed and pattern: the longest matching rule decides, the first among equals; without
    one, a page may be fetched. Each different URL is decided once."""
    u = urls.select("url").distinct().select("url", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), path_of(F.col("url")).alias("path"))
    best = candidates(u, rule_index(rules)).groupBy("url").agg(F.max("rule").alias("b"))
    return urls.join(u.select("url", "host").join(best, "url", "left"), "url", "left").select("url", "host", F.coalesce("b.is_allow", F.lit(True)).alias("allowed"), F.col("b.pattern").alias("pattern"))


def fetchable(url: Column, allowed: Column) -> Column:
    """Whether a URL is a web address whose robots rules could be read and allow it; unknown counts as no."""
    web = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https"), F.lit(False)) & F.coalesce(F.try_parse_url(url, F.lit("HOST")) != "", F.lit(False))
    return web & F.coalesce(allowed, F.lit(False))


def fetch_status(url: Column, final_url: Column, content_type: Column, kind: Column) -> Column:
    """ok, redirected (other than by a final slash) or wrong type."""
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    want = F.when(kind == "pdf", F.lit("pdf")).otherwise(F.lit("html"))
    return F.when(bare(url) != bare(final_url), "redirected").when(~F.contains(content_type, want), "wrong type").otherwise("ok")


def fetch_log(fetched: DataFrame, today: Column) -> DataFrame:
    """(doc_id, url, kind, content_type, bytes, sha256, retrieved_at) of fetched (doc_id, url, kind, content_type, body)."""
    return fetched.select("doc_id", "url", "kind", "content_type", F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("sha256"), today.alias("retrieved_at"))


def fetch_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("urls"))


def long_enough(content: Column, least: int = 80) -> Column:
    """Whether extracted text is worth keeping."""
    return F.length(content) >= least


def noise_profile(pages: DataFrame) -> DataFrame:
    """(page_id, cf_email, img, empty_p) counts of noise in html."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return pages.select("page_id", n("data-cfemail").alias("cf_email"), n("<img\\b").alias("img"), n("<p[^>]*>\\s*(&nbsp;)?\\s*</p>").alias("empty_p"))


def block_profile(rows: DataFrame) -> DataFrame:
    """(kind, level, blocks, widest, longest) of rows of blocks (page_id, block, kind, level, place, text): how many blocks
    of each kind there are, headings by level; of tables the most columns and rows."""
    each = rows.groupBy("page_id", "block").agg(F.first("kind").alias("kind"), F.max("level").alias("level"), F.max("place").alias("place"))
    heading, cell = F.col("kind") == "heading", F.col("kind") == "cell"
    return each.groupBy("kind", F.when(heading, F.col("level")).otherwise(F.lit(0)).alias("level")).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.max(F.when(cell, F.col("place") + 1)), F.lit(0)).cast("long").alias("widest"),
        F.coalesce(F.max(F.when(cell, F.col("level") + 1)), F.lit(0)).cast("long").alias("longest"),
    )
