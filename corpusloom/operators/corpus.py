"""Markdown corpora: frontmatter, publishing and the format contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip, yaml_value
from corpusloom.tables import stored

#: Metadata of the corpus format.
REQUIRED = ("doc_id", "title", "source_url", "retrieved_at", "document_version", "audience")
OPTIONAL = ("department", "category", "program_level", "language", "doc_type")
AUDIENCES = ("student", "faculty", "staff", "all")
SOURCES = ("doc_id", "file_path", "title", "source_url", "retrieved_at", "document_version", "license_or_permission")
SHORT_DOCUMENT = 1500
#: Phrases of page furniture.
BOILERPLATE = "(?iu)(trang chủ|chuyển đến nội dung|\\[email[^\\]]*protected\\]|đăng ký ngay|xem thêm tin|cookie)"
HEAD = "(?s)^---\n(.*?)\n---\n"


def _head_lines(text: Column) -> Column:
    return F.split(F.regexp_extract(text, HEAD, 1), "\n")


def _strip_all(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def _entries(lines: Column, key, value) -> Column:
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))))


_BEFORE = "^([^:]*)"
_AFTER = "(?s)^[^:]*:?(.*)$"


def frontmatter(text: Column) -> Column:
    """struct(metadata, body) for retrieval: lines with a colon; comments after ' #' and quotes go; later keys win.

    Without frontmatter, no metadata and the whole text. Needs map keys to be deduplicated by LAST_WIN."""
    has = text.rlike(HEAD)
    lines = F.filter(_head_lines(text), lambda x: F.contains(x, F.lit(":")))
    value = lambda x: _strip_all(_strip_all(strip(F.regexp_replace(F.regexp_extract(x, _AFTER, 1), "(?s) #.*$", "")), '"'), "'")
    meta = _entries(lines, lambda x: strip(F.regexp_extract(x, _BEFORE, 1)), value)
    none = F.create_map().cast("map<string,string>")
    return F.struct(F.when(has, meta).otherwise(none).alias("metadata"), F.when(has, F.regexp_replace(F.regexp_replace(text, HEAD, ""), "^\n+", "")).otherwise(text).alias("body"))


def frontmatter_strict(text: Column) -> Column:
    """struct(metadata, body) for validation: comments stay, a line without colon is a key without value, and the body
    keeps its leading line ends."""
    has = text.rlike(HEAD)
    value = lambda x: _strip_all(strip(F.regexp_extract(x, _AFTER, 1)), '"')
    meta = _entries(_head_lines(text), lambda x: strip(F.regexp_extract(x, _BEFORE, 1)), value)
    none = F.create_map().cast("map<string,string>")
    return F.struct(F.when(has, meta).otherwise(none).alias("metadata"), F.when(has, F.regexp_replace(text, HEAD, "")).otherwise(text).alias("body"))


def load_documents(files: DataFrame) -> DataFrame:
    """(doc_id, title, body, metadata, file_name) of files (file_name, text), ids and titles by default the file's stem."""
    stem = F.regexp_replace("file_name", "\\.[^.]*$", "")
    df = files.withColumn("f", frontmatter(F.col("text")))
    get = lambda k: F.coalesce(F.try_element_at("f.metadata", F.lit(k)), stem)
    return df.select(get("doc_id").alias("doc_id"), get("title").alias("title"), "f.body", "f.metadata", "file_name")


def render_frontmatter(metadata: Column) -> Column:
    """Fixed order of keys, empty ones left out, values quoted where plain YAML would misread them."""

    def line(key: str) -> Column:
        v = F.try_element_at(metadata, F.lit(key))
        quote = v.rlike("[:#,\\[\\]{}\"']") | v.rlike("^[-?|>*&!%@`]") | v.rlike("^[\\p{Nd}.\\-]+$")
        shown = F.when(quote, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
        return F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{key}: "), shown))

    return F.concat(F.concat_ws("\n", F.lit("---"), *[line(k) for k in (*REQUIRED, *OPTIONAL)], F.lit("---")), F.lit("\n\n"))


def markdown_document(metadata: Column, content: Column) -> Column:
    """A Markdown document with all metadata quoted, its title as heading, and the content."""
    lines = F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), yaml_value(e["value"])))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n# "), F.try_element_at(metadata, F.lit("title")), F.lit("\n\n"), content, F.lit("\n"))


def _heads(docs: DataFrame) -> DataFrame:
    """docs (body) with heads, an array of (pos, line, next): its heading lines, each with the next non-blank line. Found
    within the row, so no other line leaves it."""
    lines = F.transform(F.split("body", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    full = docs.withColumn("_full", F.filter(lines, lambda s: strip(s["line"]) != ""))
    both = F.transform("_full", lambda s, i: F.struct(s["pos"].alias("pos"), s["line"].alias("line"), F.get("_full", i + 1)["line"].alias("next")))
    return full.withColumn("heads", F.filter(both, lambda s: s["line"].rlike("^#{1,6} .+$"))).drop("_full")


def _headings(docs: DataFrame, *more: str) -> DataFrame:
    """headings of docs (doc_id, heads), with more of their columns."""
    nxt = docs.select("doc_id", *more, F.inline("heads"))
    first = F.first("next").over(Window.partitionBy("doc_id", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return nxt.select("doc_id", *more, "pos", F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)).alias("level"), F.regexp_extract("line", "^#{1,6} (.+)$", 1).alias("title"), first.alias("next"))


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, level, title, next) of all heading lines of docs (doc_id, body); next is the next non-blank line
    after the first line that reads the same."""
    return _headings(_heads(docs.select("doc_id", "body")))


def problems(files: DataFrame) -> DataFrame:
    """(file_name, problem): every violation of the format contract by files (file_name, text). Each row is a file of its
    own, also where names repeat or are null."""
    df = files.withColumn("f", frontmatter_strict(F.col("text"))).select("file_name", F.regexp_replace("file_name", "\\.[^.]*$", "").alias("stem"), "f.*")
    meta = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    missing = F.filter(F.array(*[F.when(meta(k) == "", F.lit(k)) for k in REQUIRED]), lambda x: x.isNotNull())
    table_rows = F.regexp_extract_all("body", F.lit("(?m)((?:^\\|.*\\|\\n)+)"), F.lit(1))
    pipes = lambda r: F.length(r) - F.length(F.replace(r, F.lit("|"), F.lit(""))) - (F.length(r) - F.length(F.replace(r, F.lit("\\|"), F.lit("")))) / 2
    ragged = F.filter(table_rows, lambda t: F.size(F.array_distinct(F.transform(F.split(F.regexp_replace(t, "\\n$", ""), "\n"), pipes))) > 1)
    bad_lines = F.filter(F.transform(F.split("body", "\n"), lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda s: s["x"].rlike(BOILERPLATE))
    alone = F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing metadata "), F.array_join(missing, ", "))),
        F.when(meta("doc_id") != F.col("stem"), F.lit("doc_id differs from the file name")),
        F.when(~meta("audience").isin(*AUDIENCES), F.concat(F.lit("bad audience "), meta("audience"))),
        F.when(~meta("retrieved_at").rlike("^\\p{Nd}{4}-\\p{Nd}{2}-\\p{Nd}{2}$"), F.lit("retrieved_at is no date")),
        F.when(reduce(lambda a, b: a & b, [meta(k) == "" for k in ("department", "category", "language")]), F.lit("needs one more field to filter by")),
        F.when(F.col("body").rlike("\n{3,}"), F.lit("more than one blank line")),
    )
    lists = F.concat(
        F.filter(alone, lambda x: x.isNotNull()),
        F.transform(bad_lines, lambda s: F.concat(F.lit("boilerplate on line "), s["i"].cast("string"))),
        F.transform(ragged, lambda t: F.concat(F.lit("ragged table: "), F.substring(t, 1, 40))),
    )
    # Every text is read once; what the checks below need of it is small.
    read = stored(_heads(df).select(F.monotonically_increasing_id().alias("doc_id"), "file_name", F.length("body").alias("n"), lists.alias("lists"), "heads"), "corpus-read")
    flat = read.select("file_name", F.explode("lists").alias("problem"))
    h = _headings(read, "file_name")
    w = Window.partitionBy("doc_id").orderBy("pos")
    seq = h.select("*", F.lag("level", 1, 1).over(w).alias("prev"), F.lead("level").over(w).alias("after"))
    jumps = seq.where("level > prev + 1").select("file_name", F.format_string("heading level jump h%d->h%d", "prev", "level").alias("problem"))
    empty = seq.where(F.col("after").isNotNull() & (F.col("after") <= F.col("level")) & F.col("next").startswith("#")).select("file_name", F.concat(F.lit("empty section: "), F.substring("title", 1, 40)).alias("problem"))
    shape = read.select("doc_id", "file_name", "n").join(h.groupBy("doc_id").agg(F.count_if(F.col("level") == 1).alias("ones"), F.count_if(F.col("level") == 2).alias("twos"), F.min_by("level", "pos").alias("first")), "doc_id", "left")
    ones = shape.where("coalesce(ones, 0) <> 1 or first <> 1").select("file_name", F.lit("must have exactly one H1, first").alias("problem"))
    twos = shape.where(f"coalesce(twos, 0) = 0 and n >= {SHORT_DOCUMENT}").select("file_name", F.lit("no H2 sections").alias("problem"))
    return reduce(DataFrame.unionByName, [flat, jumps, empty, ones, twos])


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    """Whether two one-column frames hold the same values as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def audience_histogram(files: DataFrame) -> DataFrame:
    meta = files.select(F.coalesce(F.try_element_at(frontmatter_strict(F.col("text"))["metadata"], F.lit("audience")), F.lit("?")).alias("audience"))
    return meta.groupBy("audience").agg(F.count(F.lit(1)).alias("files"))


def validate(files: DataFrame, sources: DataFrame) -> dict:
    """The corpus-level gate: no problem, sources and files one to one, 5 to 10 files, two audiences or more."""
    n, found = files.count(), problems(files).count()
    audiences = audience_histogram(files).count()
    one = same_bag(sources.select("doc_id"), files.select(F.regexp_replace("file_name", "\\.[^.]*$", "").alias("doc_id")))
    return {"files": n, "problems": found, "audiences": audiences, "sources_match": one, "ok": not found and one and 5 <= n <= 10 and audiences >= 2}


def publish(drafts: DataFrame, existing: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files to write (doc_id, text), sources rows) of drafts (doc_id, metadata, body): documents among existing
    (doc_id) are written again only by force, but always listed."""
    todo = drafts if force else drafts.join(existing.select("doc_id"), "doc_id", "left_anti")
    files = todo.select("doc_id", F.concat(render_frontmatter(F.col("metadata")), "body").alias("text"))
    get = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    rows = drafts.select("doc_id", F.concat("doc_id", F.lit(".md")).alias("file_path"), *[get(k).alias(k) for k in SOURCES[2:]])
    return files, rows.orderBy("doc_id")


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of new, and rows of old whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


