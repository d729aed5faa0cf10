"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.vector import LCG, cosine, lcg_steps, mock_embedding
from corpusloom.operators import cache, chunking, corpus, crawl, evaluate, generate, html, hybrid, impact, lexical, partitions, sections, segments, store
from corpusloom.session import configure
from corpusloom.tables import shared_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL for the same rows if there is any."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: configure(spark).read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- SQL that several queries share

_SPACE = "[\\s\\v\\x1c-\\x1f\\x{85}\\p{Z}]"
_FIXED = "SELECT doc_id, i AS chunk_index, CASE WHEN length(text) <= {size} THEN text ELSE substr(text, i * {step} + 1, {size}) END AS content FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= {size} THEN 1 ELSE CAST(ceil((length(text) - {overlap}) / {step}.0) AS BIGINT) END)) AS i FROM {table})"
_SENTENCES = f"""SELECT doc_id, unnest(range(CAST(ceil(len(s) / 3.0) AS BIGINT))) AS chunk_index, s FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)"""


def _fixed_sql(table: str = "documents", size: int = 500, overlap: int = 50) -> str:
    return _FIXED.format(size=size, overlap=overlap, step=size - overlap, table=table)


def _recursive_sql(size: int = 500, source: str = "", key: str = "doc_id") -> str:
    """Recursive chunks: one step for each separator, which splits pieces that are still too long and folds neighbours
    together while they fit; `place` is where a piece stands, a number for each step. A source has key, piece and the size of its pieces."""
    source = source or f"SELECT doc_id, text AS piece, {size} AS size FROM documents WHERE text IS NOT NULL"
    step = """{name} AS (SELECT {key}, size, list_append(place, nth) AS place, p[nth] AS piece FROM (SELECT {key}, size, place, p, unnest(range(1, len(p) + 1)) AS nth FROM (
  SELECT {key}, size, place, CASE WHEN length(piece) <= size OR NOT contains(piece, {sep}) THEN [piece] ELSE list_concat(f.done, CASE WHEN f.held = '' THEN CAST([] AS VARCHAR[]) ELSE [f.held] END) END AS p FROM (
    SELECT *, list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'held': ''}}, list_transform(string_split(piece, {sep}), lambda x: {{'done': CAST([] AS VARCHAR[]), 'held': x}})), lambda a, b:
      CASE WHEN length(a.held) + CASE WHEN a.held = '' THEN 0 ELSE length({sep}) END + length(b.held) <= size
        THEN {{'done': a.done, 'held': CASE WHEN a.held = '' THEN b.held ELSE a.held || {sep} || b.held END}}
        ELSE {{'done': list_concat(list_concat(a.done, CASE WHEN a.held = '' THEN CAST([] AS VARCHAR[]) ELSE [a.held] END), CASE WHEN length(b.held) > size THEN [b.held] ELSE CAST([] AS VARCHAR[]) END), 'held': CASE WHEN length(b.held) > size THEN '' ELSE b.held END}} END) AS f FROM {before}))))"""
    seps = ("chr(10) || chr(10)", "chr(10)", "'. '", "' '")
    steps = ",\n".join(step.format(name=f"s{k + 1}", before=f"s{k}", sep=f"({x})", key=key) for k, x in enumerate(seps))
    return f"""WITH s0 AS (SELECT *, CAST([] AS BIGINT[]) AS place FROM ({source})),
{steps},
cut AS (SELECT {key}, list_append(place, nth) AS place, substr(piece, nth * size + 1, size) AS piece FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(length(piece) / CAST(size AS DOUBLE)) AS BIGINT)))) AS nth FROM s4)),
bare AS (SELECT {key}, place, regexp_replace(piece, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS content FROM cut)
SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY place) - 1 AS chunk_index, content FROM bare WHERE content <> ''"""


def _embedding_sql(text: str, dim: int = 64) -> str:
    steps = ", ".join(f"{{'a': {a}, 'c': {c}}}" for a, c in lcg_steps(dim))
    raw = f"list_transform([{steps}], lambda t: CAST((CAST(t.a AS HUGEINT) * CAST(('0x' || substr(md5({text}), 25, 8)) AS BIGINT) + t.c) % {LCG[2]} AS DOUBLE) / {LCG[2] - 1}.0 * 2 - 1)"
    return f"(SELECT list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) FROM (SELECT {raw} AS r))"


_TOKENS = "regexp_extract_all(lower({text}), '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*%?|[\\p{{L}}\\p{{N}}_]+')"
_ALL_TOKENS = """SELECT {id}, unnest(list_concat(w, list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN regexp_matches(w[i], '^\\p{{Nd}}') OR regexp_matches(w[i + 1], '^\\p{{Nd}}') THEN NULL ELSE w[i] || '_' || w[i + 1] END), lambda x: x IS NOT NULL))) AS term
  FROM (SELECT {id}, {tokens} AS w FROM {table})"""


def _tokens_sql(table: str, ident: str) -> str:
    return _ALL_TOKENS.format(id=ident, table=table, tokens=_TOKENS.format(text="text"))


#: Scores of all pairs of benchmark items and documents that share a term.
_BM25 = f"""
tok AS ({_tokens_sql("documents", "doc_id")}),
len_ AS (SELECT d.doc_id, count(t.term) AS len FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id),
tot AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len_),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, tot GROUP BY term),
qt AS (SELECT DISTINCT item_id, term FROM ({_tokens_sql("benchmark", "item_id")})),
bm AS (SELECT item_id, p.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg_len))) AS score FROM qt JOIN idf USING (term) JOIN post p USING (term) JOIN len_ USING (doc_id), tot GROUP BY item_id, p.doc_id),
bmr AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""
_DENSE = f"""
dv AS (SELECT doc_id, {_embedding_sql("text")} AS v FROM documents),
qv AS (SELECT item_id, {_embedding_sql("text")} AS q FROM benchmark),
ds AS (SELECT item_id, doc_id, list_inner_product(v, q) AS score FROM dv, qv),
dsr AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ds)"""
_FUSED = """
br AS (SELECT item_id, doc_id, 0 AS b, rank FROM dsr WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, 3, rank FROM bmr WHERE rank <= 20),
fu AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS fused, min(b * 1000 + rank) AS first, min(rank) AS best, max(CASE WHEN b = 0 THEN rank END) AS dense_rank, max(CASE WHEN b = 3 THEN rank END) AS bm25_rank FROM br GROUP BY item_id, doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, first) AS fused_rank FROM fu)"""


# ---- inputs that several queries share


def _records(t) -> DataFrame:
    """Documents as records of a store, one each, with language and source as metadata."""
    d = t("documents")
    meta = F.map_filter(F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("language"), F.col("lang"), F.lit("source"), F.col("source")), lambda k, v: v.isNotNull())
    return d.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("content"), meta.alias("metadata"), F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("index"))


def _questions(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))


def _store(t) -> store.VectorStore:
    r = _records(t)
    return store.VectorStore(r.sparkSession, r.withColumn("embedding", mock_embedding(F.col("content"))).select("id", "content", "metadata", "doc_id", "embedding", "index"))


def _vectors(t) -> DataFrame:
    return t("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def _bm25_ranking(t, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best documents of each item."""
    r = _records(t)
    return lexical.bm25_ranking(lexical.index(r.select("id", "content")), _questions(t), r, k, digits=9)


def _bm25_hits(t, k: int) -> DataFrame:
    """(qid, rank, id, content, metadata, score): the k best documents of each item, written once for whoever reads them."""
    return stored(_bm25_ranking(t, k).join(_records(t), "id"), "bm25-hits")


def _branches(t) -> DataFrame:
    r = _store(t).records
    dense = store.nearest(_questions(t).select("qid", mock_embedding(F.col("question")).alias("qvec")), r, 20, digits=9)
    sparse = _bm25_ranking(t, 20)
    named = lambda df, n: df.select("qid", F.lit(n).alias("branch"), F.lit(hybrid.BRANCHES.index(n)).alias("branch_ord"), "id", "rank")
    return named(dense, "dense").unionByName(named(sparse, "bm25"))


def _marked(t, nameless: bool = False) -> DataFrame:
    """Documents as Markdown files: frontmatter of their columns with a comment, a title, and a heading before each line.
    Those without doc_id are left out, or are files without a name."""
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, F.lit("## Part ")).otherwise(F.lit("### Point ")), (i + 1).cast("string"), F.lit("\n\n"), x)), "\n\n")
    d = t("documents") if nameless else t("documents").where("doc_id is not null")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    head = F.concat(F.lit("---\ndoc_id: d"), ident, F.lit('\ntitle: "Document '), ident, F.lit('"\nlanguage: '), F.coalesce("lang", F.lit("")), F.lit(" # language\nsource: '"), F.coalesce("source", F.lit("")), F.lit("'\nno colon\n---\n\n# Document "), ident, F.lit("\n\n"))
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.concat(head, body, F.lit("\n")).alias("text"), "doc_id")


# ---- chunking


@query(_fixed_sql())
def chunk_fixed(t):
    return t("documents").select("doc_id", F.posexplode(chunking.fixed(F.col("text"))).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"SELECT doc_id, chunk_index, array_to_string(s[chunk_index * 3 + 1 : chunk_index * 3 + 3], ' ') AS content FROM ({_SENTENCES})")
def chunk_sentence(t):
    return t("documents").select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(_recursive_sql())
def chunk_recursive(t):
    return t("documents").select("doc_id", F.posexplode(chunking.recursive(F.col("text"))).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    f"""WITH c AS (SELECT doc_id, 'fixed_size' AS strategy, content FROM ({_fixed_sql(size=200, overlap=20)}) UNION ALL
  SELECT doc_id, 'by_sentences', array_to_string(s[chunk_index * 3 + 1 : chunk_index * 3 + 3], ' ') FROM ({_SENTENCES}) UNION ALL
  SELECT doc_id, 'recursive', content FROM ({_recursive_sql(200)}))
SELECT doc_id, strategy, count(content) AS count, round(coalesce(avg(length(content)), 0), 6) AS avg_length FROM documents CROSS JOIN (SELECT unnest(['fixed_size', 'by_sentences', 'recursive']) AS strategy) LEFT JOIN c USING (doc_id, strategy) GROUP BY doc_id, strategy"""
)
def chunk_compare(t):
    return chunking.compare(t("documents")).select("doc_id", "strategy", F.col("count").cast("long").alias("count"), F.round("avg_length", 6).alias("avg_length"))


@query(
    f"""WITH c AS (SELECT 'fixed_size' AS strategy, content FROM ({_fixed_sql()}) UNION ALL
  SELECT 'by_sentences', array_to_string(s[chunk_index * 3 + 1 : chunk_index * 3 + 3], ' ') FROM ({_SENTENCES}))
SELECT strategy, count(*) AS chunks, round(avg(length(content)), 6) AS mean_length, min(length(content)) AS min_length, max(length(content)) AS max_length FROM c GROUP BY strategy"""
)
def chunk_stats(t):
    docs = t("documents").select("doc_id", F.col("text").alias("body"), F.create_map().cast("map<string,string>").alias("metadata"))
    both = chunking.chunk_corpus(docs, "fixed_size").unionByName(chunking.chunk_corpus(docs, "by_sentences"))
    s = chunking.statistics(both)
    return s.select("strategy", "chunks", F.round("mean_length", 6).alias("mean_length"), F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"))


@query(f"SELECT CAST(doc_id AS VARCHAR) || '#' || chunk_index AS id, content, CAST(doc_id AS VARCHAR) AS meta_doc_id, CAST(chunk_index AS VARCHAR) AS meta_index, 'fixed_size' AS strategy, lang FROM ({_fixed_sql()}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def chunk_corpus(t):
    docs = t("documents").select("doc_id", F.col("text").alias("body"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("doc_id"), F.lit("overwritten")).alias("metadata"))
    return chunking.chunk_corpus(docs).select("id", "content", F.col("metadata")["doc_id"].alias("meta_doc_id"), F.col("metadata")["chunk_index"].alias("meta_index"), F.col("metadata")["strategy"].alias("strategy"), F.col("metadata")["lang"].alias("lang"))


@query()
def structure_chunks(t):
    docs = corpus.load_documents(_marked(t).drop("doc_id"))
    return sections.structure_chunks(docs).drop("metadata")


_MARKED_SECTIONS = """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM l),
s AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN 'Part ' ELSE 'Point ' END || (i + 1) AS title, trim(w[i + 1], ' ' || chr(9) || chr(10) || chr(13)) AS own_text, 'Part ' || (i - i % 3 + 1) AS part FROM p)
SELECT doc_id, i, title, own_text, CASE WHEN i % 3 = 0 THEN title ELSE part || ' > ' || title END AS path, CASE WHEN i % 3 = 0 THEN 2 ELSE 3 END AS level FROM s"""
_LEAF_SOURCE = f"SELECT doc_id, i, own_text AS piece, 1200 - (length('Tài liệu: Document ' || doc_id || chr(10) || 'Mục: ' || path || ' (phần 9/9)') + 2) AS size FROM ({_MARKED_SECTIONS}) WHERE own_text <> ''"


@query(
    f"""WITH leaf AS (SELECT *, count(*) OVER (PARTITION BY doc_id, i) AS n_parts, row_number() OVER (PARTITION BY doc_id ORDER BY i, chunk_index) - 1 AS k FROM ({_recursive_sql(source=_LEAF_SOURCE, key='doc_id, i')}))
SELECT 'd' || doc_id AS doc_id, k AS chunk_index, 'd' || doc_id || '#' || k AS id, 'Tài liệu: Document ' || doc_id || chr(10) || 'Mục: ' || path || CASE WHEN n_parts > 1 THEN ' (phần ' || (chunk_index + 1) || '/' || n_parts || ')' ELSE '' END || chr(10) || chr(10) || content AS content,
  path AS section_path, title AS section_title, level AS heading_level, chunk_index + 1 AS part, n_parts, 'structure_leaf' AS strategy FROM leaf JOIN ({_MARKED_SECTIONS}) USING (doc_id, i)"""
)
def structure_leaf_chunks(t):
    docs = corpus.load_documents(_marked(t).drop("doc_id"))
    cut = sections.structure_chunks(docs, sections.StructureChunker(max_chars=1200, mode="leaf")).drop("metadata")
    return cut.withColumns({c: F.col(c).cast("long") for c in ("chunk_index", "part", "n_parts")})


@query(
    """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM l),
s AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN 'Part ' ELSE 'Point ' END || (i + 1) AS title, trim(w[i + 1], ' ' || chr(9) || chr(10) || chr(13)) AS own_text, 'Part ' || (i - i % 3 + 1) AS part FROM p)
SELECT 'd' || doc_id AS doc_id, i + 1 AS sec_idx, CASE WHEN i % 3 = 0 THEN 2 ELSE 3 END AS level, title, CASE WHEN i % 3 = 0 THEN title ELSE part || ' > ' || title END AS path, own_text FROM s
UNION ALL SELECT 'd' || doc_id, 0, 1, '', '', '' FROM l"""
)
def section_rows(t):
    docs = corpus.load_documents(_marked(t).drop("doc_id"))
    return sections.section_rows(docs).select("doc_id", "sec_idx", F.col("level").cast("int").alias("level"), "title", F.array_join("path", " > ").alias("path"), "own_text")


# ---- vectors and the store


@query(f"SELECT item_id, unnest(range(64)) AS i, round(unnest(v), 9) AS v FROM (SELECT item_id, {_embedding_sql('text')} AS v FROM benchmark)")
def mock_embed(t):
    return t("benchmark").select("item_id", F.posexplode(mock_embedding(F.col("text"))).alias("i", "v")).select("item_id", F.col("i").cast("long").alias("i"), F.round("v", 9).alias("v"))


@query("SELECT a.vec_id, round(CASE WHEN list_inner_product(a.e, a.e) = 0 OR list_inner_product(b.e, b.e) = 0 THEN 0 ELSE list_cosine_similarity(a.e, b.e) END, 9) AS similarity FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(t):
    v = _vectors(t)
    return v.alias("a").join(v.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", F.round(cosine(F.col("a.embedding"), F.col("b.embedding")), 9).alias("similarity"))


def _knn_sql(where: str = "true", k: int = 5) -> str:
    return f"""SELECT qid, vec_id, score, rank FROM (SELECT q.vec_id AS qid, r.vec_id, round(list_cosine_similarity(r.e, q.e), 7) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(r.e, q.e), 7) DESC, r.vec_id) AS rank
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0) q, (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) r WHERE {where}) WHERE rank <= {k}"""


def _knn(t, rows: DataFrame, k: int = 5) -> DataFrame:
    q = _vectors(t).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    near = store.nearest(q, rows.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("index"), "embedding"), k, digits=7)
    return near.select("qid", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(_knn_sql())
def knn_topk(t):
    return _knn(t, _vectors(t))


@query(_knn_sql())
def knn_partitioned(t):
    """knn_topk from vectors stored in partitions with exact bounds."""
    v = _vectors(t)
    vp = partitions.build(v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("index"), "embedding"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    near, _ = partitions.nearest(vp, q, 5, digits=7)
    return near.select("qid", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(_knn_sql("r.label IN (3, 7)"))
def knn_filtered(t):
    v = _vectors(t).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return _knn(t, v.where(store.matches(F.col("metadata"), {"label": [3, 7]})))


@query(f"SELECT f.qid, f.score AS score_filtered, f.vec_id AS first_filtered, u.score AS score_unfiltered, u.vec_id AS first_unfiltered FROM ({_knn_sql('r.label = 3', 1)}) f JOIN ({_knn_sql('true', 1)}) u USING (qid)")
def filter_ab(t):
    v = _vectors(t).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    best = lambda rows: _knn(t, rows, 1).withColumnRenamed("vec_id", "first_relevant")
    return evaluate.filter_effect(best(v.where(store.matches(F.col("metadata"), {"label": 3}))), best(v))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks, embedded, filtered by metadata, and the five nearest to the first benchmark passage."""
    return QUERIES["store_search"](spark, sf_dir)


@query(
    f"""WITH c AS (SELECT doc_id, chunk_index, content FROM ({_fixed_sql("(SELECT * FROM documents WHERE lang = 'en')")})),
q AS (SELECT {_embedding_sql("text")} AS q FROM benchmark ORDER BY item_id LIMIT 1),
s AS (SELECT CAST(doc_id AS VARCHAR) || '#' || chunk_index AS id, doc_id, chunk_index, round(list_inner_product({_embedding_sql("content")}, q), 7) AS score FROM c, q)
SELECT id, score FROM s ORDER BY score DESC, doc_id, chunk_index LIMIT 5"""
)
def store_search(t):
    docs = t("documents").select("doc_id", F.col("text").alias("body"), F.create_map(F.lit("language"), F.coalesce("lang", F.lit(""))).alias("metadata"))
    cut = chunking.chunk_corpus(docs).withColumn("ord", F.col("doc_id") * 1_000_000 + F.col("chunk_index"))
    s = store.VectorStore(docs.sparkSession).add(cut.drop("doc_id", "chunk_index", "strategy"))
    # One question, as the call has it; knn_* and hybrid_* run whole sets.
    question = t("benchmark").orderBy("item_id").first()["text"]
    return s.search(question, 5, {"language": "en"}).select("id", F.round("score", 7).alias("score"))


@query("SELECT count(*) AS records, count(*) FILTER (lang = 'en') AS english FROM documents")
def store_size(t):
    s = store.VectorStore(t("documents").sparkSession, _records(t).withColumn("embedding", F.array().cast("array<double>")))
    english = store.VectorStore(s.spark, s.records.where(store.matches(F.col("metadata"), {"language": "en"})))
    return s.spark.createDataFrame([(s.size(), english.size())], "records long, english long")


@query("SELECT doc_id FROM documents WHERE doc_id <> 7")
def store_delete(t):
    s = store.VectorStore(t("documents").sparkSession, _records(t).withColumn("embedding", F.array().cast("array<double>")))
    return s.delete("7")[0].records.select(F.col("index").alias("doc_id"))


@query(
    """WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
v AS (SELECT d.doc_id, coalesce(d.text, '') AS text, d.doc_id IN (SELECT doc_id FROM bad) AS bad, d.doc_id IN (SELECT doc_id FROM toxic) AS toxic FROM documents d),
tops AS (SELECT max(doc_id) + 1 AS one, max(doc_id) + 1 + coalesce(max(doc_id + 1) FILTER (toxic), 0) AS two FROM v),
r AS (SELECT doc_id, CASE WHEN toxic THEN 'withheld ' || doc_id ELSE text END AS content, CASE WHEN toxic THEN one ELSE 0 END + doc_id + 1 AS place FROM v, tops WHERE toxic OR NOT bad
  UNION ALL SELECT doc_id, text || ' again', two + doc_id + 1 FROM v, tops WHERE bad)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, content, CAST(length(content) AS DOUBLE) AS embedded, CAST(place AS BIGINT) AS place, (SELECT count(*) FROM v WHERE bad) AS deleted FROM r"""
)
def store_log(t):
    """Documents added to a store on disk, bad ones deleted, toxic ones replaced, the deleted ones added again, and all that
    is dead removed."""
    d, labels = t("documents"), t("labels")
    ident = F.col("doc_id").cast("string")
    length = store.Embedder(lambda c: F.array(F.length(c).cast("double")), lambda text: [float(len(text))], "length")
    s = segments.SegmentStore(d.sparkSession, f"{shared_dir(d.sparkSession)}/store-log-{uuid.uuid4().hex}", length)
    none = F.create_map().cast("map<string,string>").alias("metadata")
    as_docs = lambda df, content: df.select(ident.alias("id"), content.alias("content"), none, F.col("doc_id").alias("ord"))
    text = F.coalesce("text", F.lit(""))
    bad = d.join(labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    toxic = d.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    s.add(as_docs(d, text))
    deleted = s.delete(bad.select(ident.alias("doc_id")))
    s.replace(as_docs(toxic, F.concat(F.lit("withheld "), ident)))
    s.compact()
    s.add(as_docs(bad, F.concat(text, F.lit(" again"))))
    s.compact(everything=True)
    s.vacuum()
    return s.rows().select("doc_id", "content", F.col("embedding")[0].alias("embedded"), F.col("index").alias("place"), F.lit(deleted).cast("long").alias("deleted"))


# ---- lexical


@query(f"SELECT doc_id, term, count(*) AS tf FROM ({_tokens_sql('documents', 'doc_id')}) GROUP BY doc_id, term")
def tokenize(t):
    ix = lexical.index(_records(t).select(F.col("index").alias("id"), "content"))
    return ix.postings.select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"WITH {_BM25} SELECT term, df, round(idf, 9) AS idf FROM idf")
def bm25_idf(t):
    return lexical.index(_records(t).select("id", "content")).idf.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_BM25} SELECT item_id AS qid, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10")
def bm25_topk(t):
    return _bm25_ranking(t, 10).select("qid", F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} SELECT item_id AS qid, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10")
def bm25_pruned(t):
    """bm25_topk from a stored index ordered by impact."""
    ix = impact.build(_records(t).where("index is not null").select("id", "index", "content"))
    best = impact.ranking(ix, _questions(t), 10, digits=9)
    return best.select("qid", F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---- hybrid


@query(f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT item_id AS qid, doc_id, round(fused, 9) AS fused, fused_rank FROM fr")
def rrf_fusion(t):
    return hybrid.fuse(_branches(t)).select("qid", F.col("id").cast("long").alias("doc_id"), F.round("fused", 9).alias("fused"), F.col("fused_rank").cast("long").alias("fused_rank"))


@query(
    f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT item_id AS qid, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN fused_rank <= 6 THEN fused_rank ELSE 1000000 + first END) AS pool_ord FROM fr WHERE fused_rank <= 6 OR best <= 5"
)
def rerank_pool(t):
    pool = hybrid.rerank_pool(hybrid.fuse(_branches(t)), 6, 5)
    return pool.select("qid", F.col("id").cast("long").alias("doc_id"), F.col("pool_ord").cast("long").alias("pool_ord"))


@query(
    f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT item_id AS qid, doc_id, fused_rank AS rank, round(fused, 9) AS score, CAST(dense_rank AS DOUBLE) AS dense, CAST(bm25_rank AS DOUBLE) AS bm25, round(fused, 4) AS rrf FROM fr WHERE fused_rank <= 3"
)
def hybrid_retrieve(t):
    r = hybrid.HybridRetriever(_store(t), hybrid.HybridOptions(use_bm25=True), digits=9).retrieve(_questions(t), 3)
    get = lambda k: F.try_element_at("signals", F.lit(k)).alias(k)
    return r.select("qid", F.col("id").cast("long").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), get("dense"), get("bm25"), get("rrf"))


#: The three branches of hybrid_rerank: dense, a passage that the demo model writes in English (no record is Vietnamese), BM25.
_HYDE = "'[DEMO LLM] Generated answer from prompt preview: ' || replace(substr('" + hybrid.HYDE_PROMPTS["en"].replace("'", "''").replace("{question}", "' || coalesce(text, '') || '") + "', 1, 400), chr(10), ' ') || '...'"
_RERANKED = f"""WITH {_BM25}, {_DENSE},
hv AS (SELECT item_id, {_embedding_sql("passage")} AS q FROM (SELECT item_id, {_HYDE} AS passage FROM benchmark)),
hsr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(list_inner_product(v, q), 12) DESC, doc_id) AS rank FROM dv, hv),
dsr12 AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM ds),
bmr12 AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM bm),
br AS (SELECT item_id, doc_id, {hybrid.BRANCHES.index("dense")} AS b, rank FROM dsr12 WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, {hybrid.BRANCHES.index("hyde_en")}, rank FROM hsr WHERE rank <= 20
  UNION ALL SELECT item_id, doc_id, {hybrid.BRANCHES.index("bm25")}, rank FROM bmr12 WHERE rank <= 20),
fu AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS fused, min(b * 1000 + rank) AS first, min(rank) AS best FROM br GROUP BY item_id, doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, first) AS fused_rank FROM fu),
po AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused_rank <= 20 DESC, CASE WHEN fused_rank <= 20 THEN fused_rank END, first) AS pool_ord FROM fr WHERE fused_rank <= 20 OR best <= 5),
qn AS (SELECT item_id, count(*) AS n FROM qt GROUP BY item_id),
ov AS (SELECT p.item_id, p.doc_id, pool_ord, count(o.term) / greatest(any_value(coalesce(n, 0)), 1) AS score
  FROM po p LEFT JOIN qn USING (item_id) LEFT JOIN (SELECT item_id, doc_id, term FROM qt JOIN post USING (term)) o ON o.item_id = p.item_id AND o.doc_id = p.doc_id GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pool_ord) AS rank FROM ov)
SELECT item_id AS qid, rank, CAST(doc_id AS VARCHAR) AS id, round(score, 6) AS score FROM rr WHERE rank <= 3"""


@query(_RERANKED)
def hybrid_rerank(t):
    r = hybrid.HybridRetriever(_store(t), hybrid.HybridOptions(use_bm25=True, use_hyde=True), generate.demo_llm, hybrid.overlap_score)
    return r.retrieve(_questions(t), 3).select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


# ---- context, prompts, evaluation

_TOP3 = f"WITH {_BM25}, hits AS (SELECT item_id AS qid, doc_id, rank, d.text AS content, lang FROM bmr JOIN documents d USING (doc_id) WHERE rank <= 3)"


@query(f"{_TOP3} SELECT qid, string_agg('[' || rank || '] (nguồn: ' || doc_id || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY qid")
def context_build(t):
    return generate.agent_context(_bm25_hits(t, 3))


_PROMPT = "'{rules}\"{nf}\"' || chr(10) || chr(10) || 'NGỮ CẢNH:' || chr(10) || context || chr(10) || chr(10) || 'CÂU HỎI: ' || question || chr(10) || chr(10) || 'TRẢ LỜI:'".format(rules=generate.RULES, nf=generate.PIPELINE_NOT_FOUND)


@query(
    f"""{_TOP3}, c AS (SELECT qid, string_agg('[' || rank || '] (nguồn: ' || doc_id || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY qid)
SELECT item_id AS qid, CASE WHEN context IS NULL THEN '{generate.PIPELINE_NOT_FOUND}' ELSE '[DEMO LLM] Generated answer from prompt preview: ' || replace(substr({_PROMPT}, 1, 400), chr(10), ' ') || '...' END AS answer
FROM (SELECT item_id, text AS question FROM benchmark) b LEFT JOIN c ON c.qid = b.item_id"""
)
def prompt_answers(t):
    asked = generate.prompts(_questions(t), generate.pipeline_context(_bm25_hits(t, 3)), generate.PIPELINE_NOT_FOUND)
    return generate.answers(asked)


def _gold(t) -> DataFrame:
    """Items whose first 40 characters a document has: those documents are gold, and the passage is the key phrase."""
    return _questions(t).select("qid", F.array(F.array("question"), F.array(F.substring("question", 1, 40))).alias("context_keys"), F.array(F.array(F.substring("question", 1, 12))).alias("answer_keys"))


def _verdicts(t) -> DataFrame:
    top = _bm25_hits(t, 3)
    gold_docs = top.join(_questions(t), "qid").where(F.contains("content", "question")).groupBy("qid").agg(F.collect_set(F.col("metadata")["doc_id"]).alias("gold_docs"))
    gold = _gold(t).join(gold_docs, "qid", "left").withColumn("gold_docs", F.coalesce("gold_docs", F.array().cast("array<string>")))
    hits = lambda k, name: top.where(F.col("rank") <= k).select(F.lit(name).alias("strategy"), "qid", "rank", "content", F.col("metadata")["doc_id"].alias("doc_id"))
    both = hits(3, "bm25@3").unionByName(hits(1, "bm25@1"))
    answers = both.groupBy("strategy", "qid").agg(F.min_by("content", "rank").alias("answer"))
    return evaluate.verdicts(both, answers, gold)


_VERDICTS = f"""{_TOP3}, g AS (SELECT item_id AS qid, lower(text) AS p, lower(substr(text, 1, 40)) AS k2, lower(substr(text, 1, 12)) AS a, text AS raw FROM benchmark),
st AS (SELECT 'bm25@3' AS strategy, 3 AS k UNION ALL SELECT 'bm25@1', 1),
gd AS (SELECT qid, doc_id FROM hits JOIN g USING (qid) WHERE contains(content, raw)),
j AS (SELECT strategy, h.qid, rank, lower(content) AS content, gd.doc_id IS NOT NULL AS gold, p, k2, a FROM st JOIN hits h ON h.rank <= st.k JOIN g ON g.qid = h.qid LEFT JOIN gd ON gd.qid = h.qid AND gd.doc_id = h.doc_id),
v AS (SELECT strategy, qid, min(CASE WHEN gold AND contains(content, p) THEN rank END) AS first_relevant, bool_or(gold) AS doc_hit, (CAST(contains(string_agg(content, chr(10) ORDER BY rank), any_value(p)) AS INT) + CAST(contains(string_agg(content, chr(10) ORDER BY rank), any_value(k2)) AS INT)) / 2.0 AS coverage, contains(min_by(content, rank), any_value(a)) AS answer_ok FROM j GROUP BY strategy, qid),
vs AS (SELECT strategy, qid, CASE WHEN first_relevant = 1 AND answer_ok THEN 2 WHEN first_relevant IS NOT NULL THEN 1 ELSE 0 END AS score, first_relevant, doc_hit, coverage, answer_ok FROM v)"""


@query(f"{_VERDICTS} SELECT strategy, qid, CAST(score AS BIGINT) AS score, CAST(coalesce(first_relevant, 0) AS BIGINT) AS first_relevant, doc_hit, CAST(coverage AS DOUBLE) AS coverage, answer_ok FROM vs")
def eval_verdicts(t):
    v = _verdicts(t)
    return v.withColumns({"score": F.col("score").cast("long"), "first_relevant": F.coalesce("first_relevant", F.lit(0)).cast("long"), "coverage": F.col("coverage").cast("double")})


@query(f"{_VERDICTS} SELECT strategy, CAST(sum(score) AS BIGINT) AS score, CAST(count_if(doc_hit) AS BIGINT) AS doc_hits, count(first_relevant) AS relevant, round(avg(coalesce(1.0 / first_relevant, 0)), 9) AS mrr, CAST(count_if(answer_ok) AS BIGINT) AS answers_ok FROM vs GROUP BY strategy")
def eval_summary(t):
    return evaluate.summary(_verdicts(t)).withColumn("mrr", F.round("mrr", 9))


@query(f"{_VERDICTS} SELECT s.strategy, 'q' || item_id AS qid, CAST(max(score) AS BIGINT) AS score FROM (SELECT DISTINCT strategy FROM vs) s CROSS JOIN (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN vs ON vs.strategy = s.strategy AND vs.qid = item_id GROUP BY s.strategy, item_id")
def eval_pivot(t):
    # A column for each item, read back as rows, since the number of items differs from table to table.
    items = [f"q{r[0]}" for r in t("benchmark").select("item_id").distinct().orderBy("item_id").collect()]
    v = _verdicts(t).withColumn("qid", F.concat(F.lit("q"), F.col("qid").cast("string"))).withColumn("score", F.col("score").cast("long"))
    return evaluate.score_matrix(v, items).unpivot("strategy", items, "qid", "score")


@query("SELECT conv_id, string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def conversation_context(t):
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), "text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


# ---- corpora


@query("SELECT 'd' || doc_id AS doc_id, 'Document ' || doc_id AS title, coalesce(lang, '') AS language, coalesce(source, '') AS source, CAST(length('# Document ' || doc_id) + 2 + length(coalesce(text, '')) + 1 + list_sum(list_transform(range(len(string_split(coalesce(text, ''), chr(10)))), lambda i: CASE WHEN i % 3 = 0 THEN 8 ELSE 10 END + length(CAST(i + 1 AS VARCHAR)) + 2)) + (len(string_split(coalesce(text, ''), chr(10))) - 1) AS BIGINT) AS body_chars FROM documents")
def frontmatter(t):
    d = corpus.load_documents(_marked(t).drop("doc_id"))
    return d.select("doc_id", "title", d["metadata"]["language"].alias("language"), d["metadata"]["source"].alias("source"), F.length("body").cast("long").alias("body_chars"))


@query("SELECT 'd' || doc_id AS doc_id, coalesce(lang, '') || ' # language' AS language, '''' || coalesce(source, '') || '''' AS source, true AS bare_key, true AS leading_line FROM documents")
def frontmatter_strict(t):
    f = _marked(t).select(corpus.frontmatter_strict(F.col("text")).alias("f")).select("f.*")
    return f.select(f["metadata"]["doc_id"].alias("doc_id"), f["metadata"]["language"].alias("language"), f["metadata"]["source"].alias("source"), (f["metadata"]["no colon"] == "").alias("bare_key"), F.col("body").startswith("\n").alias("leading_line"))


@query(
    """WITH d AS (SELECT 'd' || doc_id || '.md' AS file_name FROM documents)
SELECT file_name, unnest(['missing metadata source_url, retrieved_at, document_version, audience', 'bad audience ', 'retrieved_at is no date']) AS problem FROM d"""
)
def corpus_problems(t):
    return corpus.problems(_marked(t, nameless=True).drop("doc_id"))


def _broken(t) -> DataFrame:
    """Documents as Markdown files that meet the format contract but for one rule, chosen by doc_id."""
    d = t("documents").where("doc_id is not null")
    ident, rule = F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(8))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[#|]", ""), "\n+", "\n"), "^\n|\n\\z", "")
    line = lambda k, x: F.when(rule == k, F.lit(x)).otherwise(F.lit(""))
    meta = "\ntitle: T\nsource_url: http://a.example\nretrieved_at: 2024-01-31\ndocument_version: v1\naudience: all\nlanguage: en\n---\n"
    title = F.concat(F.when(rule == 1, F.lit("")).otherwise(F.lit("# ")), F.lit("Document "), ident, F.lit("\n\n"))
    before = F.concat(line(4, "## Empty\n\n"), F.when(rule == 2, F.lit("")).otherwise(F.lit("## Part\n\n")), line(3, "#### Deep\n\n"), line(6, "| a | b |\n| c |\n"), line(7, "one\n\n\ntwo\n"))
    body = F.concat(F.lit("\n"), title, before, F.coalesce(F.nullif(clean, F.lit("")), F.lit("-")), line(5, "\nCookie settings"), F.lit("\n"))
    return d.select(F.concat(F.lit("d"), ident, F.lit(".md")).alias("file_name"), F.concat(F.lit("---\ndoc_id: d"), ident, F.lit(meta), body).alias("text"))


@query(
    """WITH d AS (SELECT doc_id, doc_id % 8 AS rule, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[#|]', '', 'g'), '\n+', '\n', 'g'), '^\n|\n\\z', '', 'g'), ''), '-') AS x FROM documents),
b AS (SELECT *, string_split(chr(10) || CASE rule WHEN 1 THEN '' ELSE '# ' END || 'Document ' || doc_id || chr(10) || chr(10)
  || CASE rule WHEN 2 THEN '' WHEN 4 THEN '## Empty' || chr(10) || chr(10) || '## Part' || chr(10) || chr(10) ELSE '## Part' || chr(10) || chr(10) END
  || CASE rule WHEN 3 THEN '#### Deep' || chr(10) || chr(10) WHEN 6 THEN '| a | b |' || chr(10) || '| c |' || chr(10) WHEN 7 THEN 'one' || chr(10) || chr(10) || chr(10) || 'two' || chr(10) ELSE '' END
  || x || CASE rule WHEN 5 THEN chr(10) || 'Cookie settings' ELSE '' END || chr(10), chr(10)) AS lines FROM d),
p AS (SELECT doc_id, 'boilerplate on line ' || unnest(list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '(?i)(trang chủ|chuyển đến nội dung|\\[email[^\\]]*protected\\]|đăng ký ngay|xem thêm tin|cookie)'))) AS problem FROM b
  UNION ALL SELECT doc_id, 'must have exactly one H1, first' FROM b WHERE rule = 1
  UNION ALL SELECT doc_id, 'no H2 sections' FROM b WHERE rule = 2 AND length(array_to_string(lines, chr(10))) >= 1500
  UNION ALL SELECT doc_id, 'heading level jump h2->h4' FROM b WHERE rule = 3
  UNION ALL SELECT doc_id, 'empty section: Empty' FROM b WHERE rule = 4
  UNION ALL SELECT doc_id, 'ragged table: | a | b |' || chr(10) || '| c |' || chr(10) FROM b WHERE rule = 6
  UNION ALL SELECT doc_id, 'more than one blank line' FROM b WHERE rule = 7)
SELECT 'd' || doc_id || '.md' AS file_name, problem FROM p"""
)
def corpus_broken(t):
    return corpus.problems(_broken(t))


@query("SELECT '---' || chr(10) || 'doc_id: \"' || doc_id || '\"' || chr(10) || 'title: \"a: ' || source || '\"' || chr(10) || 'language: ' || lang || chr(10) || '---' || chr(10) || chr(10) AS head FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def render_frontmatter(t):
    m = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("language"), F.col("lang"), F.lit("title"), F.concat(F.lit("a: "), "source"), F.lit("category"), F.lit(""))
    return t("documents").where("source is not null and lang is not null").select(corpus.render_frontmatter(m).alias("head"))


@query("SELECT doc_id, '---' || chr(10) || 'title: \"' || source || '\"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || source || chr(10) || chr(10) || text || chr(10) AS document FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def markdown_document(t):
    d = t("documents").where("source is not null and text is not null")
    return d.select("doc_id", corpus.markdown_document(F.create_map(F.lit("title"), F.col("source")), F.col("text")).alias("document"))


@query(
    """WITH a AS (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels), b AS (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)
SELECT (SELECT count(*) FROM a) AS only_documents, true AS same_docs, (SELECT count(*) FROM a) = 0 AND (SELECT count(*) FROM b) = 0 AS same_labels"""
)
def manifest_diff(t):
    docs, labelled = t("documents").select("doc_id"), t("labels").select("doc_id")
    with_itself, with_labels = corpus.same_bag(docs, docs.orderBy(F.desc("doc_id"))), corpus.same_bag(docs, labelled)
    return docs.exceptAll(labelled).agg(F.count(F.lit(1)).alias("only_documents")).select("only_documents", F.lit(with_itself).alias("same_docs"), F.lit(with_labels).alias("same_labels"))


@query("SELECT coalesce(lang, '?') AS audience, count(*) AS files FROM documents GROUP BY 1")
def audience_histogram(t):
    files = t("documents").select(F.concat(F.lit("---\naudience: "), F.coalesce("lang", F.lit("?")), F.lit("\n---\n")).alias("text"))
    return corpus.audience_histogram(files)


@query("SELECT doc_id, '{}' AS note FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)".format("new"))
def sources_upsert(t):
    old = t("documents").select("doc_id", F.col("source").alias("note"))
    return corpus.upsert(old, t("labels").where("quality = 0").select("doc_id", F.lit("new").alias("note")))


@query("SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS written FROM documents")
def publish(t):
    drafts = t("documents").select("doc_id", F.create_map(F.lit("title"), F.coalesce("source", F.lit(""))).alias("metadata"), F.coalesce("text", F.lit("")).alias("body"))
    files, rows = corpus.publish(drafts, t("labels").select("doc_id").distinct())
    return rows.select("doc_id").join(files.select("doc_id", F.lit(True).alias("w")), "doc_id", "left").select("doc_id", F.coalesce("w", F.lit(False)).alias("written"))


# ---- text, pages, crawl


@query("SELECT doc_id, lower(replace(replace(text, '–', '-'), '—', '-')) AS norm FROM documents")
def norm_text(t):
    return t("documents").select("doc_id", tx.norm(F.col("text")).alias("norm"))


@query(
    f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13), ' '), chr(10), ' '), '[ \\t\\x{{00A0}}\\x{{2009}}\\x{{202F}}\\x{{200B}}\\x{{FEFF}}]+', ' ', 'g'), '{_SPACE}+([,.;:!?)])', '\\1', 'g'), '\\({_SPACE}+', '(', 'g'), '[”\"“]{{3,}}', '', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS clean FROM documents"
)
def clean_text(t):
    return t("documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document') AS slug FROM pages")
def slugify_url(t):
    return t("pages").select("page_id", tx.slugify(F.col("url")).alias("slug"))


@query("SELECT page_id, '\"' || replace(replace(url, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"' AS value FROM pages")
def yaml_values(t):
    return t("pages").select("page_id", tx.yaml_value(F.col("url")).alias("value"))


@query("SELECT item_id, 'a@b.' || item_id AS address FROM benchmark")
def cf_email(t):
    s = F.concat(F.lit("a@b."), F.col("item_id").cast("string"))
    hidden = F.concat(F.lit("42"), F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.lower(F.lpad(F.hex(F.ascii(c).bitwiseXOR(F.lit(0x42))), 2, "0"))), ""))
    return t("benchmark").select("item_id", tx.decode_cf_email(hidden).alias("address"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def html_title(t):
    return t("pages").select("page_id", html.html_title(F.col("html")).alias("title"))


@query()
def html_text(t):
    return t("pages").select("page_id", html.html_text(F.col("html")).alias("t")).select("page_id", "t.*").where(crawl.long_enough(F.col("text")))


@query()
def html_blocks(t):
    return t("pages").select("page_id", F.explode(html.html_rows(F.col("html"))["value"]).alias("r")).select("page_id", "r.*")


@query()
def html_profile(t):
    rows = t("pages").select("page_id", F.explode(html.html_rows(F.col("html"))["value"]).alias("r")).select("page_id", "r.*")
    return crawl.block_profile(rows).withColumn("level", F.col("level").cast("long"))


@query()
def html_markdown(t):
    return t("pages").select("page_id", html.markdown_of(F.col("html"), F.col("url")).alias("markdown"))


@query("SELECT page_id, len(regexp_extract_all(html, 'data-cfemail')) AS cf_email, len(regexp_extract_all(html, '<img\\b')) AS img, len(regexp_extract_all(html, '<p[^>]*>\\s*(&nbsp;)?\\s*</p>')) AS empty_p FROM pages")
def html_noise(t):
    return crawl.noise_profile(t("pages"))


_URL_PARTS = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || coalesce('?' || nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '') AS path"


@query(
    f"""SELECT page_id, host, CASE WHEN regexp_matches(path, '^/en/.*/') THEN true WHEN regexp_matches(path, '^/.*2.*') OR regexp_matches(path, '^/en/') THEN false WHEN regexp_matches(path, '^/.*2.*') THEN false ELSE true END AS allowed FROM (SELECT page_id, {_URL_PARTS} FROM pages)"""
)
def robots(t):
    pages = t("pages").select("page_id", "url")
    hosts = pages.select(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host")).distinct()
    text = "User-agent: other\nDisallow: /\n\nUser-agent: * # all\nDisallow: /*2*\nDisallow: /en/\nAllow: /en/*/\nDisallow:\n"
    rules = crawl.robots_rules(hosts.select("host", F.lit(text).alias("text")))
    out = crawl.allowed(pages, rules)
    return pages.join(out.select("url", "host", "allowed").distinct(), "url").select("page_id", "host", "allowed")


def _host_files(t) -> DataFrame:
    """A robots file (host, text) of each host of pages, its rules taken from the first and last of the host's paths."""
    u = t("pages").select(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), crawl.path_of(F.col("url")).alias("path"))
    ends = u.groupBy("host").agg(F.min("path").alias("a"), F.max("path").alias("z"))
    rules = ("'Disallow: ' || substr(a, 1, 5)", "'Allow: ' || a || '$'", "'Disallow: ' || substr(z, 1, length(z) - 1)", "'Disallow: /*' || right(z, 1)", "'Allow: ' || substr(z, 1, 6)")
    return ends.select("host", F.expr(f"concat_ws('\\n', 'User-agent: *', {', '.join(rules)})").alias("text"))


@query(
    f"""WITH u AS (SELECT page_id, {_URL_PARTS} FROM pages), e AS (SELECT host, min(path) AS a, max(path) AS z FROM u GROUP BY host),
r AS (SELECT host, 1 AS ord, false AS ok, 'start' AS kind, substr(a, 1, 5) AS lit, length(substr(a, 1, 5)) AS n FROM e
  UNION ALL SELECT host, 2, true, 'whole', a, length(a) + 1 FROM e
  UNION ALL SELECT host, 3, false, 'start', substr(z, 1, length(z) - 1), length(z) - 1 FROM e WHERE length(z) > 1
  UNION ALL SELECT host, 4, false, 'within', right(z, 1), 3 FROM e
  UNION ALL SELECT host, 5, true, 'start', substr(z, 1, 6), length(substr(z, 1, 6)) FROM e),
m AS (SELECT page_id, arg_max(ok, n * 10 - ord) AS ok FROM u JOIN r USING (host) WHERE CASE kind WHEN 'start' THEN starts_with(path, lit) WHEN 'whole' THEN path = lit ELSE contains(substr(path, 2), lit) END GROUP BY page_id)
SELECT page_id, host, coalesce(ok, true) AS allowed FROM u LEFT JOIN m USING (page_id)"""
)
def robots_hosts(t):
    pages = t("pages").select("page_id", "url")
    out = crawl.allowed(pages, crawl.robots_rules(_host_files(t)))
    return pages.join(out.select("url", "host", "allowed").distinct(), "url").select("page_id", "host", "allowed")


@query("SELECT page_id, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM pages")
def fetch_log(t):
    fetched = t("pages").select(F.col("page_id").alias("doc_id"), "url", F.lit("html").alias("kind"), F.lit("text/html").alias("content_type"), F.col("html").cast("binary").alias("body"))
    return crawl.fetch_log(fetched, F.lit("2024-01-01")).select(F.col("doc_id").alias("page_id"), F.col("bytes").cast("long").alias("bytes"), "sha256")


@query("SELECT status, count(*) AS urls FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'redirected' WHEN page_id % 7 = 0 THEN 'wrong type' ELSE 'ok' END AS status FROM pages) GROUP BY status")
def fetch_summary(t):
    final = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("x"))).otherwise(F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/")))
    kind = F.when(F.col("page_id") % 7 == 0, "application/pdf").otherwise("text/html")
    return crawl.fetch_summary(t("pages").select(crawl.fetch_status(F.col("url"), final, kind, F.lit("html")).alias("status")))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document') AS doc_id, 'not-stated' AS version, 'x' AS extra FROM (SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/?$', 1), '(.)\\.[^.]*$', '\\1'), ''), 'none') AS stem FROM pages)")
def page_metadata(t):
    row = F.create_map(F.lit("doc_id"), F.lit(""), F.lit("title"), F.lit(""), F.lit("document_version"), F.lit(""), F.lit("extra"), F.lit("x"), F.lit("Bad Key"), F.lit("y"))
    m = t("pages").select("page_id", tx.page_metadata(row, F.col("url"), F.lit("none"), F.lit("2024-01-01")).alias("m"))
    return m.select("page_id", m["m"]["doc_id"].alias("doc_id"), m["m"]["document_version"].alias("version"), m["m"]["extra"].alias("extra"))


# ---- caches


@query("SELECT doc_id, sha256('mock' || chr(10) || text) AS key FROM documents")
def cache_keys(t):
    return t("documents").select("doc_id", tx.cache_key(F.lit("mock"), F.col("text")).alias("key"))


@query("SELECT DISTINCT sha256('mock' || chr(10) || text) AS key FROM documents WHERE text NOT IN (SELECT text FROM documents d JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def cache_miss(t):
    key = tx.cache_key(F.lit("mock"), F.col("text"))
    asked = t("documents").where("text is not null").select(key.alias("key"), "text")
    cached = t("documents").where("text is not null").join(t("labels").select("doc_id"), "doc_id", "left_semi").select(key.alias("key"))
    return generate.call_missing(asked, cached, lambda texts: [len(x) for x in texts], "long").select("key")


@query("SELECT d.doc_id, sha256('mock' || chr(10) || d.text) AS key, CAST(CASE WHEN sha256('mock' || chr(10) || d.text) IN (SELECT sha256('mock' || chr(10) || text) FROM documents SEMI JOIN labels USING (doc_id) WHERE text IS NOT NULL) THEN -1 ELSE length(d.text) END AS BIGINT) AS value FROM documents d WHERE d.text IS NOT NULL")
def cache_filled(t):
    """Values of all documents from a bucketed cache that has those of labelled ones (-1) and is filled with the rest."""
    d = t("documents").where("text is not null").select("doc_id", tx.cache_key(F.lit("mock"), F.col("text")).alias("key"), "text")
    c = cache.BucketedCache(d.sparkSession, f"{shared_dir(d.sparkSession)}/cache-{uuid.uuid4().hex}", "bigint", 16)
    known = d.join(t("labels").select("doc_id"), "doc_id", "left_semi").select("key", F.lit(-1).alias("value")).distinct()
    c.append(known)
    c.fill(d, lambda texts: [len(x) for x in texts])
    return c.get(d.select("doc_id", "key")).select("doc_id", "key", "value")
