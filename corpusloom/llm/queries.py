"""Registered queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.quality import quality_rules

    out, _ = quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.contamination import decontaminate

    out = decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i + 1 : i + 10] AS g FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
grams AS (
  SELECT doc_id, n, i, w[i + 1 : i + n] AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, n, i, item_id FROM grams JOIN win USING (g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.hashing import simhash_components

    out = simhash_components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.pii import find_pii

    return find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.lm import lm_scores

    return lm_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm.rans import read_ids, write_ids

    return read_ids(write_ids(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.language import identify

    return identify(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.warc import index_runs, merge_index, write_archives

    history = merge_index(index_runs(write_archives(_read(spark, sf_dir, "pages"))))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm.pieces import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.repeats import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.infill import fill_back, fill_in_middle

    out = fill_back(fill_in_middle(_read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || s[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || s[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || s[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, n, t, form, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
    array_to_string(u[greatest(a, b) + 1:n], '') AS suf FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.minhash import minhash_components

    return minhash_components(_read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) AS g FROM d WHERE len(w) > 0),
g AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * n_both >= 80 * (na + nb - n_both)),
r AS (SELECT a AS doc_id, b AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT doc_id, min(reach) AS lowest FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(s.g), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.lowest, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.lowest, d.doc_id) AS kept
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.spelling import spelling_variants

    return spelling_variants(_read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 is written out bit by bit; near words share what is left without one character.
OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (SELECT run, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
crc AS (
  SELECT run, c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda p, q: xor(p >> 1, CASE WHEN p & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS h
  FROM bytes),
seen AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM crc),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM seen WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT l.word AS a, w.word AS b FROM less l JOIN words w ON l.rest = w.word),
pairs AS (
  SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
  UNION SELECT l.word, r.word FROM less l JOIN less r ON l.i = r.i AND l.rest = r.rest AND l.word <> r.word),
ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place
  FROM pairs JOIN words ON b = word),
forms AS (
  SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.b END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.a AND r.place = 1),
chain AS (
  SELECT word, word AS place FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.place = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.place AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON f.word = c.word JOIN forms e ON c.place = e.word AND e.form IS NULL
"""


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_lm_scores, op3_token_files, op4_quality_rules, op5_language, op6_warc, op7_decontamination, op8_simhash, op9_sentencepiece, op10_repeats, op11_fill_in_middle, op12_minhash, op13_spelling_variants)
}
ORACLE = {"op7_decontamination": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_minhash": OP12_SQL, "op13_spelling_variants": OP13_SQL}
