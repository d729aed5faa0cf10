import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import corpus, crawl, evaluate, html
from corpusloom.sources import files


def value(spark, column, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"a{i} string" for i in range(len(args))))
    return df.select(column(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]


def test_text_functions(spark):
    assert value(spark, tx.slugify, "Học phí 2026!") == "h-c-ph-2026"
    assert value(spark, tx.slugify, "!!!") == "document"
    assert value(spark, tx.decode_cf_email, "42230220") == "a@b"
    assert value(spark, tx.clean_text, " a  b ,\nc ( d ) ⭐ [ here (http://x.y) ] ”””") == "a b, c (d) here (http://x.y)"
    assert value(spark, tx.yaml_value, 'a"\\') == '"a\\"\\\\"'
    assert value(spark, tx.norm, "A–B—C") == "a-b-c"


def test_two_readings_of_frontmatter(spark):
    text = '---\ntitle: "T"\naudience: student    # one of two\nno colon\n---\n\nbody'
    a, b = value(spark, corpus.frontmatter, text), value(spark, corpus.frontmatter_strict, text)
    assert a["metadata"] == {"title": "T", "audience": "student"} and a["body"] == "body"
    assert b["metadata"] == {"title": "T", "audience": "student    # one of two", "no colon": ""} and b["body"] == "\nbody"
    assert value(spark, corpus.frontmatter, "plain")["metadata"] == {}


GOOD = "---\ndoc_id: d\ntitle: t\nsource_url: u\nretrieved_at: 2026-01-01\ndocument_version: v\naudience: all\nlanguage: vi\n---\n\n# T\n\n## A\n\nx\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GOOD, []),
        (GOOD.replace("## A", "### A"), ["heading level jump h1->h3"]),
        (GOOD.replace("## A\n\nx", "## A\n\n## B\n\nx"), ["empty section: A"]),
        (GOOD.replace("x\n", "Trang chủ\n"), ["boilerplate on line 6"]),
        (GOOD.replace("x\n", "| a | b |\n|---|---|\n| c |\n"), ["ragged table: | a | b |\n|---|---|\n| c |\n"]),
        (GOOD.replace("x\n", "x\n\n\n\ny\n"), ["more than one blank line"]),
        (GOOD.replace("all", "nobody").replace("2026-01-01", "soon"), ["bad audience nobody", "retrieved_at is no date"]),
        (GOOD.replace("# T\n", "text\n"), ["must have exactly one H1, first"]),
    ],
)
def test_problems(spark, text, want):
    rows = corpus.problems(spark.createDataFrame([("d.md", text)], "file_name string, text string")).collect()
    assert sorted(r["problem"] for r in rows) == sorted(want)


def test_publish_keeps_what_exists(spark):
    drafts = spark.createDataFrame([("a", {"title": "x: y", "doc_id": "1.2"}, "B"), ("b", {}, "C")], "doc_id string, metadata map<string,string>, body string")
    out, rows = corpus.publish(drafts, spark.createDataFrame([("b",)], "doc_id string"))
    assert [r["text"] for r in out.collect()] == ['---\ndoc_id: "1.2"\ntitle: "x: y"\n---\n\nB']
    assert rows.count() == 2 and corpus.publish(drafts, drafts, True)[0].count() == 2


def test_robots(spark):
    text = "User-agent: x\nDisallow: /\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: */students/\nDisallow: /end$\nDisallow: /p.q\nAllow: /p.q"
    rules = crawl.robots_rules(spark.createDataFrame([("h", text)], "host string, text string"))
    urls = ["http://h/a/b/c", "http://h/a/x", "http://h/x/students/1", "http://h/end", "http://h/ending", "http://h/pxq", "http://h/p.q", "http://h", "http://other/a"]
    got = {r["url"]: r["allowed"] for r in crawl.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert [got[u] for u in urls] == [True, False, False, False, True, True, False, True, True]


def test_robots_against_every_rule(spark):
    """The index by prefix decides as a comparison with every rule does."""
    import itertools
    import re

    parts = ["/", "/a", "/a/b", "/a*", "/*b", "*b", "/a/b$", "/*$", "/a?x", "/a/*/c", "*", "$", "/a/b/c/d/e", "/A"]
    lines = [f"{'Allow' if i % 3 else 'Disallow'}: {r}" for i, r in enumerate(parts + parts[::-1])]
    files = [(f"h{k}", "User-agent: *\n" + "\n".join(lines[k::3] + lines[k : k + 2])) for k in range(3)] + [("none", ""), ("empty", "User-agent: *\nDisallow:")]
    rules = crawl.robots_rules(spark.createDataFrame(files, "host string, text string"))
    paths = ["", "/", "/a", "/a/b", "/a/b/c", "/a/b/c/d/e/f", "/a?x=1", "/b", "/A/b", "/a/x/c", "/$", "/a*"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(["h0", "h1", "h2", "none", "empty", "unknown"], paths)] + ["not a url", None]
    got = {r["url"]: (r["allowed"], r["pattern"]) for r in crawl.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    known = rules.collect()
    for h, p in itertools.product(["h0", "h1", "h2", "none", "empty", "unknown"], paths):
        fits = [r for r in known if r["host"] == h and re.match(r["pattern"], p or "/")]
        best = max(fits, key=lambda r: (r["len"], -r["ord"]), default=None)
        assert got[f"http://{h}{p}"] == ((best["is_allow"], best["pattern"]) if best else (True, None)), (h, p)
    assert got["not a url"] == (True, None)


def test_robots_candidates_are_bounded(spark):
    """A path meets one row for each length of prefixes of its host, however many rules there are."""
    text = "User-agent: *\n" + "\n".join(f"Disallow: /{i:04d}" for i in range(500)) + "\n" + "\n".join(f"Allow: /*{i}" for i in range(50))
    index = crawl.rule_index(crawl.robots_rules(spark.createDataFrame([("h", text)], "host string, text string")))
    urls = spark.createDataFrame([(f"http://h/{i:04d}/x", "h", f"/{i:04d}/x") for i in range(0, 1000, 7)], "url string, host string, path string")
    n = crawl.candidates(urls, index).groupBy("url").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert n == 2


def test_html_text():
    assert html.page_text("<title>T</title><body><nav>n</nav><p>a<br>b</p></body>") == ("T", "T\na\nb")
    assert html.page_text("<p>x &amp; y</p><script>s</script>") == ("", "x & y")


def test_blocks():
    page = """<div><h2>Fees:</h2><p>a<br>b</p><p><strong>Pseudo</strong></p><ul><li>one<ul><li>two</li></ul></li></ul>
    <p>- x<br>- y<br>lead</p><p>Phone: 1<br>Mail: 2</p><table><tr><th>No.</th><th>N</th></tr><tr><td>1</td><td>v|w</td></tr></table>
    <p>see <a href="http://t.x">here</a></p><script>s</script><p><span data-cfemail="42230220"></span></p></div>"""
    got = html.page_rows(page)
    assert [(r.kind, r.text, r.level) for r in got if r.kind in ("heading", "para")] == [("heading", "Fees", 2), ("para", "a b", 0), ("heading", "Pseudo", 2), ("para", "lead", 0), ("para", "see here (http://t.x)", 0), ("para", "a@b", 0)]
    items = {}
    for r in got:
        if r.kind == "item":
            items.setdefault(r.block, []).append((r.level, r.text))
    assert list(items.values()) == [[(0, "one"), (1, "two")], [(0, "x"), (0, "y")], [(0, "Phone: 1"), (0, "Mail: 2")]]
    text = html.markdown(html.settled(got, "Title"), "Title")
    assert "| No. | N |\n|---|---|\n| 1 | v\\|w |" in text and "- one\n  - two" in text and text.startswith("# Title\n\n## Fees")
    with pytest.raises(ValueError):
        html.page_rows(page, "p")
    assert [r.text for r in html.page_rows(page, "div ul li ul")] == ["two"]


def test_addresses_that_hide_nothing_stay(spark):
    pages = [(f'<main><p>a <span data-cfemail="{hidden}">seen</span> b</p><h2><button data-cfemail="{hidden}">x</button> c</h2></main>', "t") for hidden in ("zz", "4", "", "42z", "é0")]
    out = [r[0] for r in spark.createDataFrame(pages, "html string, title string").select(html.markdown_of(F.col("html"), F.col("title"))).collect()]
    assert len(out) == 5 and all("seen" in m and "c" in m for m in out[:3] + out[4:])


def test_rows_of_a_column(spark):
    pages = spark.createDataFrame([(1, "<div id=a><p>x</p></div>"), (2, "<p>y</p>"), (3, None)], "page_id int, html string")
    out = {r["page_id"]: r["r"] for r in pages.select("page_id", html.html_rows(F.col("html"), "#a").alias("r")).collect()}
    assert [r["text"] for r in out[1]["value"]] == ["x"] and out[1]["error"] is None
    assert out[2]["value"] is None and "found 0" in out[2]["error"] and out[3]["value"] is None and out[3]["error"] is None


def test_tabs():
    page = '<a role="tab" href="#a">One</a><a role="tab" data-bs-target="#b">Two</a><a role="tab" href="#none">No</a><div id="a"><p>x</p></div><div id="b"><h3>y</h3></div>'
    assert [(r.block, r.kind, r.level, r.text) for r in html.faq_rows(page)] == [(0, "heading", 2, "One"), (1, "para", 0, "x"), (2, "heading", 2, "Two"), (3, "heading", 3, "y")]


def test_lists_that_go_on_are_joined():
    rows = [html.Row(0, "item", 0, 0, "a:"), html.Row(1, "item", 0, 0, "b"), html.Row(2, "item", 1, 0, "c"), html.Row(3, "number", 0, 0, "d"), html.Row(3, "number", 0, 0, "e")]
    assert html.markdown(html.settled(rows, "T"), "T") == "# T\n\n- a:\n  - b\n  - c\n\n1. d\n2. e\n"


@pytest.mark.parametrize("nest", ["<div>", "<ul><li>", "<p><a href=\"http://x\">", "<b>", "<table><tr><td>", "<h1><button>"])
def test_deep_pages(nest):
    began = time.time()
    rows = html.page_rows(nest * 10_000 + "x")
    assert all(isinstance(r.text, str) for r in rows) and time.time() - began < 20


def test_levels_are_clamped():
    rows = [html.Row(i, "heading", n, 0, str(i)) for i, n in enumerate((2, 4, 4))]
    assert [r.level for r in html.settled(rows, "T")] == [2, 3, 4]
    assert html.heading_levels(["A. x", "I. y", "1. z", "1.1 w"]) == [2, 3, 4, 5]


def test_wide_tables_become_records():
    out = html.table_markdown([["STT", "Tên", "Ghi chú"], ["1", "An", "x" * 200], ["2", "Bo", "a\n- b"]], 2)
    assert out.split("\n") == ["### 1. An", "", "x" * 200, "", "### 2. Bo", "", "a", "", "- b"]


def test_overrides():
    body = "# T\n\n## A\n\nold\n\n### A1\n\nz\n\n## B\n\ny\n"
    assert html.overridden(body, "## A\n\nnew") == "# T\n\n## A\n\nnew\n\n## B\n\ny\n"
    with pytest.raises(ValueError):
        html.overridden(body, "## C\n\nnew")


def test_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.md").write_text(GOOD)
    (tmp_path / "c" / "e.TXT").write_text("x")
    (tmp_path / "c" / "f.pdf").write_text("x")
    assert {r["id"] for r in files.read_text_documents(spark, str(tmp_path / "c")).collect()} == {"d", "e"}
    assert files.read_corpus(spark, str(tmp_path / "c")).first()["title"] == "t"
    (tmp_path / "u.csv").write_text('url , title\n http://a ,"x, ""y"""\n,z\n')
    rows = files.read_urls(spark, str(tmp_path / "u.csv")).collect()
    assert [tuple(r) for r in rows] == [("http://a", 'x, "y"')]
    (tmp_path / "cache.jsonl").write_text('["k",[1.0,2.0]]\n["k",[3.0]]\n')
    assert files.read_cache(spark, str(tmp_path / "cache.jsonl")).first()["value"] == [3.0]
    assert files.read_existing(spark, str(tmp_path / "none.csv")) is None
    new = spark.createDataFrame([("b", "2"), ("a", "1")], "doc_id string, title string")
    files.write_sources(new, str(tmp_path / "s"))
    files.merge_sources(spark, str(tmp_path / "s"), spark.createDataFrame([("a", "9")], "doc_id string, title string"), str(tmp_path / "s2"))
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "s2")).collect()] == [("a", "9"), ("b", "2")]


def test_caches_read_back_what_was_appended(spark, tmp_path):
    vectors, answers = str(tmp_path / "v"), str(tmp_path / "a")
    kind = "key string, value array<double>"
    files.append_cache(spark.createDataFrame([("k", [1.0, 2.5]), ("say \"x\", ]", [0.0]), (None, [1.0])], kind), vectors)
    files.append_cache(spark.createDataFrame([("k", [3.0]), ("n", None)], kind), vectors)
    assert {r["key"]: r["value"] for r in files.read_cache(spark, vectors).collect()} == {"k": [3.0], 'say "x", ]': [0.0]}
    files.append_cache(spark.createDataFrame([("p", 'line\n"two" ] é'), ("q", "")], "key string, value string"), answers)
    assert {r["key"]: r["value"] for r in files.read_cache(spark, answers, "string").collect()} == {"p": 'line\n"two" ] é', "q": ""}


def test_fetch_log_is_not_written_over_itself(spark, tmp_path):
    # A name that the other begins with is another place.
    first, second = str(tmp_path / "l12"), str(tmp_path / "l1")
    files.write_fetch_log(None, spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, bytes int"), first)
    old, new = spark.read.schema("doc_id string, bytes int").json(first), spark.createDataFrame([("a", 9)], "doc_id string, bytes int")
    with pytest.raises(ValueError):
        files.write_fetch_log(old, new, first)
    files.write_fetch_log(old, new, second)
    assert sorted(tuple(r) for r in spark.read.schema("doc_id string, bytes int").json(second).collect()) == [("a", 9), ("b", 2)]


HEAD = "---\ndoc_id: good\ntitle: t\nsource_url: u\nretrieved_at: 2026-01-02\ndocument_version: v\naudience: student\nlanguage: vi\n---\n"
BROKEN = {
    "good.md": "# T\n\n## A\n\nx\n",
    "jump.md": "# T\n\n#### deep\n\nx\n",
    "empty.md": "# T\n\n## A\n\n## B\n\nx\n",
    "twice.md": "# T\n\n## A\n\nx\n\n# U\n",
    "ragged.md": "# T\n\n## A\n\n| a | b |\n|---|---|\n| 1 |\n",
    "gaps.md": "# T\n\n\n\n## A\n\nx\n",
}


def test_every_rule_of_the_contract_fires(spark):
    df = spark.createDataFrame([(f, HEAD + t) for f, t in BROKEN.items()] + [("bare.md", "# T\n")], "file_name string, text string")
    found = {}
    for r in corpus.problems(df).collect():
        found.setdefault(r["file_name"], set()).add(r["problem"].split(":")[0].split(" h1->")[0])
    assert not any(p in found.get("good.md", set()) for p in ("heading level jump", "empty section", "must have exactly one H1, first", "ragged table", "more than one blank line", "doc_id differs from the file name"))
    want = {"jump.md": "heading level jump", "empty.md": "empty section", "twice.md": "must have exactly one H1, first", "ragged.md": "ragged table", "gaps.md": "more than one blank line"}
    assert {f: p for f, p in want.items() if p not in found[f]} == {}
    assert all("doc_id differs from the file name" in found[f] for f in want)
    assert "needs one more field to filter by" in found["bare.md"] and any(p.startswith("missing metadata") for p in found["bare.md"])


def test_verdicts(spark):
    gold = spark.createDataFrame([("q1", ["d1"], [["fee"], ["x"]], [["yes"]]), ("q2", ["d9"], [["fee"]], [["yes"]])], "qid string, gold_docs array<string>, context_keys array<array<string>>, answer_keys array<array<string>>")
    hits = spark.createDataFrame([("s", "q1", 1, "FEE", "d1"), ("s", "q1", 2, "n", "d2"), ("s", "q2", 1, "fee", "d1")], "strategy string, qid string, rank int, content string, doc_id string")
    answers = spark.createDataFrame([("s", "q1", "Yes"), ("s", "q2", "no")], "strategy string, qid string, answer string")
    v = evaluate.verdicts(hits, answers, gold)
    got = {r["qid"]: r for r in v.collect()}
    assert (got["q1"]["score"], got["q1"]["first_relevant"], got["q1"]["coverage"]) == (2, 1, 0.5)
    assert (got["q2"]["score"], got["q2"]["doc_hit"], got["q2"]["answer_ok"]) == (0, False, False)
    s = evaluate.summary(v).first()
    assert (s["score"], s["relevant"], s["mrr"]) == (2, 1, 0.5)
    assert len(evaluate.strategy_matrix({"r": None})) == 8


def test_stream_ingest(spark, tmp_path, sf_dir):
    from corpusloom.streaming.ingest import ingest

    src = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    src.limit(20).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("doc_id").distinct().count() == 20 and out.count() == out.select("id").distinct().count()


def test_texts_are_read_once(spark, tmp_path):
    """All checks stand on one pass; what they read later holds heading lines and no texts. A heading that comes again is
    followed by what follows the first."""
    text = "---\ndoc_id: a\n---\n# T\n\n## P\n\nplain\n\n## P\n\n## Q\n\nplain\n"
    spark.createDataFrame([("a.md", text), ("b.md", None)], "file_name string, text string").write.parquet(f"{tmp_path}/files")
    found = corpus.problems(spark.read.parquet(f"{tmp_path}/files"))
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert [x["problem"] for x in found.collect() if x["problem"].startswith("empty section")] == []
    lines = corpus.headings(spark.createDataFrame([("a", text), ("b", None)], "doc_id string, body string")).orderBy("pos").collect()
    assert [tuple(x) for x in lines] == [("a", 3, 1, "T", "## P"), ("a", 5, 2, "P", "plain"), ("a", 9, 2, "P", "plain"), ("a", 11, 2, "Q", "plain")]


def test_files_of_one_name_are_checked_each_by_itself(spark, tmp_path):
    """headings of files with the same name were taken for those of one file, and documents without doc_id were lost."""
    from corpusloom.plans.queries import ORACLE, QUERIES

    rows = [(1, "a b.", "en", "s"), (1, "c d.\ne f.", "en", "s"), (None, "g", None, None), (None, "h\ni", "fr", "s"), (2, "j", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["corpus_problems"](spark, str(tmp_path)).select("file_name", "problem").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert Counter(got) == Counter(con.execute(ORACLE["corpus_problems"]).fetchall()) and len(got) == 15
    both = spark.createDataFrame([("x.md", "# A\n\n## B\n\ntext\n"), ("x.md", "## B\n\n#### C\n\ntext\n")], "file_name string, text string")
    found = Counter(r["problem"] for r in corpus.problems(both).collect())
    assert found["must have exactly one H1, first"] == 1 and found["heading level jump h2->h4"] == 1
