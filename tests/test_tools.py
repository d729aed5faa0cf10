import json
import time
from http.client import IncompleteRead

import pytest
from pyspark.sql import functions as F

from corpusloom import benchmark, config, demo
from corpusloom.operators import crawl, html, store
from corpusloom.sources import fetch


def test_settings():
    s = config.Settings.read({"EMBEDDING_PROVIDER": " OpenAI ", "OPENAI_EMBEDDING_MODEL": "m"})
    assert s.provider == "openai" and s.models["openai"] == "m" and s.models["local"] == config.MODELS["local"][1]
    assert config.Settings.read({}).embedder() is store.MOCK
    # No key, no library, no such provider: the mock one.
    assert config.Settings.read({"EMBEDDING_PROVIDER": "gemini"}).embedder() is store.MOCK
    assert config.Settings.read({"EMBEDDING_PROVIDER": "nothing"}).embedder() is store.MOCK


def test_fetch_pages(spark):
    def pages(url):
        if url.endswith("/robots.txt"):
            if "//down" in url:
                raise OSError("no answer")
            return b"User-agent: *\nDisallow: /private", "text/plain", url
        if url.endswith("gone"):
            raise OSError("404")
        if url.endswith("cut"):
            raise IncompleteRead(b"half")
        return "<p>é</p>".encode("latin-1"), "application/pdf" if url.endswith("pdf") else "text/html; charset=latin-1", url.replace("/old", "/new")

    urls = ["http://a/x", "http://a/private/y", "http://a/gone", "http://b/f.pdf", "http://b/old", "http://down/x", "ftp://c/x", "nonsense", "http://a/cut", "http://[bad/x"]
    began = time.time()
    out = {r["url"]: r for r in fetch.fetch_pages(spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1), "test", 1.0, get=pages).collect()}
    assert {u: r["status"] for u, r in out.items()} == dict(zip(urls, ["ok", "denied", "failed", "wrong type", "ok", "denied", "denied", "denied", "failed", "denied"], strict=True))
    assert out["http://a/x"]["html"] == "<p>é</p>" and out["http://b/old"]["final_url"] == "http://b/new" and "404" in out["http://a/gone"]["error"]
    # Host a is asked four times: rules, x, gone and cut.
    assert time.time() - began > 3
    assert {r["status"]: r["urls"] for r in crawl.fetch_summary(spark.createDataFrame(list(out.values()))).collect()} == {"ok": 2, "denied": 5, "failed": 2, "wrong type": 1}
    with pytest.raises(ValueError):
        fetch.fetch_pages(spark.createDataFrame([("http://a/x",)], "url string"), "test", 0.1)
    assert fetch.decoded(b"\xe9\xff", "text/html; charset=nope") == "��"


def test_block_profile(spark):
    page = "<h2>A</h2><p>x</p><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table><h2>B</h2><ul><li>i<li>j</ul>"
    rows = spark.createDataFrame([(1, page)], "page_id int, html string").select("page_id", F.explode(html.html_rows(F.col("html"))["value"]).alias("r")).select("page_id", "r.*")
    assert sorted(tuple(r) for r in crawl.block_profile(rows).collect()) == [("cell", 0, 1, 2, 2), ("heading", 2, 2, 0, 0), ("item", 0, 1, 0, 0), ("para", 0, 1, 0, 0)]


HEAD = "---\ntitle: {t}\naudience: {a}\n---\n# {t}\n\n## Fees\n\nThe {t} fee is {n} for a year.\n\n## Other\n\nNothing here.\n"


@pytest.fixture
def corpus_dir(tmp_path):
    for t, a, n in (("lab", "student", 10), ("dorm", "all", 20)):
        (tmp_path / f"{t}.md").write_text(HEAD.format(t=t, a=a, n=n))
    return tmp_path


def test_benchmark_command(spark, corpus_dir, capsys):
    asked = [{"qid": "q1", "question": "What is the lab fee?", "gold_docs": ["lab"], "context_keys": [["fee is 10"]], "answer_keys": [["lab"]], "filter": {"audience": "student"}}, {"qid": "q2", "question": "What is the dorm fee?", "gold_docs": ["dorm"], "context_keys": [["fee is 20"]], "answer_keys": [["dorm"]]}]
    path = corpus_dir / "q.json"
    path.write_text("\n".join(map(json.dumps, asked)))
    assert benchmark.main([str(corpus_dir), str(path), "--only", "structure_aware + hybrid", "--report", str(corpus_dir / "r")]) == 0
    text = capsys.readouterr().out
    assert "q1 | structure_aware + hybrid | 2/2" in text and "4. FILTERS\nq1 | structure_aware + hybrid | with 2" in text and not (corpus_dir / "r").exists()
    with pytest.raises(ValueError):
        benchmark.main([str(corpus_dir), str(path), "--only", "none of these"])


def test_demo(spark, corpus_dir, capsys):
    assert demo.main([str(corpus_dir), "lab", "fee?"]) == 0
    out = capsys.readouterr().out
    assert "Loaded 2 documents" in out and "Answer: [DEMO LLM]" in out
    (corpus_dir / "none").mkdir()
    (corpus_dir / "none" / "x.pdf").write_text("x")
    assert demo.main([str(corpus_dir / "none")]) == 1
