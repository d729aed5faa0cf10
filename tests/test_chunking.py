import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, sections


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("c")).first()["c"]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("abcdefghijklmnopqrst", 10, 2, ["abcdefghij", "ijklmnopqr", "qrst"]),
        ("a" * 100, 25, 0, ["a" * 25] * 4),
        ("abcdefghij", 5, 0, ["abcde", "fghij"]),
        ("", 10, 2, []),
        (" short ", 10, 2, [" short "]),
        ("abcdef", 3, 5, []),
    ],
)
def test_fixed(spark, text, size, overlap, want):
    assert one(spark, lambda t: chunking.fixed(t, size, overlap), text) == want


def test_fixed_counts(spark):
    for overlap, want in ((50, 23), (100, 25)):
        assert len(one(spark, lambda t, o=overlap: chunking.fixed(t, 500, o), "x" * 10_000)) == want
    with pytest.raises(ValueError):
        chunking.fixed(F.lit("a"), 5, 5)


def test_fixed_reassembles(spark):
    text = "".join(random.Random(1).choice("abc \né😀") for _ in range(1234))
    chunks = one(spark, lambda t: chunking.fixed(t, 100, 20), text)
    assert chunks[0] + "".join(c[20:] for c in chunks[1:]) == text
    assert all(len(c) <= 100 for c in chunks)


@pytest.mark.parametrize(("text", "n", "want"), [("A b. C d! E? F", 2, ["A b. C d!", "E? F"]), ("  \n ", 3, []), ("One.", 0, ["One."]), ("a. b.\nc", 1, ["a.", "b.", "c"])])
def test_sentences(spark, text, n, want):
    assert one(spark, lambda t: chunking.sentences(t, n), text) == want


def test_recursive():
    assert chunking.split_recursively("aaaa bbbb cccc", (" ", ""), 10) == ["aaaa bbbb", "cccc"]
    assert chunking.split_recursively("abcdefghij", (), 4) == ["abcd", "efgh", "ij"]
    assert chunking.split_recursively("paragraph one\n\nparagraph two\n\nparagraph three", size=20) == ["paragraph one", "paragraph two", "paragraph three"]
    assert chunking.split_recursively("  ") == []
    text = " ".join("word" * (i % 5 + 1) for i in range(300))
    assert all(len(p) <= 60 for p in chunking.split_recursively(text, size=60))


def test_compare(spark):
    docs = spark.createDataFrame([(1, "AI is here. It learns. " * 20), (2, "")], "doc_id long, text string")
    rows = {(r["doc_id"], r["strategy"]): r for r in chunking.compare(docs).collect()}
    assert set(rows) == {(i, s) for i in (1, 2) for s in ("fixed_size", "by_sentences", "recursive")}
    assert all(r["count"] == len(r["chunks"]) for r in rows.values())
    assert rows[2, "recursive"]["avg_length"] == 0.0


BODY = "# T\n\nintro\n## A\nx\n### A1\ny\n```\n## no\n```\n## B\nz"


def test_section_rows_and_tree_agree(spark):
    docs = spark.createDataFrame([("d", BODY), ("e", ""), ("f", "## A\n#### X\nq\n### Y")], "doc_id string, body string")
    got = {}
    for r in sections.section_rows(docs).orderBy("doc_id", "sec_idx").collect():
        got.setdefault(r["doc_id"], []).append((r["path"], r["own_text"]))

    def flat(o):
        return list(zip(o.path, o.own, strict=True))

    assert got == {r["doc_id"]: flat(sections.Outline(r["body"])) for r in docs.collect()}


def test_leaf_mode():
    c = sections.StructureChunker(mode="leaf", contextual_header=False)
    got = [(x["section_path"], x["content"], x["heading_level"]) for x in c.split("T", "# T\n\nintro\n## A\nx\n### A1\ny\n## B\nz")]
    assert got == [("(mở đầu)", "intro", 1), ("A", "x", 2), ("A > A1", "y", 3), ("B", "z", 2)]


def test_tree_mode_keeps_what_fits_and_groups_small_neighbours():
    c = sections.StructureChunker(contextual_header=False)
    assert [x["section_path"] for x in c.split("T", BODY)] == ["(mở đầu)"]
    c = sections.StructureChunker(max_chars=60, min_chars=40, contextual_header=False)
    body = "## A\n" + "a" * 50 + "\n## B\nb\n## C\nc\n## D\n" + "d" * 50 + "\n## E\ne"
    got = [(x["section_path"], x["content"]) for x in c.split("T", body)]
    assert got == [("A", "a" * 50), ("(mở đầu)", "## B\n\nb\n\n## C\n\nc"), ("D", "d" * 50), ("E", "e")]


def list_filled(units, most):
    return list(sections.filled(units, most))


def test_tables_and_lists_are_cut_by_rows_and_items():
    table = "h\nsep".replace("h", "|h|").replace("sep", "|-|") + "\n|r1|\n|r2|\n|r3|"
    units = list(sections.units_of(table, 10))
    assert units == ["|h|\n|-|\n|r1|", "|h|\n|-|\n|r2|", "|h|\n|-|\n|r3|"]
    assert list_filled(iter(units), 17) == ["|h|\n|-|\n|r1|\n|r2|", "|h|\n|-|\n|r3|"]
    assert list(sections.units_of("- a\n  - b\n- c", 5)) == ["- a\n  - b", "- c"]
    assert list_filled(iter(["- a", "- c"]), 50) == ["- a\n- c"]
    assert list_filled(iter(["|h|\n|-|", "|x|\n|-|"]), 50) == ["|h|\n|-|\n\n|x|\n|-|"]


def test_headers_count_parts():
    c = sections.StructureChunker(max_chars=80)
    got = list(c.split("T", "## A\n" + "\n\n".join("p" * 30 for _ in range(4))))
    assert got[0]["content"].startswith("Tài liệu: T\nMục: A (phần 1/")
    assert [x["part"] for x in got] == list(range(1, len(got) + 1)) and all(len(x["content"]) <= 80 for x in got)


def test_outline_is_flat_and_deep():
    o = sections.Outline("a\n## A\n### B\nx\n###### C\n## D\ny")
    assert o.end == [5, 4, 4, 4, 5] and [o.length(i, o.end[i]) for i in range(5)] == [len(o.markdown(i, o.end[i])) for i in range(5)]
    assert o.inner(1) == "### B\n\nx\n\n###### C" and list(o.below(0)) == [1, 4]
    body = "\n".join(f"{'#' * (2 + i % 5)} s{i}\n{'w ' * (i % 300)}" for i in range(20_000))
    got = list(sections.StructureChunker().split("T", body))
    assert len(got) > 1000 and all(len(x["content"]) <= 2202 for x in got)
