"""Readers and writers of Markdown, HTML and RTF, and conversions of mixed files, against literal values."""

import pytest

MARKDOWN = """# T #
para **x**
goes on

- a
  1. b
     - c

     more b
  2. d
- e
  ```
  - not
  ```
lazy

1) x
2) y

> q1
lazy
> q2
>
> > deep
> - gone

| a | b |
|---|:-:|
| 1 \\| **2** | 3 | 4
| x

Set
===

---
```py
# no

```

    code
      more

<div>
gone
</div>

[ref]: http://x
- [ ] task
* * *
end"""
BLOCKS = [
    ("heading", 1, None, "T"), ("paragraph", None, None, "para x\ngoes on"), ("bullet", None, "u", "a"), ("bullet", None, "uo", "b more b"), ("bullet", None, "uou", "c"), ("bullet", None, "uo", "d"), ("bullet", None, "u", "e\n\n- not\n"), ("paragraph", None, None, "lazy"),
    ("bullet", None, "o", "x"), ("bullet", None, "o", "y"), ("quote", None, None, "q1\nlazy\nq2\n\ndeep"), ("table", None, None, None), ("heading", 1, None, "Set"), ("rule", None, None, None), ("code", None, None, "# no\n"), ("code", None, None, "code\n  more"), ("bullet", None, "u", "task"), ("rule", None, None, None), ("paragraph", None, None, "end"),
]


def test_markdown_as_typed_blocks(spark):
    from folioflow.sources.markdown import read_markdown

    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "<p>only</p>"), (4, "> a\n- b\n\n\ttab"), (5, "- \n-\n1. \n\n\n2. z"), (6, "- x\n" * 30_000)], "k long, t string")
    rows = read_markdown(docs, "k", "t").orderBy("k", "pos").collect()
    assert [(r.kind, r.level, r.lists, r.text) for r in rows if r.k == 1] == BLOCKS
    assert [r.rows for r in rows if r.k == 1 and r.kind == "table"] == [[["a", "b"], ["1 | 2", "3"], ["x", ""]]]
    assert [(r.kind, r.text) for r in rows if r.k == 4] == [("quote", "a"), ("bullet", "b\n\n  tab")]
    assert [(r.kind, r.ordered, r.text) for r in rows if r.k == 5] == [("bullet", False, ""), ("bullet", False, ""), ("bullet", True, ""), ("bullet", True, "z")]
    assert sum(r.k == 6 for r in rows) == 30_000 and not any(r.k in (2, 3) for r in rows)
    assert {(r.k, r.kind) for r in read_markdown(docs.filter("k in (2, 3)"), "k", "t", whole=True).collect()} == {(2, None), (3, None)}


def test_blocks_as_html_with_nested_lists(spark):
    from folioflow.operators.html import html_of, page_of
    from folioflow.sources.markdown import read_markdown
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "- a\n  1. b & `<c>`\n- d\n\n1. x\n\n***\n- only\n  - deep\n    - deeper\n\np **b *i*** [l](u) ~~s~~ a`"), (2, "# h")], "k long, t string")
    got = {r.k: r.html for r in html_of(read_markdown(docs, "k", "t"), "k").collect()}
    assert got[1] == (
        "<ul>\n<li>a\n<ol>\n<li>b &amp; <code>&lt;c&gt;</code></li>\n</ol>\n</li>\n<li>d</li>\n</ul>\n<ol>\n<li>x</li>\n</ol>\n<hr>\n<ul>\n<li>only\n<ul>\n<li>deep\n<ul>\n<li>deeper</li>\n</ul>\n</li>\n</ul>\n</li>\n</ul>\n"
        '<p>p <strong>b <em>i</em></strong> <a href="u">l</a> <del>s</del> a`</p>\n'
    )
    page = spark.createDataFrame([("a<b", None)], "t string, b string").select(page_of(F.col("t"), F.col("b"))).first()[0]
    assert "<title>a&lt;b</title>" in page and page.endswith("<body>\n\n</body>\n</html>\n")


def test_page_to_markdown_to_html_and_back_is_a_fixed_point(spark):
    from folioflow.operators import blocks as B
    from folioflow.operators.html import html_of
    from folioflow.sources.markdown import read_markdown

    html = "<h1>A <b>bold</b> title</h1><p>x &amp; <i>y</i></p><ul><li>one<ol><li>a</li><li>b<ul><li>deep</li></ul></li></ol></li><li>two</li></ul><ol><li>n</li></ol><blockquote>q</blockquote><table><tr><td>h</td><td>i</td></tr><tr><td>1</td><td>2</td></tr></table><hr><pre>x = 1\ny</pre>"
    pages = spark.createDataFrame([(1, html)], "k long, h string")
    once = B.markdown_of(B.page_blocks(pages, "k", "h"), "k")
    again = html_of(read_markdown(once, "k", "markdown"), "k")
    assert B.markdown_of(B.page_blocks(again, "k", "html"), "k").first().markdown == once.first().markdown
    want = [(r.kind, r.level, r.ordered, r.depth, r.text, r.rows) for r in B.page_blocks(pages, "k", "h").orderBy("pos").collect()]
    assert [(r.kind, r.level, r.ordered, r.depth, r.text, r.rows) for r in B.page_blocks(again, "k", "html").orderBy("pos").collect()] == want


RTF = r"""{\rtf1\ansi\ansicpg1252\deff0
{\fonttbl{\f0\froman Times New Roman;}}{\*\generator x;}{\info{\title hidden}}
\viewkind4\uc1\pard\f0\fs24
\pard\b\fs36 A large heading\b0\fs24\par
\pard caf\u233?\'e9 \{x\}\\{\b kept}\b0  on\line new \i it\i0 .\par
\pard\par
\u-10179?\u-8704?\uc2\u8212\'3f?z\emdash\par
\pard\bullet\tab A bullet line\par
}"""


def test_rtf_as_runs_paragraphs_and_text(spark):
    from folioflow.operators.rtf import sized_blocks
    from folioflow.sources.rtf import rtf_paragraphs, rtf_plain_text, rtf_runs

    docs = spark.createDataFrame([(1, RTF), (2, "plain"), (3, None), (4, "{\\rtf1{\\info x}}"), (5, "{\\rtf1 " + "\\b x\\b0 y\\par " * 20_000 + "}"), (6, "{\\rtf1 a}}}\\b b")], "k long, t string")
    runs = rtf_runs(docs, "k", "t")
    rows = runs.orderBy("k", "par", "run").collect()
    assert [tuple(r)[1:7] for r in rows if r.k == 1] == [
        (0, 0, "A large heading", True, False, 36), (1, 0, "caféé {x}\\", False, False, 24), (1, 1, "kept", False, False, 24), (1, 2, " on\nnew ", False, False, 24), (1, 3, "it", False, True, 24), (1, 4, ".", False, False, 24),
        (2, 0, "😀—z—", False, False, 24), (3, 0, "•\tA bullet line", False, False, 24),
    ]
    assert {r.k: r.reason for r in rows if r.k in (2, 3, 4)} == {2: "not_rtf", 3: "not_rtf", 4: "no_text"}
    assert sum(r.k == 5 for r in rows) == 40_000 and [(r.text, r.bold) for r in rows if r.k == 6] == [("a", False), ("b", True)]
    assert {r.k: r.text for r in rtf_plain_text(runs.filter("k = 1"), "k").collect()} == {1: "A large heading\n\ncaféé {x}\\kept on\nnew it.\n\n😀—z—\n\n•\tA bullet line"}
    blocks = sized_blocks(rtf_paragraphs(runs.filter("k = 1"), "k"), "k").orderBy("pos").collect()
    assert [(r.kind, r.level) for r in blocks] == [("heading", 1), ("paragraph", None), ("paragraph", None), ("bullet", None)]


def test_mixed_files_take_their_own_routes(spark):
    from folioflow.operators.conversions import convert, convert_mixed

    files = [
        (1, "a.html", "html", "md", "<p>x</p>"), (1, "a.html", "html", "md", "<p>y</p>"), (1, "a.html", "html", "md", "<p>y</p>"), (2, "b.html", "html", "txt", '<script>s</script><h1>T</h1><table><tr><td colspan=2>c</td></tr></table>lost'), (3, "w.json", "json", "csv", '{"A b": [{"x": {"y": 1}}], "c/d": [2], "e": []}'),
        (4, "n.json", "json", "csv", '[{"a": "q\\"uote"}]'), (5, "s.csv", "csv", "json", "k;v\n1;2\n3"), (6, "s.csv", "csv", "md", ";\n"), (7, "r.md", "md", "rtf", "# H\n\n![i](u)\n\n| a |\n| - |\n| 1 |"), (8, "r.rtf", "rtf", "html", r"{\rtf1\fs40 Big\fs20\par body\par text\par}"), (9, "r.rtf", "rtf", "txt", "no"),
        (10, "m.md", "md", "html", "- a"), (11, "x", "txt", "md", None), (12, "x.pdf", "pdf", "txt", "t"), (13, "x.txt", "txt", "csv", "t"), (14, "x.zip", "zip", "md", "t"), (15, None, "html", "md", "<script>only</script>"), (None, "n.json", "json", "csv", "7"), (16, "big.txt", "txt", "md", "x" * 3000), (17, "t.csv", "csv", "txt", "a,b"),
    ]
    df = spark.createDataFrame(files, "id long, name string, src string, dst string, text string").repartition(3)
    got = sorted(((r.id, r.name, r.fmt, r.text, r.error, [tuple(x) for x in r.lost]) for r in convert_mixed(df, largest=2000).collect()), key=str)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r[1:])
    assert sorted(r[2] for r in by_id[1]) == ["x", "y", "y"]
    assert by_id[2] == [("b.txt", "txt", "T\n\n| c |\n| --- |", "", [(".html → .md", "html_scripts", "lost", 1), (".html → .md", "merged_cells", "changed", 1), (".html → .md", "stranded_words", "lost", 1)])]
    flat, many = (".json → .xlsx", "json_flattened", "changed", 1), (".xlsx → .csv", "multi_sheet_csv", "note", 2)
    assert by_id[3] == [("w-a-b.csv", "csv", "x.y\r\n1", "", [flat, many]), ("w-c-d.csv", "csv", "value\r\n2", "", [flat])]
    assert by_id[4] == [("n.csv", "csv", 'a\r\n"q""uote"', "", [])]
    assert by_id[5] == [("s.json", "json", '[\n  {\n    "k": "1",\n    "v": "2"\n  },\n  {\n    "k": "3",\n    "v": ""\n  }\n]\n', "", [(".csv → .xlsx", "csv_delimiter", "note", 1)])]
    assert by_id[6][0][3] == "no_rows" and by_id[7][0][4] == [("", "rtf_tables", "changed", 1), ("", "md_images", "lost", 1)] and r"\fs36 H" in by_id[7][0][2]
    assert "<h1>Big</h1>\n<p>body</p>" in by_id[8][0][2] and "<title>r</title>" in by_id[8][0][2] and by_id[8][0][4] == [(".rtf → .md", "rtf_headings_inferred", "note", 1)]
    assert {i: by_id[i][0][3] for i in (9, 11, 12, 13, 14, 15, 16, None)} == {9: "not_rtf", 11: "empty_input", 12: "no_engine", 13: "no_route", 14: "unknown_format", 15: "empty_output", 16: "too_large", None: "single_value"}
    assert "<ul>\n<li>a</li>\n</ul>" in by_id[10][0][2] and by_id[17] == [("t.txt", "txt", "a,b", "", [])] and by_id[15][0][0] is None
    # two steps give what one after the other gives
    page = spark.createDataFrame([(2, "b.html", files[3][4])], "id long, name string, text string")
    step = convert(page, "html", "md").select("id", "name", "text")
    assert convert(step, "md", "txt").first().text == by_id[2][0][2] == convert(page, "html", "txt").first().text
    twice = spark.createDataFrame([(1, "a", "<p>x</p>"), (1, "a", "<p>y</p>")], "id long, name string, text string")
    assert sorted(r.text for r in convert(twice, "html", "txt").collect()) == ["x", "y"]
    assert convert_mixed(df.limit(0)).count() == 0


@pytest.mark.parametrize("sheets, want", [([("a", [["x", "x", " "], ["1", "2"]]), ("b\n", [])], '{\n  "a": [\n    {\n      "x": "1",\n      "x_2": "2",\n      "column3": ""\n    }\n  ],\n  "b\\n": []\n}\n'), ([("a", [["h"]])], "[]\n"), ([("a", [[], []])], "[\n  {}\n]\n")])
def test_sheets_as_indented_json(spark, sheets, want):
    from folioflow.functions import cells as C

    df = spark.createDataFrame([(sheets,)], "s array<struct<name:string,rows:array<array<string>>>>")
    assert df.select(C.sheets_json(C.F.col("s"))).first()[0] == want


def test_references_are_resolved_and_books_read_in_order(spark):
    from folioflow.operators.links import reading_order, resolved
    from pyspark.sql import functions as F

    cases = [("OEBPS/content.opf", "text/a%20b.xhtml#x", "OEBPS/text/a b.xhtml"), ("a/b/c", "../../../x", "x"), ("c", "./d//e", "d/e"), ("a/c", "", "a"), (None, "x+y%2", "x+y%2"), ("a/", None, "a")]
    got = spark.createDataFrame([(b, h) for b, h, _ in cases], "b string, h string").select(resolved(F.col("b"), F.col("h"))).collect()
    assert [r[0] for r in got] == [x for _, _, x in cases]
    manifest = spark.createDataFrame([(1, 0, "a", "a.x", "application/xhtml+xml"), (1, 1, "b", "b.x", "application/xhtml+xml"), (1, 2, "i", "i.png", "image/png"), (1, 3, "a", "a2.x", "application/xhtml+xml"), (2, 0, "q", "q.x", "application/xhtml+xml"), (2, 1, "r", "r.x", "application/xhtml+xml")], "book long, at long, id string, href string, type string")
    spine = spark.createDataFrame([(1, 0, "b"), (1, 1, "i"), (1, 2, "a"), (1, 3, "none"), (2, 0, "lost")], "book long, at long, idref string")
    assert sorted(map(tuple, reading_order(manifest, spine, "book").collect())) == [(1, 0, "b.x"), (1, 1, "a2.x"), (2, 0, "q.x"), (2, 1, "r.x")]


def test_undrawn_characters_by_ranges(spark):
    from folioflow.operators.coverage import undrawn

    covered = spark.createDataFrame([(0, 0x7F), (0x70, 0x2FF)], "low int, high int")
    docs = spark.createDataFrame([(1, "aé שלום 日本 😀😀 ←"), (2, "plain é"), (3, None), (4, "")], "k long, t string")
    assert [tuple(r) for r in undrawn(docs, "k", "t", covered).collect()] == [(1, 9, ["Chinese or Japanese", "Hebrew", "emoji", "some rarer letters"])]


def test_files_that_arrive_are_ingested_once_over_restarts(spark, tmp_path):
    from folioflow.streaming import ingest, new_files

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    arrivals = [{"a.html": b"<p>x</p>", "b.TXT": b"plain"}, {"empty.md": b"", "large.csv": b"x" * 300, "no-extension": b"y"}, {}]
    for arrived in arrivals:
        for name, content in arrived.items():
            (folder / name).write_bytes(content)
        ingest(new_files(spark, str(folder), largest=200), str(out), str(tmp_path / "log")).awaitTermination(120)
    got = sorted((r.path.rsplit("/", 1)[1], r.fmt, r.status, r.length, bytes(r.content)) for r in spark.read.parquet(str(out)).collect())
    assert got == [("a.html", "html", "ok", 8, b"<p>x</p>"), ("b.TXT", "txt", "ok", 5, b"plain"), ("large.csv", "csv", "too_large", 300, b"x" * 300), ("no-extension", "", "ok", 1, b"y")]
