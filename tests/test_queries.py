"""Every query of the document engine against its SQL."""

import duckdb
import pytest

from folioflow import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(tuple, frame[names].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_equals_sql(spark, con, name):
    got, want = rows(core.queries()[name](spark, SF).toPandas()), rows(con.sql(core.SQL[name]).df())
    assert got == want and got[1]


def test_routes(spark):
    from folioflow.plans.routes import routes

    found = {(r.src, r.dst): r.via for r in routes(spark).collect()}
    assert len(found) == 114 and sum(v == "" for v in found.values()) == 44
    assert found["html", "docx"] == "md" and found["ods", "json"] == "xlsx" and ("pdf", "csv") not in found


# What each format can become, and through which other format.
REACH = """
pdf docx<-md odt<-md rtf<-md html<-md epub<-md md txt
docx pdf odt<-md rtf html<-md epub<-md md txt
odt pdf<-md docx<-md rtf<-md html<-md epub<-md md txt<-md
rtf pdf<-md docx<-md odt<-md html<-md epub<-md md txt
html pdf<-md docx<-md odt<-md rtf<-md epub<-md md txt<-md
epub pdf<-md docx<-md odt<-md rtf<-md html<-md md txt<-md
md pdf docx odt rtf html epub txt pptx odp
txt pdf docx odt<-md rtf<-md html<-md epub<-md md pptx<-md odp<-md
pptx docx<-md odt<-md rtf<-md html<-md epub<-md md txt
odp docx<-md odt<-md rtf<-md html<-md epub<-md md txt
xlsx pdf docx odt<-md rtf<-md html<-md epub<-md md txt ods csv json
ods pdf docx odt<-md rtf<-md html<-md epub<-md md txt xlsx csv json<-xlsx
csv pdf<-md docx<-md odt<-md rtf<-md html<-md epub<-md md txt xlsx ods<-xlsx json<-xlsx
json pdf<-xlsx docx<-xlsx md<-xlsx txt<-xlsx xlsx ods<-xlsx csv<-xlsx
"""


def test_all_routes_and_the_matrix_have_the_expected_values(spark):
    want = {(line.split()[0], *(x.split("<-") + [""])[:2]) for line in REACH.strip().splitlines() for x in line.split()[1:]}
    got = {(r.src, r.dst, r.steps.split(">")[1] if r.steps.count(">") > 1 else "") for r in core.all_routes(spark, SF).collect()}
    assert got == want and len(want) == 114
    kinds = [r.kind for r in core.matrix_cells(spark, SF).collect()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"self": 14, "direct": 44, "routed": 70, "refused": 64, "none": 4}


PAGE = """<html><head><title>x</title></head><body><h1>A <b>bold</b> &amp; <i>it</i></h1><div>text <div>inner</div><div><p>para</p></div></div>
<ul><li>one<ol><li>a</li><li>b</li></ol></li><li>two</li></ul></ul><ol><li>n1</li><li>n2 <a href="u">l</a></li></ol><table><tr><th>h|1</th><th>h2</th></tr><tr></tr><tr><td>c<br>d</td></tr></table>
<pre class="k"><code>x = 1</code></pre><blockquote>q1<br>q2</blockquote><hr><figcaption>lost words</figcaption><p><b><i>deep</i></b> &#8364;<script>no</script></p><p> </p></body></html>"""
MARKDOWN = """# A **bold** & *it*

inner

para

- one
    1. a
    2. b
- two
1. n1
2. n2 [l](u)

| h\\|1 | h2 |
| --- | --- |
| c d |  |

```
x = 1
```

> q1
> q2

---

***deep*** €"""


def test_a_page_as_blocks_and_markdown(spark):
    from folioflow.functions import markup as M
    from folioflow.operators import blocks as B

    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>" + "long words " * 40_000 + "</p>"), (5, "<div>" * 30 + "deep" + "</div>" * 30)], "page_id long, html string")
    found = {r.page_id: r.markdown for r in B.markdown_of(B.page_blocks(pages, "page_id", "html"), "page_id").collect()}
    assert found[1] == MARKDOWN.replace("\\\\", "\\") and set(found) == {1, 4, 5} and len(found[4]) == 439_999 and found[5] == "deep"
    lost = {r.page_id: r.n for r in B.page_parts(pages, "page_id", "html").select("page_id", M.word_count(M.F.col("rest")).alias("n")).collect()}
    assert lost[1] == 3 and lost[5] == 0  # text, lost, words


def test_markdown_as_plain_text(spark):
    from folioflow.functions import markup as M

    source = "# T **b** *i*\n\n> q\n- [l](u) `c` ![p](x)\n  * deep\n1. x\n***\n- - -\n```\n# code\n\n```\nsnake_case _em_ __st__ a * b * c **_n_** ~~s~~\r\n\n\n\nend"
    want = "T b i\n\nq\n• l c p\n  • deep\n1. x\n\n# code\n\nsnake_case em st a * b * c n s\n\nend"
    rows = spark.createDataFrame([(source,), ("",), (None,)], "t string").select(M.markdown_plain_text(M.F.col("t"))).collect()
    assert [r[0] for r in rows] == [want, "", None]


def test_ordinals_of_nested_lists(spark):
    from folioflow.operators import blocks as B

    items = [("bullet", True, 0, 1), ("bullet", True, 1, 1), ("bullet", True, 1, 2), ("bullet", True, 0, 2), ("bullet", True, 1, 1), ("bullet", False, 0, 0), ("bullet", True, 0, 3), ("paragraph", False, 0, 0), ("bullet", True, 0, 1)]
    blocks = spark.createDataFrame([(1, i, *x[:3]) for i, x in enumerate(items)], "doc long, pos long, kind string, ordered boolean, depth int")
    assert [r.ordinal for r in B.ordinals(blocks, "doc").orderBy("pos").collect()] == [x[3] for x in items]


def test_names_and_headers(spark):
    from folioflow.functions import cells as C

    names = ["a.tar.GZ", ".bashrc", "x.", "plain", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(C.extension(C.F.col("n")), C.base_name(C.F.col("n")), C.stem(C.F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("gz", "a.tar", "a.tar"), ("", ".bashrc", ".bashrc"), ("", "x.", "x"), ("", "plain", "plain"), ("", "", ""), (None, None, None)]
    row = spark.createDataFrame([([" a", "", "a", "b ", " "],)], "h array<string>").select(C.distinct_headers(C.F.col("h"))).first()
    assert row[0] == ["a", "column2", "a_3", "b", "column5"]
    table = spark.createDataFrame([([["a", "b|c"], ["x\r\ny"]],), ([],)], "r array<array<string>>").select(C.padded_pipe_table(C.F.col("r")), C.csv_text(C.F.col("r"))).collect()
    assert [tuple(r) for r in table] == [("| a | b\\|c |\n| --- | --- |\n| x y |  |", 'a,b|c\r\n"x\r\ny"'), ("", "")]


def test_unique_names_skip_those_taken(spark):
    from folioflow import operators as O

    names = ["a.csv", "a.csv", "a-2.csv", "a.csv", "b", "b", ".rc", ".rc", "a-4.csv", "a.csv"]
    found = O.unique_names(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string"), "n", "i", share=3).orderBy("i").collect()
    got = [r.unique_name for r in found]
    assert len(set(got)) == len(names) and got == ["a.csv", "a-3.csv", "a-2.csv", "a-5.csv", "b", "b-2", ".rc", ".rc-2", "a-4.csv", "a-6.csv"]


def test_delimited_rows(spark):
    from folioflow.sources.delimited import read_delimited, rows_of

    assert rows_of('a,"b ""q"" c"\r\n,\n"x\ny",z"w,"v,\n', ",") == [["a", 'b "q" c'], ["x\ny", "zw,v", ""]]
    assert rows_of('a;"open;\n rest', ";") == [["a", "open;\n rest"]] and rows_of("", ",") == rows_of("\n,,\n", ",") == [] and rows_of("a|b|", "|") == [["a", "b", ""]]
    long = "cell," * 200_000
    docs = spark.createDataFrame([(1, "x,y", ","), (2, None, ","), (3, "p\tq", "\t"), (4, long, ",")], "k long, t string, d string")
    assert {(r.k, r.pos, len(r.cells)) for r in read_delimited(docs, "k", "t", "d").collect()} == {(1, 0, 2), (3, 0, 2), (4, 0, 200_001)}


def test_what_bytes_types_and_messages_say(spark):
    from folioflow.functions import detect as D

    F = D.F
    heads = [("docx", b"PK\x03\x04rest", (None, False, "archive")), ("docx", b"%PDF-1.4", ("pdf", True, "")), (None, b"{\\rtf1", ("rtf", False, "")), ("docx", bytes.fromhex(D.OLD_OFFICE), (None, False, "old_office")), ("md", b"<html>", ("md", False, "")), ("pdf", b"text", (None, False, "other_bytes")), (None, b"text", (None, False, "unknown")), ("pdf", b"", ("pdf", False, "")), ("md", None, ("md", False, ""))]
    rows = spark.createDataFrame([(c, h) for c, h, _ in heads], "c string, h binary").select(D.detected(F.col("c"), F.col("h")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in rows] == [x for _, _, x in heads]
    rows = spark.createDataFrame([("docx", "xlsx"), ("docx", "docx"), (None, "odt"), ("docx", None)], "c string, i string").select(D.settled(F.col("c"), F.col("i")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in rows] == [("xlsx", True, ""), ("docx", False, ""), ("odt", False, ""), (None, False, "not_a_document")]
    one = lambda f, values, kind="string": [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]
    assert one(D.odf_kind, [" application/vnd.oasis.opendocument.text-template\n".strip(), "application/vnd.oasis.opendocument.presentation", "text/plain", None]) == ["odt", "odp", None, None]
    assert one(D.failure, ["File is ENCRYPTED", "Can't find end of central directory", "Invalid PDF structure", "oops", None]) == ["password", "damaged", "not_pdf", "unreadable", "unreadable"]
    assert one(D.listed, [["b"], ["c", "a", "b"], ["x, y or z", "a"], []], "array<string>") == ["b", "a, b and c", "a; and x, y or z", ""]
    assert one(D.delimiter_name, [",", ";", "\t", "|"]) == ["comma", "semicolon", "tab", "pipe"]
    assert len(D.accepted()) == 25 and D.accepted()[0] == ".pdf"


def test_bytes_as_text(spark):
    from folioflow.sources.texts import decoded

    cases = [("é a".encode(), "é a"), (b"\xef\xbb\xbfa", "a"), (b"\xff\xfe" + "é😀".encode("utf-16-le"), "é😀"), (b"\xfe\xff" + "é😀".encode("utf-16-be"), "é😀"), (b"a\xff", "a\ufffd"), (b"\xff\xfea", "\ufffd"), (b"\xfe\xff", ""), (b"", ""), (None, None)]
    got = spark.createDataFrame([(bytearray(b) if b is not None else None,) for b, _ in cases], "b binary").select(decoded(core.F.col("b"))).collect()
    assert [r[0] for r in got] == [t for _, t in cases]


def test_json_texts_as_sheets(spark):
    from folioflow.sources.records import read_json

    cases = {
        '[{"a": {"b": 1, "c": [1, null, {"d": "é"}]}}, {"e": true, "a": 2.0}]': [("Sheet1", 0, ["a.b", "a.c", "e", "a"]), ("Sheet1", 1, ["1", '1, , {"d":"é"}', "", ""]), ("Sheet1", 2, ["", "", "true", "2"])],
        '[[1, "x"], []]': [("Sheet1", 0, ["1", "x"]), ("Sheet1", 1, [])],
        '{"a": [1], "b": 2, "c": [], "d": [{"x": 1}, {}]}': [("a", 0, ["value"]), ("a", 1, ["1"]), ("d", 0, ["x"]), ("d", 1, ["1"]), ("d", 2, [""])],
        '{"b": null}': [("Sheet1", 0, ["b"]), ("Sheet1", 1, [""])],
        '[{"a": 1}]': [("Sheet1", 0, ["a"]), ("Sheet1", 1, ["1"])],
        '[{"a": 1, "a": {"b": 2, "b": 1.5}}]': [("Sheet1", 0, ["a.b"]), ("Sheet1", 1, ["1.5"])],
    }
    why = {"[]": "empty", "7": "single_value", "null": "single_value", "{": "invalid", "[NaN]": "invalid", "": "invalid", "[" * 200_000: "invalid", None: "invalid", '{"a": []}': "empty", "[{}]": "empty"}
    texts = [*cases, *why]
    got = read_json(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()
    for i, t in enumerate(texts):
        rows = sorted((r.sheet, r.pos, r.name, r.cells) for r in got if r.k == i and r.pos is not None)
        assert [(name, pos, cells) for _, pos, name, cells in rows] == cases.get(t, [])
        assert {r.reason for r in got if r.k == i} == {why.get(t, "")}


def test_blocks_as_rtf(spark):
    from folioflow.operators.rtf import rtf_of

    def block(pos, kind, text=None, level=None, ordered=False, depth=0, rows=None):
        return (1, pos, kind, level, ordered, depth, text, rows)

    blocks = [
        block(0, "heading", "T {1}", 2), block(1, "bullet", "x", ordered=True), block(2, "bullet", "y", ordered=True, depth=9), block(3, "rule"), block(4, "code", "a\tb\n\\c"), block(5, "quote", "é—😀"), block(6, "table", rows=[["p", "q"], ["r", None]]),
        block(7, "table", rows=[]), block(8, "paragraph", None), (2, 0, "paragraph", None, False, 0, "\uffe6", None),
    ]
    got = {r.k: r.rtf.split("\n")[3:] for r in rtf_of(spark.createDataFrame(blocks, "k long, pos int, kind string, level int, ordered boolean, depth int, text string, rows array<array<string>>").repartition(3), "k").collect()}
    assert got[1] == [
        r"\pard\sa180\sb180\b\fs30 T \{1\}\b0\fs24\par", r"\pard\fi-280\li560\sa90 1.\tab x\par", r"\pard\fi-280\li3360\sa90 1.\tab y\par", r"\pard\brdrb\brdrs\brdrw10\brsp20 \par\pard", r"\pard\f1\fs20 a\tab b\par", r"\pard\f1\fs20 \\c\par", r"\pard\f0\fs24",
        r"\pard\li560\sa120\i \u233?\u8212?\u-10179?\u-8704?\i0\par", r"\pard\sa60 p\tab q\par", r"\pard\sa60 r\tab \par", r"\pard\sa120 \par", "}",
    ]
    assert got[2] == [r"\pard\sa120 \u-26?\par", "}"]


def test_sized_paragraphs_as_blocks(spark):
    from folioflow.operators.rtf import sized_blocks

    rows = [(1, 0, 36, False, "Title"), (1, 1, 30, False, "Part."), (1, 2, 24, True, "Run in"), (1, 3, 24, True, "Bold."), (1, 4, None, None, "• item"), (1, 5, 24, False, "3) third"), (1, 6, 20, False, None), (1, 7, 24, True, "b" * 121), (2, 0, 50, False, "alone")]
    got = sized_blocks(spark.createDataFrame(rows, "k long, pos int, size int, bold boolean, text string"), "k").orderBy("k", "pos").collect()
    assert [(r.kind, r.level, r.ordered, r.text) for r in got] == [
        ("heading", 1, False, "Title"), ("heading", 2, False, "Part."), ("heading", 3, False, "Run in"), ("paragraph", None, False, "Bold."), ("bullet", None, False, "item"), ("bullet", None, True, "third"), ("paragraph", None, False, ""), ("paragraph", None, False, "b" * 121), ("paragraph", None, False, "alone"),
    ]


def test_conversions_follow_routes(spark):
    from folioflow.operators.conversions import convert

    files = spark.createDataFrame([(1, "a.b.html", "<script>x</script><h1>T</h1><ul><li>i</li></ul>"), (2, ".html", ""), (3, "n", None)], "id long, name string, text string")
    got = {r.id: (r.name, r.mime, r.text, r.warnings, r.error) for r in convert(files, "html", "txt").collect()}
    assert got == {1: ("a.b.txt", "text/plain", "T\n\n• i", [".html → .md: html_scripts:1"], ""), 2: (".html.txt", "text/plain", "", [], "empty_output"), 3: ("n.txt", "text/plain", "", [], "empty_output")}
    table = spark.createDataFrame([(1, "t.csv", 'a;b\r\n"x;y";"p|q"\r\nonly')], "id long, name string, text string")
    assert convert(table, "csv", "md").first().text == "| a | b |\n| --- | --- |\n| x;y | p\\|q |\n| only |  |" and convert(table, "csv", "txt").first().text.startswith("a;b\r\n")
    for pair in (("pdf", "csv"), ("pdf", "txt")):
        with pytest.raises(ValueError):
            convert(files, *pair)


def test_long_markdown_with_fences_and_many_marks(spark):
    from folioflow.functions.markup import markdown_plain_text

    cases = [
        ("a *b*\r\n```py\r\n*x*\r\n\r\n# y\r\n```\r\n# c", "a b\n*x*\n\n# y\nc"), ("```\n*in*", "*in*"), ("~~~\n~~~\nz", "z"), ("p\n```\n```\n```\n> q\n  ~~~\n> r", "p\n> q\nr"), ("x ``` *y*", "x ``` y"), ("", ""), (None, None),
        ("***~~**deep**~~***", "deep"), ("*a *b*", "*a *b*"), ("w " + "**a " * 50_000, ("w " + "**a " * 50_000).strip()), ("* " * 200_000 + "\nend", "end"), ("w " + "*a* " * 50_000, "w " + ("a " * 50_000).strip()), ("```\n" + "# l\n" * 100_000 + "```", ("# l\n" * 100_000).strip()),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", markdown_plain_text(core.F.col("t"))).collect()
    assert [r[1] for r in sorted(got)] == [t for _, t in cases]


def test_long_elements_of_pages(spark):
    from folioflow.operators.blocks import page_blocks

    words = "word " * 100_000
    html = f"<div><div>{words}</div><p>{words}</p></div><div>{words}<li>lost</div><ul><li>{words}<ul><li>deep</li></ul></li></ul>"
    got = page_blocks(spark.createDataFrame([(1, html)], "k int, h string"), "k", "h").orderBy("pos").collect()
    assert [(r.kind, r.depth) for r in got if len(r.text) > 400_000] == [("paragraph", 0), ("paragraph", 0), ("bullet", 0)] and [(r.text, r.depth) for r in got if r.text == "deep"] == [("deep", 1)]
