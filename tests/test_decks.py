"""Decks and what is said of routes, against literal values."""

from folioflow.operators import decks as K
from folioflow.plans import routes as R
from folioflow.sources.markdown import read_markdown

SLIDES = "doc int, slide int, title string, body array<string>, notes array<string>"


def made(spark, *sources):
    docs = spark.createDataFrame(list(enumerate(sources)), "doc int, md string")
    found = K.slides_of(read_markdown(docs, "doc", "md"), "doc").orderBy("doc", "slide").collect()
    return [(r.doc, r.slide, r.title, [(x.text, x.depth) for x in r.body]) for r in found]


def test_headings_of_the_first_level_begin_slides(spark):
    deck = "before\n\n# One\n\n## Part\n\n- a\n  - b\n\n> said\n\n---\n\n# Two\n\n```\nx\n\ny\n```\n\n| h | k |\n|---|---|\n| 1 | 2 |\n"
    assert made(spark, deck) == [
        (0, 1, "", [("before", 0)]),
        (0, 2, "One", [("Part", 0), ("a", 0), ("b", 1), ("said", 0)]),
        (0, 3, "Two", [("x", 0), ("y", 0), ("h — k", 0), ("1 — 2", 0)]),
    ]


def test_empty_slides_go_and_numbers_have_no_gaps(spark):
    assert made(spark, "---\n\n# A\n\n#\n\n# B\n", None, "", "***") == [(0, 1, "A", []), (0, 2, "B", [])]


def test_lists_are_no_deeper_than_slides_allow(spark):
    rows = [(1, 0, "bullet", None, False, 9, "deep", None), (1, 1, "bullet", None, False, 0, None, None), (None, 0, "paragraph", None, False, 0, "x", None), (2, 0, None, None, False, 0, None, None)]
    blocks = spark.createDataFrame(rows, "doc int, pos int, kind string, level int, ordered boolean, depth int, text string, rows array<array<string>>")
    found = {(r.doc, r.slide, tuple((x.text, x.depth) for x in r.body)) for r in K.slides_of(blocks, "doc").collect()}
    assert found == {(1, 1, (("deep", 5),)), (None, 1, (("x", 0),))}
    assert K.slides_of(blocks.limit(0), "doc").count() == 0


def test_decks_as_text_and_markdown_with_notes(spark):
    slides = spark.createDataFrame([(1, 1, "T", ["a", None, "b"], ["n", "m"]), (1, 2, "", [], None), (1, 10, None, None, ["z"]), (1, 3, "U", ["c"], [])], SLIDES)
    row = K.deck_texts(slides, "doc").first()
    assert row.text == "Slide 1\nT\na\nb\n\nNotes:\nn\nm\n\nSlide 2\n\nSlide 3\nU\nc\n\nSlide 10\n\nNotes:\nz"
    assert row.md == "## T\n\n- a\n- b\n\n> n\n> m\n\n## Slide 2\n\n## U\n\n- c\n\n## Slide 10\n\n> z"


def test_slides_that_run_off_their_bottom(spark):
    source = lambda n: "# T\n\n" + "\n".join(f"- {i}" for i in range(n))
    docs = spark.createDataFrame([(1, source(12)), (2, source(13) + "\n\n" + source(12) + "\n\n" + source(40))], "doc int, md string")
    slides = K.slides_of(read_markdown(docs, "doc", "md"), "doc")
    assert [tuple(r) for r in K.overflowing(slides, "doc").collect()] == [(2, 2)]


def test_what_is_said_of_routes(spark):
    said = {}
    for r in R.caveats(spark).orderBy("src", "dst", "place").collect():
        said.setdefault((r.src, r.dst), []).append((r.place, r.code))
    assert said["pdf", "rtf"] == [(0, "two_steps"), (1, "headings_and_paragraphs_inferred"), (2, "tables_as_tabbed_lines")]
    assert said["html", "md"] == [(1, "styling_scripts_images_dropped")]
    assert said["html", "txt"] == [(0, "two_steps"), (1, "styling_scripts_images_dropped")]
    assert ("md", "txt") not in said and ("xlsx", "csv") not in said
    for r in R.routes(spark).collect():
        codes = [c for _, c in said.get((r.src, r.dst), [])]
        assert len(codes) == len(set(codes)) and (codes or (r["rank"] == 0 and not r.via))
