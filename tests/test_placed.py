"""Text placed on pages, against literal values."""

import pytest


def blocks(spark, lines):
    from folioflow.operators.placed import placed_blocks

    frame = spark.createDataFrame([(1, *x) for x in lines], "k long, page int, y double, size double, text string")
    return [(r.kind, r.level, r.ordered, r.text) for r in placed_blocks(frame, "k").orderBy("pos").collect()]


@pytest.mark.parametrize(
    "lines, want",
    [
        ([(1, 700.0, 11.0, "No full stop at the end"), (1, 674.0, 11.0, "A second one, far below")], [("paragraph", None, False, "No full stop at the end"), ("paragraph", None, False, "A second one, far below")]),
        ([(1, 700.0, 11.0, "Long enough to wrap, whose line"), (1, 682.5, 11.0, "goes on below"), (1, 665.0, 11.0, "and ends."), (1, 648.0, 11.0, "Next")], [("paragraph", None, False, "Long enough to wrap, whose line goes on below and ends."), ("paragraph", None, False, "Next")]),
        ([(1, 750.0, 22.0, "Report"), (1, 719.0, 11.0, "Body text, which wraps"), (1, 701.5, 11.0, "to a line."), (1, 660.0, 17.0, "Section"), (1, 630.0, 11.0, "More below,"), (1, 612.5, 11.0, "wrapping.")], [("heading", 1, False, "Report"), ("paragraph", None, False, "Body text, which wraps to a line."), ("heading", 2, False, "Section"), ("paragraph", None, False, "More below, wrapping.")]),
        ([(1, 100.0, 11.0, "End of page one"), (2, 700.0, 11.0, "Start of page two")], [("paragraph", None, False, "End of page one"), ("paragraph", None, False, "Start of page two")]),
        ([(1, 90.0, 9.0, "a"), (1, 80.0, 9.0, "• b"), (1, 70.0, 9.0, "12) c"), (1, 60.0, 9.0, "-d"), (1, 50.0, 9.0, 'e."'), (1, 40.0, 9.0, "f")], [("paragraph", None, False, "a"), ("bullet", None, False, "b"), ("bullet", None, True, "c"), ("paragraph", None, False, '-d e."'), ("paragraph", None, False, "f")]),
        ([(1, 10.0 * (10 - i), float(30 - i), f"h{i}") for i in range(9)] + [(2, 10.0 * (20 - i), 5.0, f"p{i}") for i in range(10)], [("heading", min(i + 1, 6), False, f"h{i}") for i in range(9)] + [("paragraph", None, False, f"p{i}") for i in range(10)]),
        ([], []),
    ],
)
def test_lines_as_blocks(spark, lines, want):
    assert blocks(spark, lines) == want


def test_runs_as_lines(spark):
    from folioflow.operators.placed import lines_of, page_losses

    runs = [(1, 1, 3, 700.2, -12.0, "c  "), (1, 1, 1, 699.9, 10.0, " a"), (1, 1, 2, 700.0, None, "b "), (1, 1, 4, 50.25, 8.0, "foot"), (1, 1, 5, None, 8.0, "zero"), (1, 2, 1, 1.0, 8.0, " \n"), (1, 3, 1, 1.0, 8.0, ""), (None, 1, 1, 1.0, 1.0, "x"), (2, None, 1, 1.0, 1.0, "x"), (1, 4, 1, 9.0, 8.0, None)]
    frame = spark.createDataFrame(runs, "k long, page int, seq int, y double, size double, text string")
    lines = lines_of(frame, "k")
    assert [tuple(r) for r in lines.orderBy("k", "page", "y").collect()] == [(1, 1, 0.0, 8.0, "zero"), (1, 1, 50.5, 8.0, "foot"), (1, 1, 700.0, 12.0, "ab c")]
    docs = spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "k long, n int")
    assert {tuple(r) for r in page_losses(docs, lines, "k", "n").collect()} == {(1, 4, 3, "scanned_pages"), (2, 1, 1, "no_text"), (3, 0, 0, "no_text")}
    assert lines_of(frame.filter("false"), "k").count() == 0


def test_one_document_of_many_pages_is_not_one_group(spark):
    from folioflow.operators.placed import placed_blocks

    lines = spark.range(50_000).selectExpr("1L as k", "cast(id div 50 as int) as page", "double(800 - id % 50 * 14) as y", "if(id % 50 = 0, 20D, 11D) as size", "concat('t', id) as text", "id as size_of")
    plan = placed_blocks(lines, "k")
    rows = plan.orderBy("pos").collect()
    assert len(rows) == 2000 and [r.kind for r in rows[:4]] == ["heading", "paragraph"] * 2 and rows[3].text.split(" ")[-1] == "t99"
    assert [r.pos for r in rows] == sorted({r.pos for r in rows})
