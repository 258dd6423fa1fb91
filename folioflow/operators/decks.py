"""Decks: the blocks of a document as slides, slides as text and as Markdown with their notes, and what a deck cannot hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import DEEPEST, sections

#: A slide with more lines than this runs off its bottom.
FITS = 12


def block_lines(kind: Column, text: Column, depth: Column, rows: Column) -> Column:
    """The lines (text, depth) of a block on a slide: lines of code and rows of tables one by one, a rule and what has no text none."""
    line = lambda t, d: F.struct(t.alias("text"), d.cast("int").alias("depth"))
    none = F.array().cast("array<struct<text:string,depth:int>>")
    flat = lambda lines: F.transform(lines, lambda x: line(x, F.lit(0)))
    made = (
        F.when(kind == "bullet", F.array(line(text, F.least(depth, F.lit(DEEPEST)))))
        .when(kind == "code", flat(F.filter(F.split(text, "\n"), lambda x: x != "")))
        .when(kind == "table", flat(F.transform(rows, lambda r: F.array_join(r, " — ", ""))))
        .when(kind.isin("heading", "paragraph", "quote"), F.array(line(text, F.lit(0))))
    )
    return F.coalesce(F.filter(made, lambda x: x["text"].isNotNull()), none)


def slides_of(blocks: DataFrame, key: str) -> DataFrame:
    """key, slide (from 1), title and body (text, depth) of the slides of documents' blocks (key, pos, kind, level, depth, text, rows).

    A slide begins with each heading of level 1; what comes before the first has no title. Slides without title and lines are left out, and so
    is a document that has no others. Rows of a table are lines of their own, joined by dashes; rules are left out; a null key is a document.
    Blocks shuffle once, by document, for the sections; lines meet again as one row a slide.
    """
    split = sections(blocks, key, F.lit(""))
    lines = split.select(key, "section", "title", "pos", F.when(~F.coalesce("begins", F.lit(False)), block_lines(F.col("kind"), F.col("text"), F.col("depth"), F.col("rows"))).alias("lines"))
    listed = F.array_sort(F.collect_list(F.when(F.size("lines") > 0, F.struct("pos", "lines"))))
    slides = lines.groupBy(key, "section").agg(F.coalesce(F.max("title"), F.lit("")).alias("title"), F.flatten(F.transform(listed, lambda x: x["lines"])).alias("body"))
    some = slides.filter((F.col("title") != "") | (F.size("body") > 0))
    return some.select(key, F.row_number().over(Window.partitionBy(key).orderBy("section")).alias("slide"), "title", "body")


def deck_texts(slides: DataFrame, key: str) -> DataFrame:
    """key, text and md of decks given as slides (key, slide, title, body and notes as arrays of strings).

    As text a slide has its number, its title, its lines and, below `Notes:`, its notes; as Markdown a heading, items and a quote. Null
    arrays are empty, null lines left out, a null title is none.
    """
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    body, notes, title = some(F.col("body")), some(F.col("notes")), F.coalesce("title", F.lit(""))
    number = F.concat(F.lit("Slide "), F.col("slide").cast("string"))
    under = lambda lines, *head: F.when(F.size(lines) > 0, F.concat(F.array(*map(F.lit, head)), lines)).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.array(number), F.when(title != "", F.array(title)).otherwise(F.array().cast("array<string>")), body, under(notes, "", "Notes:"))
    heading = F.concat(F.lit("## "), F.when(title != "", title).otherwise(number))
    md = F.concat(F.array(heading), under(F.transform(body, lambda x: F.concat(F.lit("- "), x)), ""), under(F.transform(notes, lambda x: F.concat(F.lit("> "), x)), ""))
    made = slides.select(key, "slide", F.array_join(text, "\n").alias("text"), F.array_join(md, "\n").alias("md"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide", c))), lambda x: x[c]), "\n\n").alias(c)
    return made.groupBy(key).agg(joined("text"), joined("md"))


def overflowing(slides: DataFrame, key: str) -> DataFrame:
    """key and n: how many slides of a deck have more lines than fit; decks without one are left out."""
    return slides.filter(F.size("body") > FITS).groupBy(key).agg(F.count("*").alias("n"))
