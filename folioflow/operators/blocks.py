"""Blocks of documents as rows: read from pages, numbered, grouped into chapters and slides, and put together as Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.functions import cells as C
from folioflow.functions import markup as M
from folioflow.functions import pagefold as P

#: Lists are indented and numbered to this depth.
DEEPEST = 5


#: Bytes of pages that one step of a Python task gives out at a time.
SLICE_BYTES = 4 << 20


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, start, held, sources, rests = batch.column(0), 0, 0, [], []
        for i in range(batch.num_rows):
            html = batch.column(1)[i].as_py()
            found, rest = (None, None) if html is None else P.blocks(P.marked(P.divided(html)))
            sources.append(found)
            rests.append(rest)
            held += len(html or "")
            if held > SLICE_BYTES or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([keys[start : i + 1], pa.array(sources, pa.list_(pa.string())), pa.array(rests, pa.string())], names=[batch.schema.names[0], "sources", "rest"])
                start, held, sources, rests = i + 1, 0, [], []


def page_parts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, sources (the elements of blocks in order, list items marked) and rest (the page without them) of each page."""
    dropped = pages.select(key, M.replaced(F.col(html), M.DROPPED).alias("dropped"))
    body = dropped.select(key, F.when(F.col("dropped").rlike(M.BODY), F.regexp_extract("dropped", M.BODY, 1)).otherwise(F.col("dropped")).alias("body"))
    reduced = body.select(key, M.replaced(F.col("body"), M.UNWRAPPED).alias("reduced"))
    return reduced.mapInArrow(_folded, StructType([reduced.schema[0], *StructType.fromDDL("sources array<string>, rest string")]))


def page_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos (from 0), kind, level, ordered, depth, text and rows: the blocks of each page, texts with Markdown's inline marks.

    Blocks without text and tables without cells are left out, so positions may have gaps.
    """
    return blocks_of(page_parts(pages, key, html), key)


def blocks_of(parts: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """The blocks of `page_parts`; with `whole`, each page has a row at least, if need be one without a kind."""
    found = parts.select(key, (F.posexplode_outer if whole else F.posexplode)("sources").alias("pos", "source"))
    tag = F.lower(F.regexp_extract("source", r"^<(\w+)", 1))
    inner = F.regexp_replace("source", r"^<[^>]*>|</[^>]*>\z", "")
    read = found.select(key, "pos", tag.alias("tag"), F.regexp_extract("source", r"^<[^>]*>", 0).alias("opening"), inner.alias("inner"))
    is_table = F.col("tag") == "table"
    read = read.select(key, "pos", "tag", "opening", F.when(~is_table & (F.col("tag") != "hr"), M.inline_markdown(F.col("inner"))).alias("text"), F.when(is_table, M.table_rows(F.col("inner"))).alias("rows"))
    kind = F.when(F.col("tag").rlike("^h[1-6]$"), "heading").when(F.col("tag") == "li", "bullet").when(F.col("tag") == "blockquote", "quote").when(F.col("tag") == "pre", "code").when(F.col("tag") == "hr", "rule").when(is_table, "table").otherwise("paragraph")
    item = F.col("tag") == "li"
    blocks = read.select(
        key, "pos", kind.alias("kind"),
        F.when(kind == "heading", F.substring("tag", 2, 1).cast("int")).alias("level"),
        (item & F.col("opening").contains("data-ordered")).alias("ordered"),
        F.when(item, F.coalesce(F.regexp_extract("opening", r'data-depth="(\d+)"', 1).try_cast("int"), F.lit(0))).otherwise(0).alias("depth"),
        F.when(item, F.regexp_replace("text", r"^•\s*", "")).otherwise(F.col("text")).alias("text"), "rows",
    )
    some = F.coalesce((F.col("kind") == "rule") | (F.size("rows") > 0) | (F.col("text") != ""), F.lit(False))
    if whole:
        return blocks.filter(some | (F.coalesce("pos", F.lit(0)) == 0)).withColumn("kind", F.when(some, F.col("kind")))
    return blocks.filter(some)


def ordinals(blocks: DataFrame, key: str) -> DataFrame:
    """Adds `ordinal` to ordered bullets: a list ends with a block of another kind, and a deeper count when a shallower item comes.

    The items of a count are those of one depth since the last shallower item; what is not ordered leaves a count as it is.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocks.withColumn("island", F.sum(F.when(F.col("kind") == "bullet", 0).otherwise(1)).over(w))
    deep = [f"above{d}" for d in range(DEEPEST + 1)]
    within = Window.partitionBy(key, "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for d, name in enumerate(deep):  # how many shallower items so far: constant within one count
        out = out.withColumn(name, F.sum(F.when((F.col("kind") == "bullet") & (F.col("depth") < d), 1).otherwise(0)).over(within))
    depth = F.least("depth", F.lit(DEEPEST))
    out = out.withColumn("above", F.element_at(F.array(*deep), depth + 1))
    count = Window.partitionBy(key, "island", "depth", "above").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(F.when((F.col("kind") == "bullet") & F.col("ordered"), 1).otherwise(0)).over(count)
    return out.withColumn("ordinal", F.when((F.col("kind") == "bullet") & F.col("ordered"), n).otherwise(0).cast("int")).drop("island", "above", *deep)


def markdown_of(blocks: DataFrame, key: str) -> DataFrame:
    """key and markdown: the blocks of each document in order, bullets that follow each other on lines of one list."""
    numbered = ordinals(blocks, key)
    text = F.col("text")
    indent = F.repeat(F.lit("    "), F.least("depth", F.lit(DEEPEST)))
    part = (
        F.when(F.col("kind").isNull(), F.lit(None).cast("string"))
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(6))), F.lit(" "), text))
        .when(F.col("kind") == "bullet", F.concat(indent, F.when(F.col("ordered"), F.concat(F.col("ordinal").cast("string"), F.lit(". "))).otherwise("- "), text))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("kind") == "table", C.padded_pipe_table(F.col("rows")))
        .when(F.col("kind") == "rule", F.lit("---"))
        .otherwise(text)
    )
    before = F.lag("kind").over(Window.partitionBy(key).orderBy("pos"))
    gap = F.when(before.isNull(), "").when((before == "bullet") & (F.col("kind") == "bullet"), "\n").otherwise("\n\n")
    parts = numbered.select(key, "pos", F.concat(gap, part).alias("part"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "part")))
    whole = F.array_join(F.transform(listed, lambda x: x["part"]), "")
    return parts.groupBy(key).agg(M.trimmed(F.regexp_replace(whole, r"\n{3,}", "\n\n")).alias("markdown"))


def sections(blocks: DataFrame, key: str, fallback: Column) -> DataFrame:
    """Adds section (from 1) and title: a section begins with each heading of level 1; blocks before the first have the fallback's title.

    Chapters and slides are such sections; the headings that begin them are not among their blocks (`begins`).
    """
    begins = (F.col("kind") == "heading") & (F.col("level") <= 1)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = blocks.withColumns({"begins": begins, "section": F.sum(F.when(begins, 1).otherwise(0)).over(w)})
    return found.withColumn("title", F.when(F.col("section") == 0, fallback).otherwise(F.max(F.when(begins, F.col("text"))).over(Window.partitionBy(key, "section"))))
