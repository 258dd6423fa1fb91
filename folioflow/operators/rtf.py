"""Rich text: blocks written as RTF, and paragraphs with sizes and weights read as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import heading_levels
from .blocks import DEEPEST, ordinals

# The lines that a file begins with, and the sizes of headings by level, in half points.
HEADER = (r"{\rtf1\ansi\ansicpg1252\deff0", r"{\fonttbl{\f0\froman Times New Roman;}{\f1\fmodern Courier New;}}", r"\viewkind4\uc1\pard\f0\fs24")
SIZES = (36, 30, 26, 24, 24, 24)
# What a line of a list begins with.
BULLET, NUMBER = r"^\s*[•\-*·]\s+", r"^\s*\d+[.)]\s+"


def escaped(text: Column) -> Column:
    """Text inside RTF: marks escaped, tabs and line breaks as words, all beyond ASCII as signed 16-bit units."""
    out = text
    for old, new in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\t", "\\tab "), ("\n", "\\par ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    unit = lambda n: F.concat(F.lit("\\u"), F.when(n > 0x7FFF, n - 0x10000).otherwise(n).cast("string"), F.lit("?"))
    high, low = (lambda n: F.shiftright(n - 0x10000, 10) + 0xD800), (lambda n: n.bitwiseAND(0x3FF) + 0xDC00)
    char = lambda c: F.when(F.ascii(c) > 0xFFFF, F.concat(unit(high(F.ascii(c))), unit(low(F.ascii(c))))).when(F.ascii(c) > 127, unit(F.ascii(c))).otherwise(c)
    return F.when(out.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(out, ""), char), "")).otherwise(out)


def rtf_of(blocks: DataFrame, key: str) -> DataFrame:
    """key and rtf: the blocks of each document in order (its columns are those of `page_blocks`); without blocks there is no row."""
    text, line = escaped(F.coalesce("text", F.lit(""))), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    level = F.col("level")
    size = F.coalesce(F.get(F.array(*map(F.lit, SIZES)), level - 1), F.lit(24)).cast("string")
    indent = (F.lit(560) * (F.least("depth", F.lit(DEEPEST)) + 1)).cast("string")
    marker = F.when(F.col("ordered"), line(F.col("ordinal").cast("string"), r".\tab ")).otherwise(F.lit(r"\bullet\tab "))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: line(r"\pard\f1\fs20 ", escaped(x), r"\par"))
    rows = F.transform("rows", lambda r: line(r"\pard\sa60 ", escaped(F.array_join(r, "\t", "")), r"\par"))
    kind = F.col("kind")
    part = (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(kind == "heading", line(r"\pard\sa180\sb180\b\fs", size, " ", text, r"\b0\fs24\par"))
        .when(kind == "bullet", line(r"\pard\fi-280\li", indent, r"\sa90 ", marker, text, r"\par"))
        .when(kind == "code", line(F.array_join(lines, "\n"), "\n", r"\pard\f0\fs24"))
        .when(kind == "quote", line(r"\pard\li560\sa120\i ", text, r"\i0\par"))
        .when(kind == "table", F.when(F.size("rows") > 0, F.array_join(rows, "\n")))
        .when(kind == "rule", F.lit(r"\pard\brdrb\brdrs\brdrw10\brsp20 \par\pard"))
        .otherwise(line(r"\pard\sa120 ", text, r"\par"))
    )
    parts = ordinals(blocks, key).select(key, "pos", part.alias("part"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("pos", "part")))), lambda x: x["part"])
    return parts.groupBy(key).agg(F.array_join(F.concat(F.array(*map(F.lit, HEADER)), listed, F.array(F.lit("}"))), "\n").alias("rtf"))


def sized_blocks(paragraphs: DataFrame, key: str) -> DataFrame:
    """key, pos, kind, level, ordered and text of paragraphs (key, pos, size, bold, text).

    Sizes above the body's, the upper median, are headings, the largest first; short bold paragraphs without a full stop are headings
    one level below these; marks and numbers begin items of lists. A null size is 24, a null text empty.
    """
    filled = paragraphs.select(key, "pos", F.coalesce("size", F.lit(24)).alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("text", F.lit("")).alias("text"))
    ranked = heading_levels(filled, [key], "pos", "size", keep=("bold", "text")).withColumn("deepest", F.max("level").over(Window.partitionBy(key)))
    text = F.col("text")
    run_in = F.col("bold") & (F.length(text) <= 120) & ~text.endswith(".")
    kind = F.when((F.col("level") > 0) | run_in, "heading").when(text.rlike(BULLET) | text.rlike(NUMBER), "bullet").otherwise("paragraph")
    level = F.when(F.col("level") > 0, F.col("level")).when(run_in, F.least(F.col("deepest") + 1, F.lit(6)))
    shown = F.when(F.col("kind") != "bullet", text).when(F.col("ordered"), F.regexp_replace(text, NUMBER, "")).otherwise(F.regexp_replace(text, BULLET, ""))
    read = ranked.withColumns({"kind": kind, "heading": level.cast("int")}).withColumn("ordered", (F.col("kind") == "bullet") & ~text.rlike(BULLET))
    return read.select(key, "pos", "kind", F.col("heading").alias("level"), "ordered", shown.alias("text"))
