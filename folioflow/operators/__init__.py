"""Ordered operators: blocks, islands, headings, ordinals and losses over exploded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos and paragraph: parts between blank lines, inner line breaks as spaces, empty ones dropped."""
    parts = docs.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "raw"))
    return parts.withColumn("paragraph", F.trim(F.regexp_replace("raw", r"\s*\n\s*", " "))).filter("paragraph <> ''").drop("raw")


def islands(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Numbers runs of rows: a run begins where `starts` holds. Chapters, slides and paragraphs are such runs."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def heading_levels(lines: DataFrame, keys: list[str], order: str, size: str, deepest: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """keys, order, the columns of `keep`, body and level: sizes above the body's as headings, the largest first; the body is the upper median of a document's.

    Equal sizes are counted first, so what a document gathers is a row for each size it has; the lines meet that in one join.
    """
    rounded = lines.withColumn("q", F.floor(F.col(size) * 4 + 0.5) / 4)
    counts = rounded.groupBy(*keys, "q").agg(F.count("*").alias("n"))
    return rounded.join(size_levels(counts, keys, deepest), [*keys, "q"]).select(*keys, order, *keep, "body", "level")


def size_levels(counts: DataFrame, keys: list[str], deepest: int = 6) -> DataFrame:
    """keys, q, body and level of each size q that a document has n times: the rank of what is larger than the body's, 0 for the rest."""
    up = Window.partitionBy(*keys).orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = F.floor(F.sum("n").over(Window.partitionBy(*keys)) / 2)
    body = F.min(F.when(F.col("upto") > F.col("half"), F.col("q"))).over(Window.partitionBy(*keys))
    sized = counts.withColumns({"upto": F.sum("n").over(up), "half": half}).withColumn("body", body)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("q")))
    return sized.withColumn("level", F.when(F.col("q") > F.col("body"), F.least(rank, F.lit(deepest))).otherwise(0)).select(*keys, "q", "body", "level")


def unique_names(files: DataFrame, name: str, order: str, share: int = 10_000) -> DataFrame:
    """Adds unique_name: later files of one name get -2, -3, ... before the extension, but never a name that another file has.

    Files are numbered in ranges of `order`, and the ranges' counts are added up, so that no name's files meet in one task. A made
    name that is taken goes on to the next number that is free, as many times as needed.
    """
    ranged = files.withColumns({"_range": F.floor(F.col(order) / share), "_stem": F.regexp_extract(name, r"^(.+?)(\.[^.]*)?\z", 1), "_end": F.regexp_extract(name, r"^.+?(\.[^.]*)?\z", 1)})
    within = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(name, "_range").orderBy(order)))
    before = Window.partitionBy(name).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(name, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = within.join(counts, [name, "_range"]).withColumn("_k", F.col("_k") + F.col("_before"))
    # a name that looks like one of ours (stem, a number, the same end) and is there itself takes that number
    taken = ranged.select(F.regexp_extract("_stem", r"^(.+)-(\d+)\z", 1).alias("_s"), F.regexp_extract("_stem", r"^(.+)-([1-9]\d*)\z", 2).try_cast("long").alias("_t"), F.col("_end").alias("_e")).filter("_t >= 2").distinct()
    lists = taken.groupBy("_s", "_e").agg(F.array_sort(F.collect_set("_t")).alias("_taken"))
    joined = numbered.join(lists, (F.col("_stem") == F.col("_s")) & (F.col("_end") == F.col("_e")), "left")
    number = F.aggregate(F.coalesce("_taken", F.array().cast("array<long>")), F.col("_k"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    made = F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat("_stem", F.lit("-"), number.cast("string"), "_end"))
    return joined.withColumn("unique_name", made).drop("_range", "_k", "_before", "_s", "_e", "_taken", "_stem", "_end")


def line_islands(lines: DataFrame, keys: list[str], order: str, page: str, y: str, size: str, text: str) -> DataFrame:
    """Numbers the paragraphs of placed lines: one begins on a new page, below a gap of over 1.8 sizes, or behind an ended sentence."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    starts = before(page).isNull() | (before(page) != F.col(page)) | (before(y) - F.col(y) > F.col(size) * 1.8) | F.coalesce(before(text), F.lit("")).rlike(r"[.!?:]\s*$")
    return islands(lines.withColumn("_starts", starts), keys, [order], F.col("_starts"), "paragraph").drop("_starts")


def pipe_tables(rows: DataFrame, key: str, order: list[str], header: str, line: Column) -> DataFrame:
    """key and table: the header, its rule and each group's lines in order, as one text."""
    width = header.count("|") - 1
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(key).agg(F.concat(F.lit(f"{header}\n|{' --- |' * width}\n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("table"))
