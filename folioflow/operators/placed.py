"""Text placed on pages: glyph runs as lines, lines as headings, items and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import size_levels

#: White space as text readers know it, beyond that of ASCII.
SPACES = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
# Marks of items, the end of a sentence, and the gap between paragraphs as a multiple of a line's size.
BULLET, NUMBER, ENDED, GAP = r"^\s*[•·\-*]\s+", r"^\s*\d+[.)]\s+", r"[.!?:][\"')\]]?\z", 1.8
#: Size of a run that has none.
PLAIN_SIZE = 10.0


def lines_of(glyphs: DataFrame, key: str) -> DataFrame:
    """key, page, y, size and text of each line: runs whose baselines round to the same half unit, in order of seq, with the largest of their sizes.

    glyphs: key, page, seq, y, size, text. Runs without text, key or page count for nothing; a y of null is 0, a size of null is PLAIN_SIZE and counts
    without its sign; runs of one seq come in the order of their texts. A line's white space becomes single blanks, and a line of nothing else goes.
    """
    runs = glyphs.filter(F.col(key).isNotNull() & F.col("page").isNotNull() & (F.col("text") != ""))
    placed = runs.select(key, "page", (F.floor(F.coalesce("y", F.lit(0.0)) * 2 + 0.5) / 2).alias("y"), F.abs(F.coalesce("size", F.lit(PLAIN_SIZE))).alias("size"), "seq", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    lines = placed.groupBy(key, "page", "y").agg(F.max("size").alias("size"), F.trim(F.regexp_replace(joined, SPACES, " ")).alias("text"))
    return lines.filter("text <> ''")


def placed_blocks(lines: DataFrame, key: str) -> DataFrame:
    """key, pos, kind, level, ordered, depth and text: lines (key, page, y, size, text) as blocks, from the top of the first page to the foot of the last.

    A line larger than the body's is a heading, by the rank of its size; marked lines are items; what is left are paragraphs, which end at
    other blocks, at a gap, behind a sentence and with their page. So a page is read by itself, and only the counts of sizes are those of the whole
    document: a document of any length is as many groups as it has pages. pos is the page (from bit 32 up) and the block's number on it, so it has gaps.
    Lines of one y come in the order of their texts; rows without key or page are left out.
    """
    rounded = lines.filter(F.col(key).isNotNull() & F.col("page").isNotNull()).withColumn("q", F.floor(F.col("size") * 4 + 0.5) / 4)
    counts = rounded.groupBy(key, "page", "q").agg(F.count("*").alias("n"))
    levels = size_levels(counts.groupBy(key, "q").agg(F.sum("n").alias("n")), [key])
    of_page = counts.join(levels, [key, "q"]).groupBy(key, "page").agg(F.map_from_entries(F.collect_list(F.struct("q", "level"))).alias("levels"))
    read = rounded.join(of_page, [key, "page"])
    kind = F.when(F.element_at("levels", F.col("q")) > 0, "heading").when(F.col("text").rlike(BULLET) | F.col("text").rlike(NUMBER), "bullet").otherwise("paragraph")
    typed = read.select(key, "page", "y", "size", "text", kind.alias("kind"), F.element_at("levels", F.col("q")).alias("level"))
    page = Window.partitionBy(key, "page").orderBy(F.desc("y"), "text")
    before = lambda c: F.lag(c).over(page)
    goes_on = (F.col("kind") == "paragraph") & (before("kind") == "paragraph") & (before("y") - F.col("y") <= F.col("size") * GAP) & ~before("text").rlike(ENDED)
    marked = typed.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("_n", F.sum("_new").over(page.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "text")))
    whole = numbered.groupBy(key, "page", "_n").agg(F.first("kind").alias("kind"), F.max("level").alias("level"), F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"))
    item = F.col("kind") == "bullet"
    pos = F.shiftleft(F.col("page").cast("long"), 32) + F.col("_n")
    ordered = item & ~F.col("text").rlike(BULLET)
    text = F.when(item & ordered, F.regexp_replace("text", NUMBER, "")).when(item, F.regexp_replace("text", BULLET, "")).otherwise(F.col("text"))
    return whole.select(key, pos.alias("pos"), "kind", F.when(F.col("kind") == "heading", F.col("level")).alias("level"), ordered.alias("ordered"), F.lit(0).alias("depth"), text.alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"))


def text_of(lines: DataFrame, key: str) -> DataFrame:
    """key and text: the lines of each document, one below the other."""
    listed = F.array_sort(F.collect_list(F.struct("page", (-F.col("y")).alias("down"), "text")))
    return lines.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"))


def page_losses(docs: DataFrame, lines: DataFrame, key: str, pages: str) -> DataFrame:
    """key, n_pages, n_empty and status of each document (key, the number of its pages): pages without text came through empty, and without any the document is refused."""
    some = lines.select(F.col(key).alias("_key"), "page").distinct().groupBy("_key").agg(F.count("*").alias("_n"))
    found = docs.join(some, F.col(key) == F.col("_key"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    status = F.when(F.col("_n") == 0, "no_text").when(F.col("_n") < F.col(pages), "scanned_pages").otherwise("ok")
    return found.select(key, F.col(pages).cast("long").alias("n_pages"), F.greatest(F.col(pages) - F.col("_n"), F.lit(0)).cast("long").alias("n_empty"), status.alias("status"))
