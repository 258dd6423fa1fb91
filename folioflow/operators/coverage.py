"""Which characters of documents are outside given ranges of code points, and what their scripts are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ranges of code points and what their script is called; anything else is named by OTHER.
SCRIPTS = (
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"), (0x0750, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x0DFF, "Indic"), (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"), (0x1000, 0x109F, "Burmese"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Korean"), (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1E00, 0x1EFF, "Latin letters with less common accents"),
    (0x1F00, 0x1FFF, "polytonic Greek"), (0x2600, 0x27BF, "emoji"), (0x2E80, 0x9FFF, "Chinese or Japanese"), (0xA000, 0xA4CF, "Yi"), (0xAC00, 0xD7AF, "Korean"), (0xF900, 0xFAFF, "Chinese or Japanese"), (0xFB50, 0xFDFF, "Arabic"),
    (0xFE70, 0xFEFF, "Arabic"), (0xFF00, 0xFFEF, "Chinese or Japanese"), (0x1F000, 0x1FAFF, "emoji"),
)
OTHER = "some rarer letters"
#: Code points of a block, by which ranges and characters meet.
BLOCK = 256


def in_ranges(points: DataFrame, point: str, ranges: DataFrame) -> DataFrame:
    """The rows of points with those of ranges (low, high, ...) that hold them: both are cut into blocks, so the join is one of equal keys."""
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))))
    found = points.withColumn("_block", F.floor(F.col(point) / BLOCK)).join(blocks, "_block")
    return found.filter(F.col(point).between(F.col("low"), F.col("high"))).drop("_block", "low", "high")


def undrawn(docs: DataFrame, key: str, text: str, covered: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """key, n (characters outside the ranges of covered: low, high) and scripts (their names, sorted) of each document that has any.

    Distinct code points of all documents, 1.1 million at most, are looked up once; documents then meet the undrawn ones by broadcast, so no text is
    shuffled and only these are counted. scripts: low, high, script; of ranges that overlap the first in order of low counts.
    """
    spark = docs.sparkSession
    scripts = spark.createDataFrame(list(SCRIPTS), "low int, high int, script string") if scripts is None else scripts
    letters = docs.select(key, text, F.explode(F.array_distinct(F.split(F.coalesce(text, F.lit("")), ""))).alias("_c")).filter("_c <> ''")
    points = letters.select("_c").distinct().withColumn("_p", F.ascii("_c"))
    bare = points.join(in_ranges(points, "_p", covered).select("_c").distinct(), "_c", "left_anti")
    named = in_ranges(bare, "_p", scripts.select("low", "high", "script", F.col("low").alias("_low"))).groupBy("_c").agg(F.min_by("script", "_low").alias("_s"))
    known = bare.join(named, "_c", "left").select("_c", F.coalesce("_s", F.lit(OTHER)).alias("_s"))
    met = letters.join(F.broadcast(known), "_c").select(key, "_s", (F.length(text) - F.length(F.replace(text, F.col("_c"), F.lit("")))).alias("_n"))
    return met.groupBy(key).agg(F.sum("_n").alias("n"), F.array_sort(F.collect_set("_s")).alias("scripts"))
