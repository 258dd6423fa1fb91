"""Relative references of documents, resolved against where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(base: Column, href: Column) -> Column:
    """The path that href names, seen from the document at path base: percent signs are read, a fragment goes, `.` and empty parts are left out and
    `..` takes back the part before it, if there is one. A reference that cannot be read keeps its percent signs."""
    bare = F.regexp_extract(F.coalesce(href, F.lit("")), r"\A([^#]*)", 1)
    target = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    folder = F.regexp_extract(F.coalesce(base, F.lit("")), r"\A((?:.*/)?)", 1)
    parts = F.filter(F.split(F.concat(folder, target), "/"), lambda p: ~p.isin("", "."))
    up = lambda held, p: F.when(p != "..", F.concat(held, F.array(p))).otherwise(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def reading_order(manifest: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    """key, pos (from 0) and href of the parts of each book that are read, in the order of its spine, or that of its manifest if the spine names none of them.

    manifest: key, at, id, href, type; spine: key, at, idref. Parts that are no XHTML are left out; an id that repeats counts once, the last.
    """
    parts = manifest.filter(F.col("type").contains("xhtml")).groupBy(key, "id").agg(F.max_by(F.struct("at", "href"), "at").alias("x")).select(key, "id", F.col("x.at").alias("place"), "x.href")
    listed = spine.select(F.col(key).alias("_key"), F.col("at").alias("_at"), "idref")
    found = parts.join(listed, (F.col(key) == F.col("_key")) & (F.col("id") == F.col("idref")), "left")
    book = Window.partitionBy(key)
    known = found.withColumn("_some", F.max(F.col("_at").isNotNull()).over(book)).filter(~F.col("_some") | F.col("_at").isNotNull())
    order = F.when(F.col("_some"), F.col("_at")).otherwise(F.col("place"))
    return known.select(key, (F.row_number().over(book.orderBy(order)) - 1).cast("long").alias("pos"), "href")
