"""Documents from the tables at hand, each with its format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fmt and bytes of every page (html), document (txt) and event (json)."""
    of = lambda name, fmt, column: table(spark, sf_dir, name).select(F.lit(fmt).alias("fmt"), F.coalesce(F.octet_length(column), F.lit(0)).cast("long").alias("bytes"))
    return of("pages", "html", "html").unionByName(of("documents", "txt", "text")).unionByName(of("events", "json", "props"))
