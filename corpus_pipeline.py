"""A training corpus in five stages, each one operator of folioflow.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents (doc_id, text, lang, source, n_chars).

1. quality_rules: documents that the policy `web` version 1 rejects go.
2. line_dedup: lines of 20 characters or more that three or more documents hold stay in the largest doc_id alone; n_chars follows.
3. near_duplicates: of each class of rows linked by five-word shingles at 0.8 or more, one row stays: that with the smallest doc_id,
   a null doc_id being the largest; among equal ones the smallest row hash. Rows with a null doc_id are linked like any other, and
   rows that link with nothing stay. Of rows that are equal in all columns one stays, even if they have no words to be linked by.
4. mixing: each document is used as often as its rate says, rounded by a keyed hash; a document used twice is two rows.
5. pieces: the ids of each document under seeded merge-dropout.

Cases: null and empty texts go with the quality rules, which want ten words; a null doc_id passes every other stage (in line_dedup all
rows without one are one document; in mixing it hashes like any other id); ties go as said above; texts of any length are taken whole;
empty tables give no rows; columns beside those of documents are left out by the first stage. This module needs folioflow.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import jaccard, line_dedup, mixing, pieces, quality_rules
from folioflow.llm.common import Scratch, park, table
from folioflow.llm.queries import mixed, tokenizer_path

#: Poor documents went with the quality rules; of what is left, toxic ones shall have this share of the expected tokens.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN 'clean' END"
MIX = {"clean": 0.995, "toxic": 0.005}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.ledger(docs).filter(quality_rules.passes(("web", 1))).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with `row`, a number of 64 bits that only equal rows share.

    It is a hash of the row. Where two different rows have the same, which a second hash tells, both hashes make another; of n rows about
    n * n / 2^65 pairs do, so what is broadcast to tell them are a few numbers even for 10^11 rows.
    """
    hash_of = lambda seed: F.xxhash64(F.lit(seed), *COLUMNS, *[F.isnull(c) for c in COLUMNS])
    rows = docs.select(hash_of("row").alias("row"), hash_of("again").alias("second"), *COLUMNS)
    clash = park(rows.groupBy("row").agg(F.min("second").alias("low"), F.max("second").alias("high")).filter("low <> high").select("row", F.lit(True).alias("shared")))
    number = F.when(F.col("shared"), F.xxhash64("row", "second")).otherwise(F.col("row"))
    return rows.join(F.broadcast(clash), "row", "left").select(number.alias("row"), *COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Classes and the rows that stay are written by themselves, so that no plan holds the whole stage: the driver pays for the size of a plan."""
    rows, scratch = numbered(docs), Scratch(spark)
    linked = jaccard.link(rows.select("row", "text"), key="row", n=5, num=8, den=10)
    classes = scratch.park(linked.select(F.col("doc_id").alias("row"), "component_id").distinct())
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row"))["row"]
    stays = scratch.park(rows.select("row", "doc_id").join(classes, "row").groupBy("component_id").agg(first.alias("row")).select("row"))
    scratch.keep(stays)
    return rows.join(stays, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rated, _, _ = mixed(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), DOMAIN, MIX, COLUMNS)
    used = rated.withColumn("copies", mixing.copies(F.col("rate"), F.col("doc_id"))).filter("copies > 0")
    return used.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")).select("doc_id", "piece_ids", "n_pieces", "ids_crc32", "decoded_equal")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = park(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier and keyed dropout are beyond SQL: every stage and run() are tested against brute force instead.
ORACLE_SQL = None
