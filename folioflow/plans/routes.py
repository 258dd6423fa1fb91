"""Routes over the conversion graph: a direct edge, or else the best two edges with at most one change of family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import relations

#: Candidates are ranked by changes of family, whether they pass through a hub, the worst fidelity and the canonical order.
ROUTES = """
    two AS (
        SELECT a.src, b.dst, a.dst AS via, greatest(a.rank, b.rank) AS rank, greatest(a.peak, a.growth * b.peak) AS peak,
               CASE WHEN s.family <> v.family THEN 1 ELSE 0 END + CASE WHEN v.family <> d.family THEN 1 ELSE 0 END AS crossings, v.hub, v.ord
        FROM edges a JOIN edges b ON a.dst = b.src AND a.src <> b.dst
             JOIN formats s ON s.f = a.src JOIN formats v ON v.f = a.dst JOIN formats d ON d.f = b.dst),
    best AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY crossings, 1 - hub, rank, ord) AS place FROM two WHERE crossings <= 1),
    found AS (
        SELECT src, dst, '' AS via, rank, CAST(peak AS DOUBLE) AS peak FROM edges
        UNION ALL
        SELECT t.src, t.dst, t.via, t.rank, CAST(t.peak AS DOUBLE) FROM best t LEFT JOIN edges e ON e.src = t.src AND e.dst = t.dst WHERE t.place = 1 AND e.src IS NULL),
    routes AS (SELECT f.* FROM found f LEFT JOIN refused r ON r.src = f.src AND r.dst = f.dst WHERE r.src IS NULL)"""


#: What is said of a route: first that it has two steps, then what is said of each step, everything once, where it is said first.
SAID = """
    SELECT src, dst, code, min(place) AS place FROM (
        SELECT src, dst, 'two_steps' AS code, 0 AS place FROM routes WHERE via <> ''
        UNION ALL
        SELECT r.src, r.dst, c.code, 1 FROM routes r JOIN caveats c ON c.src = r.src AND c.dst = CASE WHEN r.via = '' THEN r.dst ELSE r.via END
        UNION ALL
        SELECT r.src, r.dst, c.code, 2 FROM routes r JOIN caveats c ON c.src = r.via AND c.dst = r.dst) GROUP BY src, dst, code"""


def planner(query: str) -> str:
    """SQL of `query` over the relations formats, edges, caveats, refused and routes."""
    return f"WITH {relations()}, {ROUTES} {query}"


def routes(spark: SparkSession) -> DataFrame:
    """src, dst, via ('' for a direct edge), rank of the fidelity, peak memory as a multiple of the input: 114 rows."""
    return spark.sql(planner("SELECT src, dst, via, rank, peak FROM routes"))


def caveats(spark: SparkSession) -> DataFrame:
    """src, dst, code and place (0 of the route, 1 and 2 of its steps): what is said of each route before it is taken."""
    return spark.sql(planner(SAID))


def targets(sizes: DataFrame, spark: SparkSession) -> DataFrame:
    """For documents (fmt, bytes): each target they can reach, how, how many, and the memory that the largest would take.

    Documents are counted by format before they meet the routes, so the graph is joined with a row for each format.
    """
    by_format = sizes.groupBy("fmt").agg(F.count("*").alias("n_docs"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
    joined = by_format.join(F.broadcast(routes(spark)), F.col("fmt") == F.col("src"))
    return joined.select("src", "dst", "via", F.col("rank").cast("int").alias("rank"), "n_docs", "bytes", F.round(F.col("peak") * F.col("largest"), 0).cast("long").alias("peak_bytes"))


#: Formats whose cost is measured against unpacked bytes, and how much larger those are taken to be.
PACKED, UNPACKED = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub"), 8
#: Peak memory of a conversion that nobody has measured, as a multiple of its input.
UNMEASURED = 100


def cautions(sizes: DataFrame, spark: SparkSession, budget: int) -> DataFrame:
    """For documents (fmt, bytes): for each target how many there are, how many may need more memory than the budget, and the most one needs."""
    content = F.col("bytes") * F.when(F.col("fmt").isin(*PACKED), UNPACKED).otherwise(1)
    joined = sizes.join(F.broadcast(routes(spark)), F.col("fmt") == F.col("src"))
    estimate = content * F.floor(F.coalesce("peak", F.lit(float(UNMEASURED))) + 0.5).cast("long")
    return joined.groupBy("src", "dst").agg(F.count("*").alias("n_docs"), F.count_if(estimate > budget).alias("n_warned"), F.max(estimate).alias("estimate"))
