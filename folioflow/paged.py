"""Queries over glyph runs placed on pages, made of the texts of documents, each with SQL that computes the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import placed as P
from .operators.blocks import markdown_of
from .sources import table

#: Words of a run, runs of a line, lines of a page.
WORDS, RUNS, LINES = 4, 3, 40


def glyph_runs(s: SparkSession, d: str) -> DataFrame:
    """doc_id, page, seq, y, size and text: documents set as pages with titles, subtitles, items, wide gaps and baselines that are a little off."""
    words = table(s, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / WORDS).cast("int")), lambda i: F.array_join(F.slice("w", i * WORDS + 1, WORDS), " "))
    runs = words.filter(F.size("w") > 0).select("doc_id", F.posexplode(cut).alias("r", "run"))
    line, within = F.floor(F.col("r") / RUNS), F.col("r") % RUNS
    k, page = line % LINES, F.floor(line / LINES)
    y = F.lit(820.0) - k * 18 - F.when(k >= 20, 30).otherwise(0) + within * 0.0625
    size = F.when(k == 0, 20.0 + page % 3 * 3).when(k % 13 == 5, 14.0).otherwise(11.0) + F.when(within == 1, 0.0625).otherwise(0.0)
    mark = F.when((within == 0) & (k % 11 == 3), "• ").when((within == 0) & (k % 11 == 4), "7) ").otherwise("")
    return runs.select("doc_id", (page + 1).cast("int").alias("page"), F.col("r").alias("seq"), y.alias("y"), size.alias("size"), F.concat(mark, "run", F.lit(" ")).alias("text"))


def glyph_lines(s: SparkSession, d: str) -> DataFrame:
    """Runs as lines."""
    return P.lines_of(glyph_runs(s, d), "doc_id")


def glyph_blocks(s: SparkSession, d: str) -> DataFrame:
    """Lines as headings, items and paragraphs."""
    return P.placed_blocks(glyph_lines(s, d), "doc_id").drop("rows").withColumn("level", F.coalesce("level", F.lit(0)))


def glyph_markdown(s: SparkSession, d: str) -> DataFrame:
    """Pages as Markdown."""
    return markdown_of(P.placed_blocks(glyph_lines(s, d), "doc_id"), "doc_id")


def glyph_texts(s: SparkSession, d: str) -> DataFrame:
    """Pages as plain text."""
    return P.text_of(glyph_lines(s, d), "doc_id")


def scan_losses(s: SparkSession, d: str) -> DataFrame:
    """What documents lose to pages that are pictures: a document has one such page for each of the remainders of its id by 3."""
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = table(s, d, "documents").select("doc_id", (F.ceil(words / (WORDS * RUNS * LINES)) + F.col("doc_id") % 3).alias("pages"))
    return P.page_losses(docs, glyph_lines(s, d), "doc_id", "pages")


_WORD = r"[^\x20\x09-\x0D]+"
_LINES = rf"""w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents),
    r AS (SELECT doc_id, i AS seq, i // {RUNS} // {LINES} AS p, i // {RUNS} % {LINES} AS k, i % {RUNS} AS t, array_to_string(w[i * {WORDS} + 1 : i * {WORDS} + {WORDS}], ' ') AS run FROM (SELECT *, unnest(range(0, (len(w) + {WORDS - 1}) // {WORDS})) AS i FROM w)),
    lines AS (SELECT doc_id, CAST(p + 1 AS INTEGER) AS page, CAST(820 - k * 18 - CASE WHEN k >= 20 THEN 30 ELSE 0 END AS DOUBLE) AS y,
        CAST(CASE WHEN k = 0 THEN 20 + p % 3 * 3 WHEN k % 13 = 5 THEN 14 ELSE 11 END AS DOUBLE) + CASE WHEN max(t) > 0 THEN 0.0625 ELSE 0 END AS size,
        trim(regexp_replace(CASE k % 11 WHEN 3 THEN '• ' WHEN 4 THEN '7) ' ELSE '' END || string_agg(run, ' ' ORDER BY seq), '[\s\x0b\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ' ', 'g')) AS text FROM r GROUP BY doc_id, p, k HAVING text <> '')"""
# lines of a whole document in one order, unlike the query's, which reads a page by itself
_BLOCKS = rf"""{_LINES}, sized AS (SELECT doc_id, list_sort(list(floor(size * 4 + 0.5) / 4)) AS q FROM lines GROUP BY doc_id),
    levels AS (SELECT doc_id, q[len(q) // 2 + 1] AS body, list_reverse_sort(list_distinct(q)) AS q FROM sized),
    typed AS (SELECT l.*, CASE WHEN floor(size * 4 + 0.5) / 4 > body THEN least(list_position(q, floor(size * 4 + 0.5) / 4), 6) ELSE 0 END AS level, regexp_matches(text, '^\s*[•·\-*]\s+') AS dot, regexp_matches(text, '^\s*\d+[.)]\s+') AS num FROM lines l JOIN levels USING (doc_id)),
    kinds AS (SELECT *, CASE WHEN level > 0 THEN 'heading' WHEN dot OR num THEN 'bullet' ELSE 'paragraph' END AS kind FROM typed),
    lagged AS (SELECT *, lag(kind) OVER w AS kind0, lag(page) OVER w AS page0, lag(y) OVER w AS y0, lag(text) OVER w AS text0 FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY page, y DESC)),
    begun AS (SELECT *, CASE WHEN kind = 'paragraph' AND kind0 = 'paragraph' AND page0 = page AND NOT y0 - y > size * 1.8 AND NOT regexp_matches(text0, '[.!?:]["'')\]]?$') THEN 0 ELSE 1 END AS new FROM lagged),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page, y DESC) AS n FROM begun),
    blocks AS (SELECT doc_id, page, n, any_value(kind) AS kind, max(level) AS level, any_value(kind = 'bullet' AND NOT dot) AS ordered, CASE WHEN any_value(kind) <> 'bullet' THEN string_agg(text, ' ' ORDER BY y DESC) WHEN any_value(dot) THEN regexp_replace(any_value(text), '^\s*[•·\-*]\s+', '') ELSE regexp_replace(any_value(text), '^\s*\d+[.)]\s+', '') END AS text FROM islands GROUP BY doc_id, page, n),
    placed AS (SELECT doc_id, page * 4294967296 + row_number() OVER (PARTITION BY doc_id, page ORDER BY n) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place, kind, CAST(level AS INTEGER) AS level, ordered, 0 AS depth, text FROM blocks)"""
# an item's number is one more than that of the item before it in its run of items, when ordered
_MARKDOWN = rf"""{_BLOCKS}, runs AS (SELECT *, sum(CASE WHEN kind = 'bullet' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place) AS run, lag(kind) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM placed),
    counted AS (SELECT *, count(*) FILTER (WHERE kind = 'bullet' AND ordered) OVER (PARTITION BY doc_id, run ORDER BY place) AS ordinal FROM runs)
    SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN before = 'bullet' AND kind = 'bullet' THEN chr(10) ELSE chr(10) || chr(10) END || CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'bullet' THEN CASE WHEN ordered THEN ordinal || '. ' ELSE '- ' END || text ELSE text END, '' ORDER BY place) AS markdown FROM counted GROUP BY doc_id"""
SQL = {
    "glyph_lines": f"WITH {_LINES} SELECT * FROM lines",
    "glyph_blocks": f"WITH {_BLOCKS} SELECT doc_id, pos, kind, level, ordered, depth, text FROM placed",
    "glyph_markdown": f"WITH {_MARKDOWN}",
    "glyph_texts": f"WITH {_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY page, y DESC) AS text FROM lines GROUP BY doc_id",
    "scan_losses": rf"""WITH n AS (SELECT doc_id, CAST(ceil(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) / {WORDS * RUNS * LINES}.0) AS BIGINT) AS n FROM documents)
        SELECT doc_id, n + doc_id % 3 AS n_pages, doc_id % 3 AS n_empty, CASE WHEN n = 0 THEN 'no_text' WHEN doc_id % 3 > 0 THEN 'scanned_pages' ELSE 'ok' END AS status FROM n""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n in SQL}
