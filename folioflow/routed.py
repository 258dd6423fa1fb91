"""Queries of files of many formats taken along their routes at once, each with SQL that computes the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as C
from .operators.conversions import convert_mixed
from .sources import table


def mixed_files(s: SparkSession, d: str) -> DataFrame:
    """id, name, src, dst and text: pages, documents, conversations as CSV and as JSON of three lists, each for a format of its own."""
    pick = lambda n, *of: F.get(F.array(*map(F.lit, of)), F.pmod(n, F.lit(len(of))).cast("int"))
    label = lambda kind, n, end="": F.concat(F.lit(kind), n.cast("string"), F.lit(end))
    pages = table(s, d, "pages").select(label("p", F.col("page_id")).alias("id"), label("page-", F.col("page_id"), ".v1.html").alias("name"), F.lit("html").alias("src"), pick("page_id", "md", "txt", "epub").alias("dst"), F.col("html").alias("text"))
    docs = table(s, d, "documents").select(label("d", F.col("doc_id")).alias("id"), label("doc ", F.col("doc_id")).alias("name"), F.lit("txt").alias("src"), pick("doc_id", "md", "csv", "docx", "ms").alias("dst"), "text")
    row = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    cells = F.concat(F.array(F.array(F.lit("role"), F.lit("text"))), F.transform("t", lambda x: F.array(x["role"], x["text"])))
    csv = turns.select(label("c", F.col("conv_id")).alias("id"), label("talk-", F.col("conv_id"), ".csv").alias("name"), F.lit("csv").alias("src"), pick("conv_id", "md", "json", "pdf").alias("dst"), C.csv_text(cells).alias("text"))
    said = lambda role: F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: F.struct(x["turn"].alias("turn"), F.struct(F.length(x["text"]).alias("chars")).alias("size")))
    texts = F.to_json(F.struct(said("user").alias("The users"), said("assistant").alias("assistant"), F.array(F.struct(F.size("t").alias("turns"))).alias("Total/turns"), F.col("conv_id").alias("n")))
    json = turns.select(label("j", F.col("conv_id")).alias("id"), label("talk-", F.col("conv_id"), ".json").alias("name"), F.lit("json").alias("src"), pick("conv_id", "csv", "csv", "pptx").alias("dst"), texts.alias("text"))
    return pages.unionByName(docs).unionByName(csv).unionByName(json)


def mixed_conversions(s: SparkSession, d: str) -> DataFrame:
    """All files of many formats in one call: several outputs a file, status rows for what cannot be done."""
    return convert_mixed(mixed_files(s, d)).select("id", "name", "fmt", "text", "error")


def loss_ledger(s: SparkSession, d: str) -> DataFrame:
    """What the same conversions lost: files and counts by the formats' ends, step, code and severity."""
    made = convert_mixed(mixed_files(s, d)).select("id", "fmt", F.explode("lost").alias("x"))
    return made.groupBy("fmt", "x.step", "x.code", "x.severity").agg(F.countDistinct("id").alias("n_files"), F.sum("x.n").alias("n"))


def conversion_status(s: SparkSession, d: str) -> DataFrame:
    """How many files of each kind came to what end."""
    made = convert_mixed(mixed_files(s, d))
    return made.groupBy(F.substring("id", 1, 1).alias("kind"), "fmt", "error").agg(F.countDistinct("id").alias("n_files"), F.count("*").alias("n_outputs"))


def sql(core: dict[str, str], losses: dict[str, str]) -> dict[str, str]:
    """SQL of these queries, over that of the core's."""
    made = f"""made AS (
        SELECT 'p' || page_id AS id, 'page-' || page_id || '.v1.md' AS name, 'md' AS fmt, coalesce(markdown, '') AS text, CASE WHEN coalesce(html, '') = '' THEN 'empty_input' WHEN coalesce(markdown, '') = '' THEN 'empty_output' ELSE '' END AS error
        FROM pages LEFT JOIN ({core['page_markdown']}) m USING (page_id) WHERE page_id % 3 = 0 UNION ALL
        SELECT 'p' || page_id, 'page-' || page_id || '.v1.txt', 'txt', text, error FROM ({core['page_text_files']}) WHERE page_id % 3 = 1 UNION ALL
        SELECT 'p' || page_id, 'page-' || page_id || '.v1.html', 'html', '', 'no_engine' FROM pages WHERE page_id % 3 = 2 UNION ALL
        SELECT 'd' || doc_id, CASE WHEN doc_id % 4 = 0 AND coalesce(text, '') <> '' THEN 'doc ' || doc_id || '.md' ELSE 'doc ' || doc_id END, CASE WHEN doc_id % 4 = 0 AND coalesce(text, '') <> '' THEN 'md' ELSE 'txt' END, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') ELSE '' END,
            CASE doc_id % 4 WHEN 0 THEN CASE WHEN coalesce(text, '') = '' THEN 'empty_input' ELSE '' END WHEN 1 THEN 'no_route' WHEN 2 THEN 'no_engine' ELSE 'unknown_format' END FROM documents UNION ALL
        SELECT 'c' || conv_id, 'talk-' || conv_id || '.md', 'md', md, '' FROM ({core['csv_texts']}) WHERE conv_id % 3 = 0 UNION ALL
        SELECT 'c' || conv_id, 'talk-' || conv_id || '.json', 'json', '[' || chr(10) || string_agg('  {{' || chr(10) || '    "role": ' || to_json(role) || ',' || chr(10) || '    "text": ' || to_json(coalesce(text, '')) || chr(10) || '  }}', ',' || chr(10) ORDER BY turn) || chr(10) || ']' || chr(10), '' FROM conversations WHERE conv_id % 3 = 1 GROUP BY conv_id UNION ALL
        SELECT DISTINCT 'c' || conv_id, 'talk-' || conv_id || '.csv', 'csv', '', 'no_engine' FROM conversations WHERE conv_id % 3 = 2 UNION ALL
        SELECT DISTINCT 'j' || conv_id, 'talk-' || conv_id || '.json', 'json', '', 'no_route' FROM conversations WHERE conv_id % 3 = 2 UNION ALL
        SELECT 'j' || c.conv_id, 'talk-' || c.conv_id || '-' || slug || '.csv', 'csv', t, CASE WHEN t = '' THEN 'empty_output' ELSE '' END FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 < 2) c JOIN (
            SELECT conv_id, CASE role WHEN 'user' THEN 'the-users' ELSE 'assistant' END AS slug, 'turn,size.chars' || chr(13) || chr(10) || string_agg(turn || ',' || length(coalesce(text, '')), chr(13) || chr(10) ORDER BY turn) AS t FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id, role UNION ALL
            SELECT conv_id, 'total-turns', 'turns' || chr(13) || chr(10) || count(*) FROM conversations GROUP BY conv_id) s ON s.conv_id = c.conv_id)"""
    counts = " UNION ALL ".join(f"SELECT 'p' || page_id AS id, page_id % 3 AS k, '{c}' AS code, CASE '{c}' WHEN 'html_styles' THEN 'changed' ELSE 'lost' END AS severity, len(regexp_extract_all(html, '{p}', 0, 'i')) AS n FROM pages" for c, p in losses.items())
    ledger = f"""WITH lost AS ({counts} UNION ALL SELECT 'p' || page_id, page_id % 3, 'stranded_words', 'lost', n_words FROM ({core['stranded_words']}))
        SELECT CASE k WHEN 0 THEN 'md' ELSE 'txt' END AS fmt, CASE k WHEN 0 THEN '' ELSE '.html → .md' END AS step, code, severity, count(DISTINCT id) AS n_files, CAST(sum(n) AS BIGINT) AS n FROM lost WHERE k < 2 AND n > 0 GROUP BY ALL UNION ALL
        SELECT 'csv', '.xlsx → .csv', 'multi_sheet_csv', 'note', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT conv_id, 1 + count(DISTINCT role) FILTER (WHERE role IN ('user', 'assistant')) AS n FROM conversations WHERE conv_id % 3 < 2 GROUP BY conv_id) HAVING count(*) > 0 UNION ALL
        SELECT 'csv', '.json → .xlsx', 'json_flattened', 'changed', count(DISTINCT conv_id), CAST(sum(n) AS BIGINT) FROM (SELECT conv_id, 1 + count(DISTINCT role) AS n FROM conversations WHERE conv_id % 3 < 2 AND role IN ('user', 'assistant') GROUP BY conv_id) HAVING count(*) > 0"""
    return {
        "mixed_conversions": f"WITH {made} SELECT id, name, fmt, text, error FROM made",
        "loss_ledger": ledger,
        "conversion_status": f"WITH {made} SELECT left(id, 1) AS kind, fmt, error, count(DISTINCT id) AS n_files, count(*) AS n_outputs FROM made GROUP BY 1, 2, 3",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (mixed_conversions, loss_ledger, conversion_status)}
