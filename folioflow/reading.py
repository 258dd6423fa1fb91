"""Queries of the readers and writers of whole texts, each with SQL that computes the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import coverage as K
from .operators import html as H
from .operators import links as L
from .sources import table
from .sources.markdown import read_markdown

#: Letters and spaces of a line, an x if there are none.
_clean = lambda c: F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L} ]", "")), F.lit("")), F.lit("x"))
_clean_sql = lambda c: f"coalesce(nullif(trim(regexp_replace(coalesce({c}, ''), '[^\\p{{L}} ]', '', 'g'), ' '), ''), 'x')"


def _joined(key: str, value: Column, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("v")))), lambda x: x["v"]), glue)


def essays(s: SparkSession, d: str, mark: Column | None = None) -> DataFrame:
    """doc and md: conversations as Markdown. A turn is a heading (by its mark), a list three deep of its lines, a fence, a table, a quote and a rule."""
    turns = table(s, d, "conversations").select("conv_id", "turn", _clean(F.col("role")).alias("role"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _clean).alias("l"))
    pick = lambda i, n, *of: F.get(F.array(*map(F.lit, of)), (i % n).cast("int"))
    marked = lambda x, i: F.concat(pick(i, 4, "", "**", "", "`"), x, pick(i, 4, "", "**", "", "`"))
    items = F.array_join(F.transform("l", lambda x, i: F.concat(pick(i, 3, "- ", "  1. ", "     * "), marked(x, i))), "\n")
    first = F.get("l", F.lit(0))
    rows = F.array_join(F.transform(F.slice("l", 1, 3), lambda x, i: F.concat(F.lit("| "), i.cast("string"), F.lit(" | "), x, F.lit(" |"))), "\n")
    md = F.concat(F.lit("## ") if mark is None else mark, F.col("role"), F.lit("\n\n"), items, F.lit("\n\n```\n# "), first, F.lit("\n- "), first, F.lit("\n```\n\n| n | line |\n|---|:-:|\n"), rows, F.lit("\n\n> "), first, F.lit("\n> "), F.col("role"), F.lit("\n\n***\n"))
    return turns.groupBy(F.col("conv_id").alias("doc")).agg(_joined("turn", md, "\n").alias("md"))


def md_blocks(s: SparkSession, d: str) -> DataFrame:
    """The essays read as typed blocks."""
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "¦")), "\n")
    return read_markdown(essays(s, d), "doc", "md").select("doc", "pos", "kind", F.coalesce("level", F.lit(0)).alias("level"), "ordered", "depth", F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(cells, F.lit("")).alias("cells"))


def md_html(s: SparkSession, d: str) -> DataFrame:
    """The essays as whole pages of HTML."""
    made = H.html_of(read_markdown(essays(s, d), "doc", "md"), "doc")
    return made.select("doc", H.page_of(F.concat(F.lit("conversation "), F.col("doc").cast("string")), F.col("html")).alias("html"))


#: Code points that a plain face draws, for the query below: ASCII and some small letters with accents.
COVERED = ((0x00, 0x7F), (0xE0, 0xEF))


def undrawn_characters(s: SparkSession, d: str) -> DataFrame:
    """Characters of documents outside a table of ranges, and the scripts that they are from."""
    covered = s.createDataFrame(list(COVERED), "low int, high int")
    found = K.undrawn(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", covered)
    return found.select("doc_id", "n", F.array_join("scripts", "|").alias("scripts"))


def resolved_links(s: SparkSession, d: str) -> DataFrame:
    """The links of pages that stay on their site, as paths."""
    pages = table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1).alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    some = pages.withColumn("href", F.regexp_replace("href", r"^[a-z]+://[^/]*/", "../"))
    return some.select("page_id", F.col("pos").cast("long").alias("pos"), L.resolved(F.col("base"), F.col("href")).alias("path"))


def _undrawn_sql() -> str:
    rows = lambda xs: ", ".join(f"({', '.join(repr(v) for v in x)})" for x in xs)
    return f"""WITH covered(low, high) AS (VALUES {rows(COVERED)}), scripts(low, high, script) AS (VALUES {rows(K.SCRIPTS)}),
        c AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c FROM documents), p AS (SELECT doc_id, c, unicode(c) AS p FROM c WHERE c <> ''),
        b AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE p.p BETWEEN v.low AND v.high))
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT coalesce(s.script, '{K.OTHER}'), '|' ORDER BY coalesce(s.script, '{K.OTHER}')) AS scripts FROM b LEFT JOIN scripts s ON b.p BETWEEN s.low AND s.high GROUP BY doc_id"""


_LINKS_SQL = r"""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS base, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages),
    e AS (SELECT page_id, base, i - 1 AS pos, regexp_replace(h[i], '^[a-z]+://[^/]*/', '../') AS href FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM l)),
    p AS (SELECT page_id, pos, list_filter(string_split(CASE WHEN strpos(base, '/') > 0 THEN regexp_extract(base, '^(.*/)', 1) ELSE '' END || url_decode(replace(regexp_extract(href, '^([^#]*)', 1), '+', '%2B')), '/'), lambda x: x <> '' AND x <> '.') AS parts FROM e)
    SELECT page_id, pos, ltrim(coalesce(list_reduce(list_prepend('', parts), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END), ''), '/') AS path FROM p"""
_ESSAYS = f"""turns AS (SELECT conv_id AS doc, turn, {_clean_sql('role')} AS role, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_clean_sql('x')}) AS l FROM conversations),
    line AS (SELECT doc, turn, len(l) AS n, i, l[i + 1] AS x FROM (SELECT *, unnest(range(0, len(l))) AS i FROM turns))"""
_inline = "CASE i % 4 WHEN 1 THEN '<strong>' || x || '</strong>' WHEN 3 THEN '<code>' || x || '</code>' ELSE x END"
_row = "'<tr>' || chr(10) || '<{0}>' || {1} || '</{0}>' || chr(10) || '<{0}>' || {2} || '</{0}>' || chr(10) || '</tr>' || chr(10)".format
_BLOCKS_SQL = f"""WITH {_ESSAYS}, b AS (
    SELECT doc, turn, 0 AS part, 0 AS i, 'heading' AS kind, 2 AS level, FALSE AS ordered, 0 AS depth, '' AS lists, role AS text, '' AS cells FROM turns UNION ALL
    SELECT doc, turn, 1, i, 'bullet', 0, i % 3 = 1, CAST(i % 3 AS INTEGER), left('uou', i % 3 + 1), x, '' FROM line UNION ALL
    SELECT doc, turn, 2, 0, 'code', 0, FALSE, 0, '', '# ' || l[1] || chr(10) || '- ' || l[1], '' FROM turns UNION ALL
    SELECT doc, turn, 3, 0, 'table', 0, FALSE, 0, '', '', 'n¦line' || chr(10) || string_agg(i || '¦' || x, chr(10) ORDER BY i) FROM line WHERE i < 3 GROUP BY doc, turn UNION ALL
    SELECT doc, turn, 4, 0, 'quote', 0, FALSE, 0, '', l[1] || chr(10) || role, '' FROM turns UNION ALL
    SELECT doc, turn, 5, 0, 'rule', 0, FALSE, 0, '', '', '' FROM turns)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY turn, part, i) - 1 AS pos, kind, CAST(level AS INTEGER) AS level, ordered, depth, lists, text, cells FROM b"""
_HTML_SQL = f"""WITH {_ESSAYS}, items AS (
    SELECT doc, turn, string_agg(CASE i % 3 WHEN 0 THEN CASE WHEN i = 0 THEN '<ul>' || chr(10) ELSE '' END WHEN 1 THEN '<ol>' || chr(10) ELSE '<ul>' || chr(10) END || '<li>' || {_inline}
        || CASE WHEN i + 1 < n THEN CASE i % 3 WHEN 2 THEN replace('</li>~</ul>~</li>~</ol>~</li>~', '~', chr(10)) ELSE chr(10) END
                ELSE replace(CASE i % 3 WHEN 0 THEN '</li>~</ul>~' WHEN 1 THEN '</li>~</ol>~</li>~</ul>~' ELSE '</li>~</ul>~</li>~</ol>~</li>~</ul>~' END, '~', chr(10)) END, '' ORDER BY i) AS h,
        string_agg({_row('td', "i", "x")}, '' ORDER BY i) FILTER (WHERE i < 3) AS rows FROM line GROUP BY doc, turn),
    whole AS (SELECT t.doc, t.turn, '<h2>' || role || '</h2>' || chr(10) || h || '<pre><code># ' || l[1] || chr(10) || '- ' || l[1] || chr(10) || '</code></pre>' || chr(10)
        || '<table>' || chr(10) || '<thead>' || chr(10) || {_row('th', "'n'", "'line'")} || '</thead>' || chr(10) || '<tbody>' || rows || '</tbody>' || chr(10) || '</table>' || chr(10)
        || '<blockquote>' || chr(10) || '<p>' || l[1] || chr(10) || role || '</p>' || chr(10) || '</blockquote>' || chr(10) || '<hr>' || chr(10) AS h FROM turns t JOIN items i ON i.doc = t.doc AND i.turn = t.turn)
    SELECT doc, replace('<!doctype html>~<html lang="en">~<head>~<meta charset="utf-8">~<meta name="viewport" content="width=device-width, initial-scale=1">~<title>conversation ', '~', chr(10)) || doc || replace('</title>~</head>~<body>~', '~', chr(10))
        || rtrim(string_agg(h, '' ORDER BY turn), chr(10)) || replace('~</body>~</html>~', '~', chr(10)) AS html FROM whole GROUP BY doc"""
SQL = {"md_blocks": _BLOCKS_SQL, "md_html": _HTML_SQL, "undrawn_characters": _undrawn_sql(), "resolved_links": _LINKS_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n in SQL}
