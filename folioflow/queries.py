"""Queries of the document engine, each with SQL that computes the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import operators as O
from . import decks, jobs, paged, reading, routed
from .operators import blocks as B
from .functions import cells as C
from .functions import detect as D
from .functions import markup as M
from .plans import routes as R
from .plans.catalog import ALIASES, FIDELITY, FORMATS, values
from .sources import document_sizes, table
from .operators.conversions import convert
from .operators.rtf import rtf_of, sized_blocks
from .sources.delimited import read_delimited, sniffed
from .sources.records import read_json
from .sources.texts import decoded

SIZES = """sizes AS (
    SELECT 'html' AS fmt, coalesce(strlen(html), 0) AS bytes FROM pages UNION ALL SELECT 'txt', coalesce(strlen(text), 0) FROM documents UNION ALL SELECT 'json', coalesce(strlen(props), 0) FROM events)"""
WS_SQL = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def replace_sql(text: str, *steps: tuple[str, str]) -> str:
    """One regexp_replace in another; replacements are SQL expressions."""
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', {new}, 'gi')"
    return text


def trim_sql(text: str) -> str:
    return replace_sql(text, (f"^{WS_SQL}+|{WS_SQL}+$", "''"))


def plain_sql(html: str) -> str:
    return trim_sql(replace_sql(
        html, (r"<\s*(br|/p|/div|/li|/h[1-6]|/tr)\s*/?>", "chr(10)"), (r"<\s*li[^>]*>", "'• '"), (r"<\s*(td|th)[^>]*>", "chr(9)"), ("<[^>]+>", "''"), ("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"),
        ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), (r"[ \t]+\n", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"),
    ))


LOSS_SQL = {"html_scripts": r"<script\b", "html_styles": r"<style\b|<link\b[^>]*stylesheet", "html_images": r"<img\b|<picture\b", "html_frames": r"<iframe\b|<embed\b", "html_forms": r"<form\b"}
ELEMENT_SQL = "|".join(rf"<{t}\b[^>]*>[\s\S]*?</{t}>" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre", "table")) + r"|<hr\b[^>]*/?>"
#: The sample's pages have no division in another and no list in another, so one pass reads them; marks are at most three deep.
REDUCED_SQL = "raw AS (SELECT page_id, " + replace_sql(
    "html", (r"<!--[\s\S]*?-->", "''"), (r"<script\b[\s\S]*?</script>", "''"), (r"<style\b[\s\S]*?</style>", "''"), (r"<head\b[\s\S]*?</head>|<noscript\b[\s\S]*?</noscript>|<svg\b[\s\S]*?</svg>|<template\b[\s\S]*?</template>", "''"),
    (r"<(img|picture|figure|iframe|embed|object|video|audio|canvas|input|button|select|textarea)\b[^>]*/?>", "''"), (r"</(picture|figure|iframe|embed|object|video|audio|canvas|select|textarea|button)>", "''"),
) + " AS h FROM pages), reduced AS (SELECT page_id, " + replace_sql(
    r"CASE WHEN regexp_matches(h, '<body\b[^>]*>([\s\S]*?)</body>', 'i') THEN regexp_extract(h, '<body\b[^>]*>([\s\S]*?)</body>', 1, 'i') ELSE h END",
    (r"<pre\b([^>]*)>\s*<code\b[^>]*>", r"'<pre\1>'"), (r"</code>\s*</pre>", "'</pre>'"), (r"<th\b", "'<td'"), ("</th>", "'</td>'"), (r"</?(section|article|main|header|footer|aside|nav|hgroup)\b[^>]*>", "''"), (r"<div\b[^>]*>([^<]*)</div>", r"'<p>\1</p>'"),
) + " AS h FROM raw)"


def inline_sql(html: str) -> str:
    once = [step for t, mark in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*")) for step in ((rf"<{t}\b[^>]*>(\s*)</{t}>", r"'\1'"), (rf"<{t}\b[^>]*>\s*([^<]*?)\s*</{t}>", rf"'{mark}\1{mark}'"))]
    once += [(r'<a\b[^>]*href="[^"]*"[^>]*>(\s*)</a>', r"'\1'"), (r'<a\b[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', r"'[\2](\1)'")]
    bare = replace_sql(html, *(once * 3), (r"<\s*br\s*/?>", "chr(10)"), ("<[^>]+>", "''"))
    for entity, new in (("nbsp", "' '"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#39", "chr(39)"), ("amp", "'&'")):
        bare = f"replace({bare}, '&{entity};', {new})"
    return trim_sql(replace_sql(bare, (r"[ \t]+", "' '")))


BLOCKS_SQL = REDUCED_SQL + f""", element AS (SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, e[i] AS x, lower(regexp_extract(e[i], '^<([a-zA-Z0-9]+)', 1)) AS tag FROM (SELECT page_id, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(h, '{ELEMENT_SQL}', 0, 'i') AS e FROM reduced))),
    texts AS (SELECT page_id, pos, tag, {inline_sql("regexp_replace(x, '^<[^>]*>|</[^>]*>$', '', 'g')")} AS text FROM element),
    blocks AS (SELECT page_id, pos, CASE WHEN tag LIKE 'h_' AND tag <> 'hr' THEN 'heading' WHEN tag = 'li' THEN 'bullet' WHEN tag = 'blockquote' THEN 'quote' WHEN tag = 'pre' THEN 'code' WHEN tag = 'hr' THEN 'rule' WHEN tag = 'table' THEN 'table' ELSE 'paragraph' END AS kind,
        CASE WHEN tag LIKE 'h_' AND tag <> 'hr' THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS level, CASE WHEN tag = 'hr' THEN NULL WHEN tag = 'li' THEN regexp_replace(text, '^•\\s*', '') ELSE text END AS text FROM texts WHERE tag = 'hr' OR text <> '')"""
#: Markdown that both sides derive: what users say is a heading and quotes, what assistants say is a list, every other item numbered.
NOTES = """notes AS (
    SELECT conv_id AS doc, CAST(turn AS BIGINT) * 1000000 + i - 1 AS pos, CASE WHEN role = 'user' THEN CASE WHEN i = 1 THEN '# ' ELSE '> ' END WHEN i % 2 = 1 THEN '- ' ELSE '1. ' END || l[i] AS line
    FROM (SELECT conv_id, turn, role, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations)))"""
#: A budget of memory for one document in a task, in bytes.
BUDGET = 1 << 20


#: Names of extensions with the format each stands for, and what the first bytes say.
KNOWN = values("known", "name, format", [*[(f, f) for f, _ in FORMATS], *ALIASES])


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text"))
    mark = F.when(F.col("role") == "user", F.when(F.col("i") == 0, "# ").otherwise("> ")).otherwise(F.when(F.col("i") % 2 == 0, "- ").otherwise("1. "))
    return turns.select(F.col("conv_id").alias("doc"), (F.col("turn").cast("long") * 1_000_000 + F.col("i")).alias("pos"), F.concat(mark, "text").alias("line"))


def note_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes as blocks: doc, pos, kind, level, ordered, depth, text."""
    line, text = F.col("line"), F.regexp_replace("line", r"^(#{1,6}|>|-|\d+\.) ", "")
    kind = F.when(line.rlike("^#{1,6} "), "heading").when(line.startswith("> "), "quote").otherwise("bullet")
    return notes(spark, sf_dir).select("doc", "pos", kind.alias("kind"), F.when(kind == "heading", F.length(F.regexp_extract("line", "^(#+)", 1))).alias("level"), line.rlike(r"^\d+\. ").alias("ordered"), F.lit(0).alias("depth"), text.alias("text"))


def html_plain_text(s: SparkSession, d: str) -> DataFrame:
    text = M.html_plain_text(F.col("html"))
    return table(s, d, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), text.alias("text"))


def html_losses(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", *[F.regexp_count("html", F.lit(p)).cast("long").alias(code) for code, _, p in M.LOSSES])


def loss_by_code(s: SparkSession, d: str) -> DataFrame:
    counts = table(s, d, "pages").agg(*[F.sum(F.regexp_count("html", F.lit(p))).alias(code) for code, _, p in M.LOSSES])
    return counts.unpivot([], [code for code, _, _ in M.LOSSES], "code", "n").filter("n > 0")


def loss_tiers(s: SparkSession, d: str) -> DataFrame:
    """How many pages have something lost, and something changed."""
    some = lambda tier: F.greatest(*[F.regexp_count("html", F.lit(p)) for _, t, p in M.LOSSES if t == tier], F.lit(0)) > 0
    tiers = table(s, d, "pages").agg(*[F.count_if(some(t)).alias(t) for t in ("lost", "changed")])
    return tiers.unpivot([], ["lost", "changed"], "severity", "n_pages")


def page_blocks(s: SparkSession, d: str) -> DataFrame:
    return B.page_blocks(table(s, d, "pages"), "page_id", "html").select("page_id", F.col("pos").cast("long").alias("pos"), "kind", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("text", F.lit("")).alias("text"))


def page_markdown(s: SparkSession, d: str) -> DataFrame:
    return B.markdown_of(B.page_blocks(table(s, d, "pages"), "page_id", "html"), "page_id")


def stranded_words(s: SparkSession, d: str) -> DataFrame:
    return B.page_parts(table(s, d, "pages"), "page_id", "html").select("page_id", M.word_count(F.col("rest")).alias("n_words"))


def html_blocks(s: SparkSession, d: str) -> DataFrame:
    """How many blocks of each kind a page gives."""
    kinds = ["heading", "paragraph", "bullet", "quote", "code", "table", "rule"]
    return B.page_blocks(table(s, d, "pages"), "page_id", "html").groupBy("page_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def html_links(s: SparkSession, d: str) -> DataFrame:
    found = table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def html_titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def route_targets(s: SparkSession, d: str) -> DataFrame:
    return R.targets(document_sizes(s, d), s)


def route_refusals(s: SparkSession, d: str) -> DataFrame:
    refused = s.sql(R.planner("SELECT src, dst, rule FROM refused"))
    by_format = document_sizes(s, d).groupBy("fmt").agg(F.count("*").alias("n_docs"))
    grouped = by_format.join(F.broadcast(refused), F.col("fmt") == F.col("src")).groupBy("src", "rule")
    return grouped.agg(F.max("n_docs").alias("n_docs"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("targets"))


def all_routes(s: SparkSession, d: str) -> DataFrame:
    """All routes with their steps and what is said of two steps, and how many documents could take each."""
    by_format = document_sizes(s, d).groupBy("fmt").agg(F.count("*").alias("n_docs"))
    steps = F.when(F.col("via") == "", F.concat_ws(">", "src", "dst")).otherwise(F.concat_ws(">", "src", "via", "dst"))
    caveat = F.when(F.col("via") == "", "").otherwise(F.concat(F.lit("two_steps:"), "via"))
    found = R.routes(s).join(F.broadcast(by_format), F.col("fmt") == F.col("src"), "left")
    return found.select("src", "dst", steps.alias("steps"), F.element_at(F.array(*map(F.lit, FIDELITY)), F.col("rank") + 1).alias("fidelity"), caveat.alias("caveat"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def matrix_cells(s: SparkSession, d: str) -> DataFrame:
    """All 196 cells, with the documents at hand of each row."""
    cells = s.sql(R.planner("""SELECT a.f AS src, b.f AS dst, CASE WHEN a.f = b.f THEN 'self' WHEN x.rule IS NOT NULL THEN 'refused' WHEN r.via = '' THEN 'direct' WHEN r.via IS NOT NULL THEN 'routed' ELSE 'none' END AS kind
        FROM formats a JOIN formats b ON TRUE LEFT JOIN routes r ON r.src = a.f AND r.dst = b.f LEFT JOIN refused x ON x.src = a.f AND x.dst = b.f"""))
    by_format = document_sizes(s, d).groupBy("fmt").agg(F.count("*").alias("n_docs"))
    return cells.join(F.broadcast(by_format), F.col("fmt") == F.col("src"), "left").select("src", "dst", "kind", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def size_caution(s: SparkSession, d: str) -> DataFrame:
    return R.cautions(document_sizes(s, d), s, BUDGET)


def admission(s: SparkSession, d: str) -> DataFrame:
    """Each format at hand with its default target, the first in canonical order, and how many documents are empty or too large."""
    first = s.sql(R.planner("SELECT r.src, min_by(r.dst, f.ord) AS target FROM routes r JOIN formats f ON f.f = r.dst GROUP BY r.src"))
    by_format = document_sizes(s, d).groupBy(F.col("fmt").alias("src")).agg(F.count("*").alias("n_docs"), F.count_if(F.col("bytes") == 0).alias("n_empty"), F.count_if(F.col("bytes") > 100 << 20).alias("n_too_large"))
    return by_format.join(F.broadcast(first), "src")


def last_states(s: SparkSession, d: str) -> DataFrame:
    """The last state of each job in a log of events: a job is a user, its state the type of the latest event."""
    return table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))


def txt_paragraphs(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("text"))
    return O.paragraphs(turns, "conv_id", "text").groupBy("conv_id").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("paragraph")).alias("n_chars"))


def conversation_blocks(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", F.row_number().over(w).cast("long").alias("pos"), "role", F.coalesce(F.lag("role").over(w) == F.col("role"), F.lit(False)).alias("same_speaker"))


def md_plain_lines(s: SparkSession, d: str) -> DataFrame:
    return notes(s, d).select("doc", "pos", M.markdown_line(F.col("line")).alias("line"))


def md_headings(s: SparkSession, d: str) -> DataFrame:
    return notes(s, d).filter(F.col("line").rlike("^#{1,6} ")).select("doc", "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).cast("int").alias("level"), F.regexp_replace("line", r"^#+ +|\*\*", "").alias("heading"))


def chapters(s: SparkSession, d: str) -> DataFrame:
    split = B.sections(note_blocks(s, d), "doc", F.concat(F.lit("conversation "), F.col("doc").cast("string")))
    return split.groupBy("doc", "section", "title").agg(F.count_if(~F.col("begins")).alias("n_blocks")).filter("title <> '' or n_blocks > 0")


def slides(s: SparkSession, d: str) -> DataFrame:
    """Decks of the notes: a slide for each heading of level 1, everything else as its bullets in order."""
    split = B.sections(note_blocks(s, d), "doc", F.lit(""))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("begins"), F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    return split.groupBy("doc", "section", "title").agg(F.count_if(~F.col("begins")).alias("n_bullets"), lines.alias("body")).filter("title <> '' or n_bullets > 0")


def slide_overflow(s: SparkSession, d: str) -> DataFrame:
    return slides(s, d).groupBy("doc").agg(F.count("*").alias("n_slides"), F.count_if(F.col("n_bullets") > 12).alias("n_overflowing"))


def ordinals(s: SparkSession, d: str) -> DataFrame:
    return B.ordinals(note_blocks(s, d), "doc").filter("ordered").select("doc", "pos", "ordinal")


def note_markdown(s: SparkSession, d: str) -> DataFrame:
    """The notes' blocks put together as Markdown again."""
    return B.markdown_of(note_blocks(s, d).withColumn("rows", F.lit(None).cast("array<array<string>>")), "doc")


def md_plain_text(s: SparkSession, d: str) -> DataFrame:
    source = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return notes(s, d).groupBy("doc").agg(source.alias("source")).select("doc", M.markdown_plain_text(F.col("source")).alias("text"))


def csv_texts(s: SparkSession, d: str) -> DataFrame:
    """Each conversation as a CSV text with a header, and as a pipe table."""
    row = F.array("role", F.coalesce("text", F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))), lambda x: x["row"])
    listed = table(s, d, "conversations").groupBy("conv_id").agg(F.concat(F.array(F.array(F.lit("role"), F.lit("text"))), rows).alias("rows"))
    return listed.select("conv_id", C.csv_text(F.col("rows")).alias("csv"), C.padded_pipe_table(F.col("rows")).alias("md"))


def csv_rows(s: SparkSession, d: str) -> DataFrame:
    """Conversations written as CSV texts and read back: the cells of each turn."""
    texts = csv_texts(s, d).select("conv_id", "csv", F.lit(",").alias("delimiter"))
    rows = read_delimited(texts, "conv_id", "csv", "delimiter").filter("pos > 0")
    return rows.select("conv_id", "pos", F.get("cells", F.lit(0)).alias("role"), F.get("cells", F.lit(1)).alias("text"))


def deck_texts(s: SparkSession, d: str) -> DataFrame:
    """Slides as numbered blocks of text, and as Markdown with a heading for each."""
    number = F.concat(F.lit("Slide "), F.col("section").cast("string"))
    lines = F.when(F.col("n_bullets") > 0, F.concat(F.lit("\n"), F.col("body"))).otherwise("")
    text = F.concat(number, F.when(F.col("title") != "", F.concat(F.lit("\n"), F.col("title"))).otherwise(""), lines)
    items = F.when(F.col("n_bullets") > 0, F.concat(F.lit("\n\n- "), F.replace("body", F.lit("\n"), F.lit("\n- ")))).otherwise("")
    md = F.concat(F.lit("## "), F.when(F.col("title") != "", F.col("title")).otherwise(number), items)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", c))), lambda x: x[c]), "\n\n").alias(c)
    return slides(s, d).select("doc", "section", text.alias("text"), md.alias("md")).groupBy("doc").agg(joined("text"), joined("md"))


def json_header(s: SparkSession, d: str) -> DataFrame:
    """Columns of the records in props, in the order in which they are first seen."""
    keys = table(s, d, "events").select("event_id", F.posexplode(F.json_object_keys("props")).alias("at", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("event_id", "at")).alias("first"))
    return first.select("key", F.col("first.event_id").alias("event_id"), F.col("first.at").cast("long").alias("place"))


def page_names(s: SparkSession, d: str) -> DataFrame:
    """Names of files that pages came in and would go out with."""
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"([^/]*)\z", 1)
    found = table(s, d, "pages").select("page_id", name.alias("name"))
    return found.select("page_id", C.extension(F.col("name")).alias("extension"), C.base_name(F.col("name")).alias("base"), F.concat(C.stem(F.col("name")), F.lit(".md")).alias("output"))


def order_headers(s: SparkSession, d: str) -> DataFrame:
    """Headers as they come from data, made distinct: the sizes of an order's items."""
    header = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_quantity") < 5, " ").otherwise(F.concat(F.lit(" q"), F.floor(F.col("l_quantity") / 10).cast("string"))).alias("h")))), lambda x: x["h"])
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(C.distinct_headers(header), "|").alias("header"))


def csv_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", C.csv_line(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")).alias("line"))


def csv_quoted_cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", C.csv_cell(F.col("text")).alias("cell"))


def pipe_table(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", C.pipe_line(F.col("lang"), F.col("source"), F.col("text")).alias("line"))


def tsv_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", C.tsv_line(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("line"))


def json_records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"))).alias("record"))


def json_props(s: SparkSession, d: str) -> DataFrame:
    keys = table(s, d, "events").select("event_id", "props", F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))


def slugs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", C.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), C.sheet_name(F.concat_ws(" / ", "p_name", "p_type")).alias("sheet"))


def zip_names(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "part").select("p_partkey", F.concat(C.slug(F.col("p_type")), F.lit(".csv")).alias("name"))
    return O.unique_names(files, "name", "p_partkey").select("p_partkey", "unique_name")


def url_formats(s: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(s, d, "pages").select("page_id", C.extension(path).alias("extension"), F.upper(F.hex(F.substring("html", 1, 4))).alias("head"))


def sized_headings(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("size"))
    return O.heading_levels(lines, ["doc"], "pos", "size").select("doc", "pos", "body", F.col("level").cast("int").alias("level"))


def baselines(s: SparkSession, d: str) -> DataFrame:
    glyphs = table(s, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("page"), (F.floor(F.col("l_quantity") * 1.3 * 2 + 0.5) / 2).alias("y"), F.col("l_tax").alias("size"))
    return glyphs.groupBy("page", "y").agg(F.count("*").alias("n_runs"), F.max("size").alias("size"))


def clipped_rows(s: SparkSession, d: str) -> DataFrame:
    """An order's items as one row of cells, three for each, cut at twelve."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.floor("l_quantity").cast("string")).alias("cells"))
    cells = F.flatten(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["cells"]))
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(cells.alias("cells"))
    return rows.select("l_orderkey", F.array_join(F.slice("cells", 1, 12), "|").alias("kept"), F.greatest(F.lit(0), F.size("cells") - 12).cast("long").alias("lost"))


def non_latin(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.length(F.regexp_replace("text", r"[\x00-\x{17F}]", "")).cast("long").alias("undrawable"))


def escaped_xml(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", M.escape_xml(F.col("text")).alias("xml"))


def delimiters(s: SparkSession, d: str) -> DataFrame:
    return sniffed(table(s, d, "documents"), "text", "delimiter").select("doc_id", "delimiter")


def decoded_texts(s: SparkSession, d: str) -> DataFrame:
    """Texts as bytes in four ways, by the id, and read back: UTF-8 without and with its mark, UTF-16 of both orders."""
    way, text = F.pmod("doc_id", F.lit(4)), F.coalesce("text", F.lit(""))
    utf16 = lambda mark, name: F.concat(F.unhex(F.lit(mark)), F.encode(text, name))
    content = F.when(way == 0, F.encode(text, "UTF-8")).when(way == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(way == 2, utf16("FFFE", "UTF-16LE")).otherwise(utf16("FEFF", "UTF-16BE"))
    return table(s, d, "documents").select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), decoded(content).alias("text"))


def json_rows(s: SparkSession, d: str) -> DataFrame:
    """Conversations written as JSON texts, nested and with lists, and read back as sheets."""
    text = F.coalesce("text", F.lit(""))
    said = F.struct(text.alias("text"), F.struct(F.length(text).alias("chars")).alias("size"))
    role = F.coalesce("role", F.lit("")).alias("role")
    turn = F.struct("turn", role, said.alias("said"), F.array(role, F.lit(None).cast("string"), F.col("turn").cast("string")).alias("parts"))
    texts = table(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(turn)).alias("turns"), F.count("*").alias("n"))).alias("json"))
    return read_json(texts, "conv_id", "json").select("conv_id", "name", "pos", F.array_join("cells", "|").alias("cells"), "reason")


def note_rtf(s: SparkSession, d: str) -> DataFrame:
    return rtf_of(note_blocks(s, d).withColumn("rows", F.lit(None).cast("array<array<string>>")), "doc")


def sized_paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Turns as paragraphs: their length gives a size, those of users are bold, some begin like items of lists."""
    text = F.coalesce("text", F.lit(""))
    mark = F.when(F.col("turn") % 5 == 2, "• ").when(F.col("turn") % 5 == 3, "12) ").otherwise("")
    found = table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), (F.length(text) % 4 * 2 + 22).alias("size"), (F.col("role") == "user").alias("bold"), F.concat(mark, text).alias("text"))
    return sized_blocks(found, "doc").select("doc", "pos", "kind", F.coalesce("level", F.lit(0)).alias("level"), "ordered", "text")


def page_text_files(s: SparkSession, d: str) -> DataFrame:
    """Pages taken to plain text, by way of Markdown."""
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"([^/]*)\z", 1)
    made = convert(table(s, d, "pages").select(F.col("page_id").alias("id"), name.alias("name"), F.col("html").alias("text")), "html", "txt")
    return made.select(F.col("id").alias("page_id"), "name", "mime", "text", F.array_join(F.filter("warnings", lambda w: w.contains(": html_")), "|").alias("warnings"), "error")


def csv_markdown_files(s: SparkSession, d: str) -> DataFrame:
    """Conversations as CSV files taken to Markdown."""
    name = F.concat(F.lit("talk "), F.col("conv_id").cast("string"), F.lit(".v1.csv"))
    made = convert(csv_texts(s, d).select(F.col("conv_id").alias("id"), name.alias("name"), F.col("csv").alias("text")), "csv", "md")
    return made.select(F.col("id").alias("conv_id"), "name", "mime", "text", "error")


def page_formats(s: SparkSession, d: str) -> DataFrame:
    """What the name of a page claims, what its first bytes say, whether these differ, and why it is refused, if it is."""
    pages = table(s, d, "pages").select("page_id", C.extension(F.regexp_replace("url", "[?#].*$", "")).alias("ext"), F.col("html").cast("binary").alias("content"))
    found = pages.join(F.broadcast(s.sql(f"WITH {KNOWN} SELECT name, format AS claimed FROM known")), F.col("ext") == F.col("name"), "left")
    read = found.select("page_id", "claimed", D.detected(F.col("claimed"), F.col("content")).alias("is"))
    return read.select("page_id", F.coalesce("claimed", F.lit("")).alias("claimed"), F.coalesce("is.format", F.lit("")).alias("found"), "is.mismatch", "is.reason")


def matrix_totals(s: SparkSession, d: str) -> DataFrame:
    reach = s.sql(R.planner("SELECT src, count_if(via = '') AS direct, count_if(via <> '') AS routed FROM routes GROUP BY src"))
    refused = s.sql(R.planner("SELECT src, count(*) AS refused FROM refused GROUP BY src"))
    by_format = document_sizes(s, d).groupBy(F.col("fmt").alias("src")).agg(F.count("*").alias("n_docs"))
    return by_format.join(F.broadcast(reach), "src").join(F.broadcast(refused), "src", "left").select("src", "n_docs", "direct", "routed", F.coalesce("refused", F.lit(0)).cast("long").alias("refused"))


def line_paragraphs(s: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    lines = table(s, d, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("page"), (800 - 20 * F.col("turn") - F.length(text) % 8).alias("y"), F.lit(12).alias("size"), text.alias("text"))
    return O.line_islands(lines, ["conv_id"], "turn", "page", "y", "size", "text").groupBy("conv_id", "paragraph").agg(F.count("*").alias("n_lines"), F.min("turn").cast("long").alias("first_turn"), F.sum(F.length("text")).alias("n_chars"))


def turn_tables(s: SparkSession, d: str) -> DataFrame:
    return O.pipe_tables(table(s, d, "conversations"), "conv_id", ["turn"], "| role | text |", C.pipe_line(F.col("role"), F.col("text")))


def readable_sizes(s: SparkSession, d: str) -> DataFrame:
    sizes = table(s, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    return sizes.select("source", "bytes", C.readable_size(F.col("bytes")).alias("size"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n in SQL} | decks.queries() | jobs.queries() | paged.queries() | reading.queries() | routed.queries()


_notes = lambda q: f"WITH {NOTES} {q}"
_quoted = lambda c: f"CASE WHEN regexp_matches({c}, '[\",' || chr(10) || chr(13) || ']') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
_slug = lambda c: f"regexp_replace(regexp_replace(trim({c}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
def _rtf(text: str) -> str:
    for old, new in (("'\\'", "'\\\\'"), ("'{'", "'\\{'"), ("'}'", "'\\}'"), ("chr(9)", "'\\tab '"), ("chr(10)", "'\\par '")):
        text = f"replace({text}, {old}, {new})"
    unit = lambda n: f"'\\u' || ({n}) || '?'"
    char = f"CASE WHEN unicode(c) > 65535 THEN {unit('(unicode(c) - 65536) // 1024 - 10240')} || {unit('unicode(c) % 1024 - 9216')} WHEN unicode(c) > 32767 THEN {unit('unicode(c) - 65536')} WHEN unicode(c) > 127 THEN {unit('unicode(c)')} ELSE c END"
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: {char}), '')"


PAGE_MARKDOWN_SQL = f"""{BLOCKS_SQL}, part AS (SELECT page_id, pos, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN kind = 'bullet' AND lag(kind) OVER w = 'bullet' THEN chr(10) ELSE chr(10) || chr(10) END || CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'bullet' THEN '- ' || text WHEN 'rule' THEN '---' WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' WHEN 'quote' THEN '> ' || replace(text, chr(10), chr(10) || '> ') ELSE text END AS p FROM blocks WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
    page_markdown AS (SELECT page_id, {trim_sql(replace_sql('t', (chr(92) + 'n{3,}', 'chr(10) || chr(10)')))} AS markdown FROM (SELECT page_id, string_agg(p, '' ORDER BY pos) AS t FROM part GROUP BY page_id))"""
CSV_TEXTS_SQL = f"WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) SELECT conv_id, 'role,text' || chr(13) || chr(10) || string_agg({_quoted('role')} || ',' || {_quoted('text')}, chr(13) || chr(10) ORDER BY turn) AS csv, '| role | text |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(role, '|', '\\|') || ' | ' || replace(replace(text, '|', '\\|'), chr(10), ' ') || ' |', chr(10) ORDER BY turn) AS md FROM r GROUP BY conv_id"
SQL = {
    "decoded_texts": r"""SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN strlen(t) WHEN 1 THEN 3 + strlen(t) ELSE 2 + 2 * (length(t) + length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g'))) END AS BIGINT) AS n_bytes, t AS text
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "json_rows": """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)
        SELECT conv_id, 'turns' AS name, pos, turn || '|' || role || '|' || t || '|' || length(t) || '|' || role || ', , ' || turn AS cells, '' AS reason FROM c UNION ALL SELECT DISTINCT conv_id, 'turns', 0, 'turn|role|said.text|said.size.chars|parts', '' FROM c""",
    "note_rtf": rf"""WITH {NOTES}, k AS (SELECT doc, pos, left(line, 2) AS mark, {_rtf("regexp_replace(line, '^(#|>|-|1[.]) ', '')")} AS t, sum(CASE WHEN regexp_matches(line, '^[#>] ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS island FROM notes),
        o AS (SELECT *, CAST(sum(CASE WHEN mark = '1.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, island ORDER BY pos) AS INTEGER) AS n FROM k),
        p AS (SELECT doc, pos, CASE mark WHEN '# ' THEN '\pard\sa180\sb180\b\fs36 ' || t || '\b0\fs24\par' WHEN '> ' THEN '\pard\li560\sa120\i ' || t || '\i0\par' WHEN '- ' THEN '\pard\fi-280\li560\sa90 \bullet\tab ' || t || '\par' ELSE '\pard\fi-280\li560\sa90 ' || n || '.\tab ' || t || '\par' END AS p FROM o)
        SELECT doc, '{{\rtf1\ansi\ansicpg1252\deff0' || chr(10) || '{{\fonttbl{{\f0\froman Times New Roman;}}{{\f1\fmodern Courier New;}}}}' || chr(10) || '\viewkind4\uc1\pard\f0\fs24' || chr(10) || string_agg(p, chr(10) ORDER BY pos) || chr(10) || '}}' AS rtf FROM p GROUP BY doc""",
    "sized_paragraphs": r"""WITH p AS (SELECT conv_id AS doc, turn AS pos, length(coalesce(text, '')) % 4 * 2 + 22 AS size, coalesce(role = 'user', FALSE) AS bold, CASE turn % 5 WHEN 2 THEN '• ' WHEN 3 THEN '12) ' ELSE '' END || coalesce(text, '') AS t FROM conversations),
        m AS (SELECT doc, list_sort(list(size))[len(list(size)) // 2 + 1] AS body FROM p GROUP BY doc),
        lv AS (SELECT doc, size, least(row_number() OVER (PARTITION BY doc ORDER BY size DESC), 6) AS level FROM (SELECT DISTINCT p.doc, size FROM p JOIN m ON m.doc = p.doc WHERE size > body)),
        x AS (SELECT p.*, lv.level, coalesce(max(lv.level) OVER (PARTITION BY p.doc), 0) AS deepest, bold AND length(t) <= 120 AND t NOT LIKE '%.' AS run_in, regexp_matches(t, '^\s*[•\-*·]\s+') AS b, regexp_matches(t, '^\s*[0-9]+[.)]\s+') AS n FROM p LEFT JOIN lv ON lv.doc = p.doc AND lv.size = p.size),
        y AS (SELECT *, CASE WHEN level IS NOT NULL OR run_in THEN 'heading' WHEN b OR n THEN 'bullet' ELSE 'paragraph' END AS kind FROM x)
        SELECT doc, pos, kind, CAST(coalesce(level, CASE WHEN run_in THEN least(deepest + 1, 6) END, 0) AS INTEGER) AS level, kind = 'bullet' AND NOT b AS ordered,
            CASE WHEN kind <> 'bullet' THEN t WHEN b THEN regexp_replace(t, '^\s*[•\-*·]\s+', '') ELSE regexp_replace(t, '^\s*[0-9]+[.)]\s+', '') END AS text FROM y""",
    "page_text_files": f"WITH {PAGE_MARKDOWN_SQL}, line AS (SELECT page_id, i, " + replace_sql("regexp_replace(l[i], '^(---|[*][*][*])$', '')", (r"^\s{0,3}#{1,6}\s+", "''"), (r"^\s{0,3}>\s?", "''"), (r"^(\s*)[-*+]\s+", r"'\1• '"), (r"\[([^\]]+)\]\([^)]*\)", r"'\1'"), *((rf"({m}(?:\s{x}|{x}\s){m})|{m}({y}){m}", r"'\1\2'") for m, x, y in (("[*][*][*]", "(?:[^*]|[*][^*])*", "(?:[^*]|[*][^*])+?"), ("[*][*]", "(?:[^*]|[*][^*])*", "(?:[^*]|[*][^*])+?"), ("[*]", "[^*]*", "[^*]+"))))
        + " AS x FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, string_split(markdown, chr(10)) AS l FROM page_markdown))), whole AS (SELECT page_id, " + trim_sql(replace_sql("string_agg(x, chr(10) ORDER BY i)", (r"\n{3,}", "chr(10) || chr(10)"))) + " AS text FROM line GROUP BY page_id),"
        + r" named AS (SELECT page_id, html, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS n FROM pages) SELECT page_id, CASE WHEN strpos(substr(n, 2), '.') > 0 THEN left(n, length(n) - strpos(reverse(n), '.')) ELSE n END || '.txt' AS name, 'text/plain' AS mime, coalesce(text, '') AS text, concat_ws('|', "
        + ", ".join(f"CASE WHEN regexp_matches(html, '{p}', 'i') THEN '.html → .md: {c}:' || len(regexp_extract_all(html, '{p}', 0, 'i')) END" for c, p in LOSS_SQL.items()) + ") AS warnings, CASE WHEN coalesce(text, '') = '' THEN 'empty_output' ELSE '' END AS error FROM named LEFT JOIN whole USING (page_id)",
    "csv_markdown_files": f"SELECT conv_id, 'talk ' || conv_id || '.v1.md' AS name, 'text/markdown' AS mime, md AS text, '' AS error FROM ({CSV_TEXTS_SQL})",
    "csv_rows": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, coalesce(text, '') AS text FROM conversations",
    "deck_texts": f"WITH {NOTES}, b AS (SELECT *, CASE WHEN line LIKE '# %' THEN 1 ELSE 0 END AS h, regexp_replace(line, '^(#|>|-|1[.]) ', '') AS t FROM notes), n AS (SELECT *, CAST(sum(h) OVER (PARTITION BY doc ORDER BY pos) AS BIGINT) AS section FROM b), s AS (SELECT * FROM (SELECT doc, section, coalesce(max(t) FILTER (WHERE h = 1), '') AS title, count(*) FILTER (WHERE h = 0) AS n_bullets, coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (WHERE h = 0), '') AS body FROM n GROUP BY doc, section) WHERE title <> '' OR n_bullets > 0), t AS (SELECT doc, section, 'Slide ' || section || CASE WHEN title <> '' THEN chr(10) || title ELSE '' END || CASE WHEN n_bullets > 0 THEN chr(10) || body ELSE '' END AS x, '## ' || CASE WHEN title <> '' THEN title ELSE 'Slide ' || section END || CASE WHEN n_bullets > 0 THEN chr(10) || chr(10) || '- ' || replace(body, chr(10), chr(10) || '- ') ELSE '' END AS m FROM s) SELECT doc, string_agg(x, chr(10) || chr(10) ORDER BY section) AS text, string_agg(m, chr(10) || chr(10) ORDER BY section) AS md FROM t GROUP BY doc",
    "order_headers": "WITH h AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, CASE WHEN l_quantity < 5 THEN '' ELSE 'q' || CAST(floor(l_quantity / 10) AS BIGINT) END AS n FROM lineitem), d AS (SELECT k, i, CASE WHEN n = '' THEN 'column' || i WHEN row_number() OVER (PARTITION BY k, n ORDER BY i) > 1 THEN n || '_' || i ELSE n END AS n FROM h) SELECT k AS l_orderkey, string_agg(n, '|' ORDER BY i) AS header FROM d GROUP BY k",
    "page_names": r"WITH n AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS n FROM pages), e AS (SELECT *, lower(regexp_extract(n, '^.+\.([^.]+)$', 1)) AS extension FROM n) SELECT page_id, extension, CASE WHEN extension = '' THEN n ELSE left(n, length(n) - length(extension) - 1) END AS base, CASE WHEN strpos(substr(n, 2), '.') > 0 THEN left(n, length(n) - strpos(reverse(n), '.')) ELSE n END || '.md' AS output FROM e",
    "json_header": "SELECT key, event_id, place FROM (SELECT key, event_id, place, row_number() OVER (PARTITION BY key ORDER BY event_id, place) AS k FROM (SELECT event_id, unnest(range(len(json_keys(props)))) AS place, unnest(json_keys(props)) AS key FROM events)) WHERE k = 1",
    "csv_texts": CSV_TEXTS_SQL,
    "md_plain_text": f"WITH {NOTES}, l AS (SELECT doc, pos, " + replace_sql("line", (r"^\s{0,3}#{1,6}\s+", "''"), (r"^\s{0,3}>\s?", "''"), (r"^(\s*)[-*+]\s+", r"'\1• '")) + " AS x FROM notes), t AS (SELECT doc, string_agg(x, chr(10) ORDER BY pos) AS t FROM l GROUP BY doc) SELECT doc, " + trim_sql(replace_sql("t", (r"\n{3,}", "chr(10) || chr(10)"))) + " AS text FROM t",
    "note_markdown": f"WITH {NOTES}, k AS (SELECT *, NOT regexp_matches(line, '^[#>] ') AS b, sum(CASE WHEN regexp_matches(line, '^[#>] ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS island FROM notes), o AS (SELECT *, CASE WHEN line LIKE '1. %' THEN CAST(sum(CASE WHEN line LIKE '1. %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, island ORDER BY pos) AS INTEGER) || substr(line, 2) ELSE line END AS part, lag(b) OVER (PARTITION BY doc ORDER BY pos) AS before FROM k), t AS (SELECT doc, string_agg(CASE WHEN before IS NULL THEN '' WHEN before AND b THEN chr(10) ELSE chr(10) || chr(10) END || part, '' ORDER BY pos) AS t FROM o GROUP BY doc) SELECT doc, {trim_sql(replace_sql('t', (chr(92) + 'n{3,}', 'chr(10) || chr(10)')))} AS markdown FROM t",
    "slides": f"WITH {NOTES}, b AS (SELECT *, CASE WHEN line LIKE '# %' THEN 1 ELSE 0 END AS h, regexp_replace(line, '^(#|>|-|1[.]) ', '') AS t FROM notes), n AS (SELECT *, CAST(sum(h) OVER (PARTITION BY doc ORDER BY pos) AS BIGINT) AS section FROM b), s AS (SELECT * FROM (SELECT doc, section, coalesce(max(t) FILTER (WHERE h = 1), '') AS title, count(*) FILTER (WHERE h = 0) AS n_bullets, coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (WHERE h = 0), '') AS body FROM n GROUP BY doc, section) WHERE title <> '' OR n_bullets > 0) SELECT * FROM s",
    "last_states": "SELECT user_id, state, n_events FROM (SELECT user_id, event_type AS state, count(*) OVER (PARTITION BY user_id) AS n_events, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "admission": f"WITH {SIZES}, first(src, target) AS (VALUES ('html', 'pdf'), ('txt', 'pdf'), ('json', 'pdf')) SELECT fmt AS src, count(*) AS n_docs, count(*) FILTER (WHERE bytes = 0) AS n_empty, count(*) FILTER (WHERE bytes > 104857600) AS n_too_large, target FROM sizes JOIN first ON src = fmt GROUP BY fmt, target",
    "all_routes": R.planner("SELECT 1").removesuffix("SELECT 1") + f", {SIZES}, c AS (SELECT fmt, count(*) AS n_docs FROM sizes GROUP BY fmt) SELECT src, dst, CASE WHEN via = '' THEN src || '>' || dst ELSE src || '>' || via || '>' || dst END AS steps, ['exact', 'good', 'lossy'][rank + 1] AS fidelity, CASE WHEN via = '' THEN '' ELSE 'two_steps:' || via END AS caveat, coalesce(n_docs, 0) AS n_docs FROM routes LEFT JOIN c ON fmt = src",
    "stranded_words": f"WITH {REDUCED_SQL}, rest AS (SELECT page_id, {trim_sql(replace_sql(plain_sql(replace_sql('h', (ELEMENT_SQL, chr(39) * 2))), ('[•' + chr(92) + 's]+', chr(39) + ' ' + chr(39))))} AS t FROM reduced) SELECT page_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS n_words FROM rest",
    "page_markdown": f"WITH {PAGE_MARKDOWN_SQL} SELECT page_id, markdown FROM page_markdown",
    "page_blocks": f"WITH {BLOCKS_SQL} SELECT page_id, pos, kind, coalesce(level, 0) AS level, coalesce(text, '') AS text FROM blocks",
    "loss_tiers": r"SELECT 'lost' AS severity, count(*) AS n_pages FROM pages WHERE regexp_matches(html, '<(script|img|picture|iframe|embed|form)\b', 'i') UNION ALL SELECT 'changed', count(*) FROM pages WHERE regexp_matches(html, '<style\b|<link\b[^>]*stylesheet', 'i')",
    "html_plain_text": f"SELECT page_id, CAST(length(text) AS BIGINT) AS n_chars, text FROM (SELECT page_id, {plain_sql('html')} AS text FROM pages)",
    "html_losses": "SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(html, '{p}', 0, 'i')) AS BIGINT) AS {c}" for c, p in LOSS_SQL.items()) + " FROM pages",
    "loss_by_code": "SELECT code, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS code, len(regexp_extract_all(html, '{p}', 0, 'i')) AS n FROM pages" for c, p in LOSS_SQL.items()) + ") GROUP BY code HAVING sum(n) > 0",
    "html_blocks": f"WITH {BLOCKS_SQL} SELECT page_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("heading", "paragraph", "bullet", "quote", "code", "table", "rule")) + " FROM blocks GROUP BY page_id",
    "html_links": "SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages))",
    "html_titles": "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "route_targets": R.planner("SELECT 1").removesuffix("SELECT 1") + f", {SIZES} SELECT src, dst, via, CAST(max(rank) AS INTEGER) AS rank, count(*) AS n_docs, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(round(max(peak) * max(bytes)) AS BIGINT) AS peak_bytes FROM sizes JOIN routes ON src = fmt GROUP BY src, dst, via",
    "route_refusals": R.planner("SELECT 1").removesuffix("SELECT 1") + f", {SIZES}, c AS (SELECT fmt, count(*) AS n_docs FROM sizes GROUP BY fmt) SELECT src, rule, max(n_docs) AS n_docs, string_agg(dst, ',' ORDER BY dst) AS targets FROM c JOIN refused ON src = fmt GROUP BY src, rule",
    "matrix_cells": R.planner("SELECT 1").removesuffix("SELECT 1") + f", {SIZES}, c AS (SELECT fmt, count(*) AS n_docs FROM sizes GROUP BY fmt) SELECT a.f AS src, b.f AS dst, CASE WHEN a.f = b.f THEN 'self' WHEN EXISTS (SELECT 1 FROM refused x WHERE x.src = a.f AND x.dst = b.f) THEN 'refused' WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = a.f AND e.dst = b.f) THEN 'direct' WHEN EXISTS (SELECT 1 FROM routes r WHERE r.src = a.f AND r.dst = b.f) THEN 'routed' ELSE 'none' END AS kind, coalesce(n_docs, 0) AS n_docs FROM formats a CROSS JOIN formats b LEFT JOIN c ON fmt = a.f",
    "size_caution": R.planner("SELECT 1").removesuffix("SELECT 1") + f", {SIZES}, e AS (SELECT src, dst, bytes * CAST(floor(peak + 0.5) AS BIGINT) AS estimate FROM sizes JOIN routes ON src = fmt) SELECT src, dst, count(*) AS n_docs, count(*) FILTER (WHERE estimate > {BUDGET}) AS n_warned, max(estimate) AS estimate FROM e GROUP BY src, dst",
    "txt_paragraphs": r"WITH t AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, trim(regexp_replace(unnest(regexp_split_to_array(t, '\n\s*\n')), '\s*\n\s*', ' ', 'g')) AS p FROM t) SELECT conv_id, count(*) AS n_paragraphs, CAST(sum(length(p)) AS BIGINT) AS n_chars FROM p WHERE p <> '' GROUP BY conv_id",
    "conversation_blocks": "SELECT conv_id, row_number() OVER w AS pos, role, coalesce(lag(role) OVER w = role, FALSE) AS same_speaker FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "md_plain_lines": _notes("SELECT doc, pos, " + replace_sql("line", (r"^\s{0,3}#{1,6}\s+", "''"), (r"^\s{0,3}>\s?", "''"), (r"^(\s*)[-*+]\s+", r"'\1• '")) + " AS line FROM notes"),
    "md_headings": _notes(r"SELECT doc, pos, CAST(length(regexp_extract(line, '^(#+)', 1)) AS INTEGER) AS level, regexp_replace(line, '^#+ +|\*\*', '', 'g') AS heading FROM notes WHERE regexp_matches(line, '^#{1,6} ')"),
    "chapters": f"WITH {NOTES}, b AS (SELECT *, CASE WHEN line LIKE '# %' THEN 1 ELSE 0 END AS h, regexp_replace(line, '^(#|>|-|1[.]) ', '') AS t FROM notes), n AS (SELECT *, CAST(sum(h) OVER (PARTITION BY doc ORDER BY pos) AS BIGINT) AS section FROM b) SELECT * FROM (SELECT doc, section, coalesce(max(t) FILTER (WHERE h = 1), 'conversation ' || doc) AS title, count(*) FILTER (WHERE h = 0) AS n_blocks FROM n GROUP BY doc, section) WHERE title <> '' OR n_blocks > 0",
    "slide_overflow": f"WITH {NOTES}, b AS (SELECT *, CASE WHEN line LIKE '# %' THEN 1 ELSE 0 END AS h, regexp_replace(line, '^(#|>|-|1[.]) ', '') AS t FROM notes), n AS (SELECT *, CAST(sum(h) OVER (PARTITION BY doc ORDER BY pos) AS BIGINT) AS section FROM b), s AS (SELECT * FROM (SELECT doc, section, coalesce(max(t) FILTER (WHERE h = 1), '') AS title, count(*) FILTER (WHERE h = 0) AS n_bullets, coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (WHERE h = 0), '') AS body FROM n GROUP BY doc, section) WHERE title <> '' OR n_bullets > 0) SELECT doc, count(*) AS n_slides, count(*) FILTER (WHERE n_bullets > 12) AS n_overflowing FROM s GROUP BY doc",
    "ordinals": _notes("SELECT doc, pos, ordinal FROM (SELECT *, CAST(sum(CASE WHEN line LIKE '1. %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, island ORDER BY pos) AS INTEGER) AS ordinal FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^[#>] ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS island FROM notes)) WHERE line LIKE '1. %'"),
    "csv_lines": f"SELECT o_orderkey, concat_ws(',', CAST(o_orderkey AS VARCHAR), {_quoted('o_orderstatus')}, strftime(o_orderdate, '%Y-%m-%d'), {_quoted('o_orderpriority')}) AS line FROM orders",
    "csv_quoted_cells": f"SELECT doc_id, {_quoted('text')} AS cell FROM documents",
    "pipe_table": "SELECT doc_id, '| ' || concat_ws(' | ', " + ", ".join(f"replace(replace(coalesce({c}, ''), '|', '\\|'), chr(10), ' ')" for c in ("lang", "source", "text")) + ") || ' |' AS line FROM documents",
    "tsv_lines": "SELECT c_custkey, concat_ws(chr(9), replace(c_name, chr(9), ' '), replace(c_mktsegment, chr(9), ' '), CAST(c_nationkey AS VARCHAR)) AS line FROM customer",
    "json_records": "SELECT s_suppkey, '{\"key\":\"' || s_suppkey || '\",\"name\":\"' || s_name || '\"}' AS record FROM supplier",
    "json_props": "SELECT key, count(*) AS n, min(event_id) AS first_seen FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "slugs": f"SELECT p_partkey, lower({_slug('concat_ws(chr(32) || chr(47) || chr(32), p_name, p_type)')}) AS slug, substr(regexp_replace(concat_ws(' / ', p_name, p_type), '[\\[\\]:*?/\\\\]', ' ', 'g'), 1, 31) AS sheet FROM part",
    "zip_names": f"SELECT p_partkey, CASE WHEN n = 1 THEN name || '.csv' ELSE name || '-' || n || '.csv' END AS unique_name FROM (SELECT p_partkey, name, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS n FROM (SELECT p_partkey, lower({_slug('p_type')}) AS name FROM part))",
    "url_formats": r"SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^.+\.([^.]+)$', 1)) AS extension, hex(substr(html, 1, 4)) AS head FROM pages",
    "sized_headings": "WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS pos, floor(l_quantity * 4 + 0.5) / 4 AS q FROM lineitem), m AS (SELECT doc, list_sort(list(q))[len(list(q)) // 2 + 1] AS body FROM b GROUP BY doc), r AS (SELECT doc, q, dense_rank() OVER (PARTITION BY doc ORDER BY q DESC) AS level FROM (SELECT DISTINCT b.doc, q FROM b JOIN m ON b.doc = m.doc WHERE q > body)) SELECT b.doc, b.pos, m.body, CAST(least(coalesce(r.level, 0), 6) AS INTEGER) AS level FROM b JOIN m ON b.doc = m.doc LEFT JOIN r ON r.doc = b.doc AND r.q = b.q",
    "baselines": "SELECT l_orderkey % 1000 AS page, floor(l_quantity * 1.3 * 2 + 0.5) / 2 AS y, count(*) AS n_runs, max(l_tax) AS size FROM lineitem GROUP BY 1, 2",
    "clipped_rows": "WITH i AS (SELECT l_orderkey, l_partkey || '|' || l_suppkey || '|' || CAST(floor(l_quantity) AS BIGINT) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) SELECT l_orderkey, string_agg(c, '|' ORDER BY n) FILTER (WHERE n <= 4) AS kept, CAST(3 * count(*) FILTER (WHERE n > 4) AS BIGINT) AS lost FROM i GROUP BY l_orderkey",
    "non_latin": r"SELECT doc_id, CAST(length(regexp_replace(text, '[\x00-\x{17F}]', '', 'g')) AS BIGINT) AS undrawable FROM documents",
    "escaped_xml": "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM documents",
    "delimiters": "WITH h AS (SELECT doc_id, regexp_replace(array_to_string(string_split(coalesce(text, ''), chr(10))[1:20], chr(10)), '\"[^\"]*(\"|$)', '', 'g') AS t FROM documents), n AS (SELECT doc_id, length(t) - length(replace(t, ',', '')) AS a, length(t) - length(replace(t, ';', '')) AS b, length(t) - length(replace(t, chr(9), '')) AS c, length(t) - length(replace(t, '|', '')) AS p FROM h) SELECT doc_id, CASE WHEN greatest(a, b, c, p) = a THEN ',' WHEN greatest(b, c, p) = b THEN ';' WHEN greatest(c, p) = c THEN chr(9) ELSE '|' END AS delimiter FROM n",
    "page_formats": rf"WITH {KNOWN}, p AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^.+\.([^.]+)$', 1)) AS ext, html[1:8] AS head FROM pages), f AS (SELECT page_id, format AS c, CASE WHEN coalesce(head, '') = '' THEN format WHEN head LIKE 'PK' || chr(3) || chr(4) || '%' THEN NULL WHEN starts_with(head, '%PDF') THEN 'pdf' WHEN starts_with(head, '{{\rtf') THEN 'rtf' WHEN format IN ('md', 'txt', 'csv', 'html', 'json') THEN format END AS f, head FROM p LEFT JOIN known ON name = ext) SELECT page_id, coalesce(c, '') AS claimed, coalesce(f, '') AS found, coalesce(f <> c, FALSE) AS mismatch, CASE WHEN f IS NOT NULL OR coalesce(head, '') = '' THEN '' WHEN head LIKE 'PK' || chr(3) || chr(4) || '%' THEN 'archive' WHEN c IS NOT NULL THEN 'other_bytes' ELSE 'unknown' END AS reason FROM f",
    "matrix_totals": R.planner("SELECT 1").removesuffix("SELECT 1") + f", {SIZES}, c AS (SELECT fmt, count(*) AS n_docs FROM sizes GROUP BY fmt) SELECT fmt AS src, n_docs, (SELECT count(*) FROM routes WHERE src = fmt AND via = '') AS direct, (SELECT count(*) FROM routes WHERE src = fmt AND via <> '') AS routed, (SELECT count(*) FROM refused WHERE src = fmt) AS refused FROM c",
    "line_paragraphs": r"WITH l AS (SELECT conv_id, turn, coalesce(text, '') AS t, turn // 4 AS page, 800 - 20 * turn - length(coalesce(text, '')) % 8 AS y FROM conversations), b AS (SELECT *, CASE WHEN lag(page) OVER w IS NULL OR lag(page) OVER w <> page OR lag(y) OVER w - y > 21.6 OR regexp_matches(lag(t) OVER w, '[.!?:]\s*$') THEN 1 ELSE 0 END AS b FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, CAST(sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS paragraph FROM b) SELECT conv_id, paragraph, count(*) AS n_lines, CAST(min(turn) AS BIGINT) AS first_turn, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM i GROUP BY conv_id, paragraph",
    "turn_tables": "SELECT conv_id, '| role | text |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(replace(coalesce(role, ''), '|', '\\|'), chr(10), ' ') || ' | ' || replace(replace(coalesce(text, ''), '|', '\\|'), chr(10), ' ') || ' |', chr(10) ORDER BY turn) AS \"table\" FROM conversations GROUP BY conv_id",
    "readable_sizes": "SELECT coalesce(source, '') AS source, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, CASE WHEN coalesce(sum(strlen(text)), 0) >= 1073741824 THEN printf('%.1f GB', sum(strlen(text)) / 1073741824.0) ELSE CAST(CAST(floor(coalesce(sum(strlen(text)), 0) / 1048576.0 + 0.5) AS BIGINT) AS VARCHAR) || ' MB' END AS size FROM documents GROUP BY 1",
}
SQL |= decks.sql(SQL["all_routes"]) | jobs.SQL | paged.SQL | reading.SQL | routed.sql(SQL, LOSS_SQL)
