"""Blocks written as HTML: a balanced tree of lists from flat rows, by what comes before and behind each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import markup as M

# Marks inside a line, on escaped text, with the elements that stand for them.
MARKS = (
    (r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)", '<img src="$2" alt="$1">'),
    (r"\[([^\]]+)\]\(([^)\s]*)[^)]*\)", '<a href="$2">$1</a>'),
    (r"\*\*\*(?!\s)([^*]+?)(?<!\s)\*\*\*", "<em><strong>$1</strong></em>"),
    (r"\*\*(?!\s)([^*]+?)(?<!\s)\*\*", "<strong>$1</strong>"),
    (r"\*(?!\s)([^*]+?)(?<!\s)\*", "<em>$1</em>"),
    (r"(^|[^\w])__(?!\s)([^_]+?)(?<!\s)__(?!\w)", "$1<strong>$2</strong>"),
    (r"(^|[^\w])_(?!\s)([^_]+?)(?<!\s)_(?!\w)", "$1<em>$2</em>"),
    (r"~~(?!\s)([^~]+?)(?<!\s)~~", "<del>$1</del>"),
    (r" {2,}\n", "<br>\n"),
)


def escaped(text: Column) -> Column:
    out = text
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def inline_html(source: Column) -> Column:
    """A text with Markdown's marks as HTML. What stands between backticks is code and keeps its marks; a last backtick without another is itself."""
    parts = F.split(escaped(source), "`")
    code = lambda i: (i % 2 == 1) & (i < F.size(parts) - 1)
    shown = F.transform(parts, lambda x, i: F.when(code(i), F.concat(F.lit("<code>"), x, F.lit("</code>"))).otherwise(F.concat(F.when((i > 0) & (i % 2 == 1), "`").otherwise(""), M.settled(x, MARKS, F.length(x) / 2 + 1))))
    return F.when(source.contains("`"), F.array_join(shown, "")).otherwise(M.settled(escaped(source), MARKS, F.length(source) / 2 + 1))


def common(a: Column, b: Column) -> Column:
    """How many letters two short texts begin with in common."""
    same = lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (i <= F.length(a)) & (i <= F.length(b)), i).otherwise(n)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), F.lit(0), same)


def html_of(blocks: DataFrame, key: str) -> DataFrame:
    """key and html: the body of each document from blocks (pos, kind, level, lists, source, cells) as `read_markdown` gives them.

    An item opens the lists that it is in and the block before it isn't, and closes those that the block behind it isn't in.
    """
    w = Window.partitionBy(key).orderBy("pos")
    path = F.when(F.col("kind") == "bullet", F.col("lists")).otherwise("")
    near = blocks.withColumn("_path", path).withColumns({"_before": F.coalesce(F.lag("_path").over(w), F.lit("")), "_behind": F.coalesce(F.lead("_path").over(w), F.lit(""))})
    levels = near.withColumns({"_held": common(F.col("_before"), F.col("_path")), "_kept": common(F.col("_path"), F.col("_behind"))})
    letters = lambda since: F.filter(F.split(F.substring(F.col("_path"), since + 1, F.length("_path")), ""), lambda c: c != "")
    tag = lambda c: F.concat(c, F.lit("l"))
    held, kept, deep = F.col("_held"), F.col("_kept"), F.length("_path")
    opened = F.array_join(F.transform(letters(held), lambda c: F.concat(F.lit("<"), tag(c), F.lit(">\n<li>"))), "")
    # an item of lists that are all open: it is the next of the innermost
    opened = F.when(held == deep, "<li>").otherwise(opened)
    closed = F.array_join(F.transform(F.reverse(letters(kept)), lambda c: F.concat(F.lit("</li>\n</"), tag(c), F.lit(">\n"))), "")
    goes_on = F.length("_behind") <= kept
    ends = F.when((kept == deep) & goes_on, "</li>\n").when(kept == deep, "\n").otherwise(F.concat(closed, F.when((kept > 0) & goes_on, "</li>\n").otherwise("")))
    text, kind, level = inline_html(F.col("source")), F.col("kind"), F.col("level").cast("string")
    around = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    row = lambda r, name: F.concat(F.lit("<tr>\n"), F.array_join(F.transform(r, lambda c: around(name, inline_html(c))), "\n"), F.lit("\n</tr>\n"))
    rest = F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))
    body = F.when(F.size(rest) > 0, F.concat(F.lit("<tbody>"), F.array_join(F.transform(rest, lambda r: row(r, "td")), ""), F.lit("</tbody>\n"))).otherwise("")
    part = (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">\n")))
        .when(kind == "bullet", F.concat(opened, text, ends))
        .when(kind == "quote", F.concat(F.lit("<blockquote>\n"), around("p", text), F.lit("\n</blockquote>\n")))
        .when(kind == "code", F.concat(F.lit("<pre><code>"), escaped(F.col("source")), F.lit("\n</code></pre>\n")))
        .when(kind == "table", F.concat(F.lit("<table>\n<thead>\n"), row(F.get("cells", F.lit(0)), "th"), F.lit("</thead>\n"), body, F.lit("</table>\n")))
        .when(kind == "rule", F.lit("<hr>\n"))
        .otherwise(F.concat(around("p", text), F.lit("\n")))
    )
    parts = levels.select(key, "pos", part.alias("part"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])
    return parts.groupBy(key).agg(F.array_join(listed, "").alias("html"))


# What stands around the body of a page.
PAGE = ('<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>', "</title>\n</head>\n<body>\n", "\n</body>\n</html>\n")


def page_of(title: Column, body: Column) -> Column:
    """A whole page."""
    return F.concat(F.lit(PAGE[0]), M.escape_xml(title), F.lit(PAGE[1]), M.trimmed(F.coalesce(body, F.lit(""))), F.lit(PAGE[2]))
