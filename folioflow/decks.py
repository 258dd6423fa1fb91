"""Queries of decks and of what is said of routes, each with SQL that computes the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import decks as K
from .plans import routes as R
from .plans.catalog import CAVEATS, values
from .reading import _ESSAYS, essays
from .sources import document_sizes, table
from .sources.markdown import read_markdown


def _essay_slides(s: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("turn") % 3 == 0, "# ").otherwise("## ")
    return K.slides_of(read_markdown(essays(s, d, mark), "doc", "md"), "doc")


def deck_slides(s: SparkSession, d: str) -> DataFrame:
    """Essays as slides: every third turn begins one; the lines of all its turns with their depths."""
    lines, depths = F.array_join(F.transform("body", lambda x: x["text"]), "\n"), F.array_join(F.transform("body", lambda x: x["depth"].cast("string")), "")
    return _essay_slides(s, d).select("doc", F.col("slide").cast("long").alias("slide"), "title", F.size("body").cast("long").alias("n_lines"), lines.alias("lines"), depths.alias("depths"))


def deck_overflow(s: SparkSession, d: str) -> DataFrame:
    """How many slides of the essays' decks run off their bottom."""
    return K.overflowing(_essay_slides(s, d), "doc")


def deck_notes(s: SparkSession, d: str) -> DataFrame:
    """Conversations as decks, as text and as Markdown: what a user says is a slide, the answers to it are its notes."""
    text = lambda c: F.coalesce(c, F.lit(""))
    turns = table(s, d, "conversations").select("conv_id", "turn", text(F.col("role")).alias("role"), F.filter(F.split(text(F.col("text")), "\n"), lambda x: x != "").alias("lines"))
    ask = F.col("role") != "assistant"
    asked = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "lines"))).alias("t"))
    each = asked.select("conv_id", F.posexplode("t").alias("at", "x"), "t").select("conv_id", "at", "x.role", "x.lines", F.get("t", F.col("at") + 1).alias("next"))
    said = each.filter(ask).select(
        "conv_id", F.col("at").alias("slide"), F.get("lines", F.lit(0)).alias("title"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("body"),
        F.when(F.col("next.role") == "assistant", F.col("next.lines")).alias("notes"),
    )
    return K.deck_texts(said, "conv_id")


def route_caveats(s: SparkSession, d: str) -> DataFrame:
    """What is said of each route, and of how many documents at hand it would be said."""
    by_format = document_sizes(s, d).groupBy("fmt").agg(F.count("*").alias("n_docs"))
    said = R.caveats(s).join(F.broadcast(by_format), F.col("fmt") == F.col("src"), "left")
    return said.select("src", "dst", "place", "code", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


_SLIDES_SQL = f"""{_ESSAYS}, parts AS (
    SELECT doc, turn, 0 AS part, 0 AS i, role AS x, 0 AS depth FROM turns WHERE turn % 3 <> 0 UNION ALL
    SELECT doc, turn, 1, i, x, i % 3 FROM line UNION ALL
    SELECT doc, turn, 2, 0, '# ' || l[1], 0 FROM turns UNION ALL SELECT doc, turn, 2, 1, '- ' || l[1], 0 FROM turns UNION ALL
    SELECT doc, turn, 3, -1, 'n — line', 0 FROM turns UNION ALL SELECT doc, turn, 3, i, i || ' — ' || x, 0 FROM line WHERE i < 3 UNION ALL
    SELECT doc, turn, 4, 0, l[1] || chr(10) || role, 0 FROM turns),
    begun AS (SELECT doc, turn, role, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY turn) AS section FROM turns),
    deck AS (SELECT b.doc, b.section, coalesce(max(role) FILTER (WHERE b.turn % 3 = 0 AND part = 1), '') AS title, count(*) AS n_lines, string_agg(x, chr(10) ORDER BY b.turn, part, i) AS lines, string_agg(depth, '' ORDER BY b.turn, part, i) AS depths
        FROM begun b JOIN parts p ON p.doc = b.doc AND p.turn = b.turn GROUP BY b.doc, b.section)"""
_NOTES_SQL = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM conversations),
    n AS (SELECT conv_id, turn, role, l, row_number() OVER w - 1 AS slide, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(l) OVER w END AS notes FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    k AS (SELECT conv_id, turn, slide, coalesce(l[1], '') AS title, l[2:] AS body, coalesce(notes, []) AS notes FROM n WHERE role <> 'assistant'),
    o AS (SELECT conv_id, turn, 'Slide ' || slide || CASE WHEN title <> '' THEN chr(10) || title ELSE '' END || CASE WHEN len(body) > 0 THEN chr(10) || array_to_string(body, chr(10)) ELSE '' END
            || CASE WHEN len(notes) > 0 THEN chr(10) || chr(10) || 'Notes:' || chr(10) || array_to_string(notes, chr(10)) ELSE '' END AS text,
        '## ' || CASE WHEN title <> '' THEN title ELSE 'Slide ' || slide END || CASE WHEN len(body) > 0 THEN chr(10) || chr(10) || '- ' || array_to_string(body, chr(10) || '- ') ELSE '' END
            || CASE WHEN len(notes) > 0 THEN chr(10) || chr(10) || '> ' || array_to_string(notes, chr(10) || '> ') ELSE '' END AS md FROM k)
    SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, string_agg(md, chr(10) || chr(10) ORDER BY turn) AS md FROM o GROUP BY conv_id"""


def sql(all_routes: str) -> dict[str, str]:
    """SQL of these queries; what is said of routes follows from the steps of all routes."""
    return {
        "deck_slides": f"WITH {_SLIDES_SQL} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY section) AS slide, title, n_lines, lines, depths FROM deck",
        "deck_overflow": f"WITH {_SLIDES_SQL} SELECT doc, count(*) AS n FROM deck WHERE n_lines > {K.FITS} GROUP BY doc",
        "deck_notes": _NOTES_SQL,
        "route_caveats": f"""WITH {values('said', 'a, b, code', list(CAVEATS))}, r AS (SELECT src, dst, string_split(steps, '>') AS f, n_docs FROM ({all_routes})),
            p AS (SELECT src, dst, n_docs, f, unnest(range(1, len(f))) AS k FROM r),
            c AS (SELECT src, dst, 0 AS place, 'two_steps' AS code, n_docs FROM r WHERE len(f) = 3 UNION ALL SELECT src, dst, k, code, n_docs FROM p JOIN said ON a = f[k] AND b = f[k + 1])
            SELECT src, dst, CAST(min(place) AS INTEGER) AS place, code, max(n_docs) AS n_docs FROM c GROUP BY src, dst, code""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (deck_slides, deck_overflow, deck_notes, route_caveats)}
