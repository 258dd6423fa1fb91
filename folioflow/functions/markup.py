"""HTML, Markdown and XML as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts, as a class that Java's and RE2's patterns read alike.
WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# Patterns and replacements that make plain text of HTML, in this order.
PLAIN = (
    (r"(?i)<\s*(br|/p|/div|/li|/h[1-6]|/tr)\s*/?>", "\n"),
    (r"(?i)<\s*li[^>]*>", "• "),
    (r"(?i)<\s*(td|th)[^>]*>", "\t"),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
)
# What a reader drops: the code of the loss, its severity, and the pattern that is counted.
LOSSES = (
    ("html_scripts", "lost", r"(?i)<script\b"),
    ("html_styles", "changed", r"(?i)<style\b|<link\b[^>]*stylesheet"),
    ("html_images", "lost", r"(?i)<(img|picture)\b"),
    ("html_frames", "lost", r"(?i)<(iframe|embed)\b"),
    ("html_forms", "lost", r"(?i)<form\b"),
)
# What goes from a page before it is read, in this order; then the body alone stays, and grouping elements are unwrapped.
DROPPED = (
    (r"<!--[\s\S]*?-->", ""),
    (r"(?i)<script\b[\s\S]*?</script>", ""),
    (r"(?i)<style\b[\s\S]*?</style>", ""),
    (r"(?i)<head\b[\s\S]*?</head>|<noscript\b[\s\S]*?</noscript>|<svg\b[\s\S]*?</svg>|<template\b[\s\S]*?</template>", ""),
    (r"(?i)<(img|picture|figure|iframe|embed|object|video|audio|canvas|input|button|select|textarea)\b[^>]*/?>", ""),
    (r"(?i)</(picture|figure|iframe|embed|object|video|audio|canvas|select|textarea|button)>", ""),
)
UNWRAPPED = (
    (r"(?i)<pre\b([^>]*)>\s*<code\b[^>]*>", "<pre$1>"),
    (r"(?i)</code>\s*</pre>", "</pre>"),
    (r"(?i)<th\b", "<td"),
    (r"(?i)</th>", "</td>"),
    (r"(?i)</?(section|article|main|header|footer|aside|nav|hgroup)\b[^>]*>", ""),
)
DEFINITIONS = ((r"(?i)</?dl\b[^>]*>", ""), (r"(?i)<(dt|dd)\b[^>]*>", "<p>"), (r"(?i)</(dt|dd)>", "</p>"))
BODY = r"(?i)<body\b[^>]*>([\s\S]*?)</body>"
# Inline elements with the marks that Markdown has for them, innermost first, until none is left.
INLINE = (
    (r"(?i)<(strong|b|em|i|code)\b[^>]*>(\s*)</\1>", "$2"),
    (r"(?i)<(strong|b)\b[^>]*>\s*([^<]*?)\s*</\1>", "**$2**"),
    (r"(?i)<(em|i)\b[^>]*>\s*([^<]*?)\s*</\1>", "*$2*"),
    (r"(?i)<code\b[^>]*>([^<]*)</code>", "`$1`"),
    (r'(?i)<a\b[^>]*href="[^"]*"[^>]*>(\s*)</a>', "$1"),
    (r'(?i)<a\b[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)"),
    (r"(?i)<(u|s|strike|del|span|sup|sub|ins|mark)\b[^>]*>([^<]*)</\1>", "$2"),
)
INLINE_TAG = r"(?i)<(strong|b|em|i|code|a|u|s|strike|del|span|sup|sub|ins|mark)\b"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
def replaced(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def html_plain_text(html: Column) -> Column:
    """Text of a page: block ends are line breaks, bullets and tabs stand for items and cells, tags go, entities are read."""
    return trimmed(replaced(html, PLAIN))


def settled(text: Column, steps: tuple[tuple[str, str], ...], most: Column) -> Column:
    """The steps again and again, `most` times if need be, until a pass changes nothing.

    Each turn of a loop copies the text, done or not, so the turns are dealt to three loops in each other, of which those that
    are done are left at once: a text that settles early is copied three times the cube root of `most`.
    """
    none, turns = F.lit(None).cast("string"), F.sequence(F.lit(0), F.ceil(F.cbrt(most)).cast("int"))
    held = lambda now, before, done: F.struct(now.alias("now"), before.alias("before"), F.lit(done).alias("done"))
    turn = lambda h, _: F.when(h["done"], h).when(h["now"].eqNullSafe(h["before"]), held(h["now"], none, True)).otherwise(held(replaced(h["now"], steps), h["now"], False))
    inner = lambda h, _: F.when(h["done"], h).otherwise(F.aggregate(turns, h, turn))
    outer = lambda h, _: F.when(h["done"], h).otherwise(F.aggregate(turns, h, inner))
    return F.aggregate(turns, held(text, none, False), outer, lambda h: h["now"])


def decoded(text: Column) -> Column:
    """Entities as characters, decimal ones too; the ampersand last."""
    named = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    numbers = F.array_distinct(F.regexp_extract_all(named, F.lit(r"&#(\d+);"), F.lit(1)))
    unit = lambda n: F.decode(F.unhex(F.lpad(F.hex(F.pmod(n.cast("decimal(38,0)"), F.lit(65536)).cast("long")), 4, "0")), "UTF-16BE")
    return F.replace(F.aggregate(numbers, named, lambda c, n: F.replace(c, F.concat(F.lit("&#"), n, F.lit(";")), unit(n))), F.lit("&amp;"), F.lit("&"))


def inline_markdown(html: Column) -> Column:
    """Emphasis, code and links as Markdown has them; other tags go, line breaks stay."""
    unwound = settled(html, INLINE, F.regexp_count(html, F.lit(INLINE_TAG)) + 1)
    bare = F.regexp_replace(F.regexp_replace(unwound, r"(?i)<\s*br\s*/?>", "\n"), "<[^>]+>", "")
    return trimmed(F.regexp_replace(decoded(bare), r"[ \t]+", " "))


def table_rows(html: Column) -> Column:
    """Rows of cells of a table, each cell on one line; rows without cells are left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?i)<tr\b[^>]*>([\s\S]*?)</tr>"), F.lit(1))
    cell = lambda c: F.regexp_replace(inline_markdown(c), r"\s*\n\s*", " ")
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?i)<td\b[^>]*>([\s\S]*?)</td>"), F.lit(1)), cell)
    return F.filter(F.transform(rows, cells), lambda r: F.size(r) > 0)


def word_count(html: Column) -> Column:
    """How many words the text of a part of a page has, bullets aside."""
    rest = trimmed(F.regexp_replace(html_plain_text(html), r"[•\s]+", " "))
    return F.when(rest == "", 0).otherwise(F.size(F.split(rest, " "))).cast("long")


def escape_xml(text: Column) -> Column:
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")), text)


# What goes from a line of Markdown, in this order; then marks inside it, until none is left.
MARKDOWN_LINE = ((r"^\s{0,3}#{1,6}\s+", ""), (r"^\s{0,3}>\s?", ""), (r"^(\s*)[-*+]\s+", "$1• "), (r"^(\s*)(\d+)\.\s+", "$1$2. "))
#: All up to the next mark, with at least one character: atomic, so that neither long texts nor unclosed marks go deep or back.
UP_TO = r"(?>[\s\S]+?(?={}))"
STARS = UP_TO.format(r"\*\*")
#: A mark with a space inside its ends is no mark: it is matched as a whole and stays.
MARKS = (
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"`([^`]+)`", "$1"),
    (rf"(~~(?:(?=\s){UP_TO.format('~~')}|{UP_TO.format('~~')}(?<=\s))~~)|~~({UP_TO.format('~~')})~~", "$1$2"),
    *((rf"({m}(?!\*\*)(?:(?=\s){STARS}|{STARS}(?<=\s)){m})|{m}(?!\*\*)({STARS}){m}", "$1$2") for m in (r"\*\*\*", r"\*\*")),
    (r"(\*(?:\s[^*]*|[^*]*\s)\*)|\*([^*]+)\*", "$1$2"),
    (r"(^|[^\w])__(?!\s)([\s\S]+?)(?<!\s)__(?!\w)", "$1$2"),
    (r"(^|[^\w])_(?!\s)([^_]+?)(?<!\s)_(?!\w)", "$1$2"),
)
FENCED = r"(?:\A|\r?\n)[^\S\n]*(?:```|~~~)[^\n]*"
RULE = r"^\s*(?:\*\s*\*\s*\*[\s*]*|-\s*-\s*-[\s-]*)\z"


def stripped_marks(text: Column) -> Column:
    """Markdown's marks inside a line go, innermost ones too."""
    return settled(text, MARKS, F.regexp_count(text, F.lit(r"[`~*_\[]")) / 2 + 1)


def markdown_line(line: Column) -> Column:
    """A line outside fences as plain text; a rule is an empty line."""
    return F.when(line.rlike(RULE), "").otherwise(stripped_marks(replaced(line, MARKDOWN_LINE)))


def markdown_plain_text(source: Column) -> Column:
    """Plain text of a whole Markdown source: fences go and what is between them stays as it is.

    The source is cut at its fences, so every other part is outside; a part behind a fence begins with the line break of that fence.
    """
    parts = F.split(source, FENCED)
    outside = lambda x: F.array_join(F.transform(F.split(x, "\r?\n"), markdown_line), "\n")
    shown = lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit("\r\n"), F.lit("\n"))).otherwise(outside(x))
    behind = lambda x, i: F.when(i == 0, shown(x, i)).when(x != "", shown(F.regexp_replace(x, r"\A\n", ""), i))
    kept = F.when(source.rlike(FENCED), F.array_join(F.transform(parts, behind), "\n")).otherwise(outside(source))
    return trimmed(F.regexp_replace(kept, r"\n{3,}", "\n\n"))
