"""RTF as runs of text with their size and weight: one fold over its tokens that carries the open groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.markup import trimmed

from .each import read_each

TOKEN = re.compile(r"\\(?:([a-zA-Z]+)(-?\d+)?\s?|'(.{0,2})|(.)|\Z)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
# Groups that hold no text of the body, and words that stand for characters.
HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object header footer footnote xmlns themedata colorschememapping latentstyles datastore generator".split())
CHARACTERS = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "tab": "\t", "line": "\n", "emspace": "\u2003", "enspace": "\u2002"}
#: Bold, italic and size (in half points) where nothing is said.
PLAIN = (False, False, 24)


def _joined(parts: list[str]) -> str:
    """Text of parts, among them single units of UTF-16."""
    text = "".join(parts)
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if re.search("[\ud800-\udfff]", text) else text


def runs_of(source: str) -> Iterator[tuple[int, int, str, bool, bool, int]]:
    """par, run, text, bold, italic, size. A run has the properties in force where it ends; paragraphs without text are left out."""
    style, groups, hidden, fallback, skip, par = PLAIN, [], None, 1, 0, 0
    held: list[str] = []
    runs: list[tuple] = []

    def cut() -> None:
        if held:
            runs.append((_joined(held), *style))
            held.clear()

    def ended() -> list[tuple]:
        cut()
        out = [(par, i, *r) for i, r in enumerate(runs)] if any(r[0].strip() for r in runs) else []
        runs.clear()
        return out

    for m in TOKEN.finditer(source):
        word, number, byte, sign, brace, text = m.groups()
        if brace == "{":
            groups.append(style)
            skip = 0
        elif brace == "}":
            if hidden == len(groups):
                hidden = None
            style = groups.pop() if groups else style
            skip = 0
        elif hidden is not None:
            continue
        elif text is not None:
            if len(text) > skip:
                held.append(text[skip:])
            skip = max(0, skip - len(text))
        elif skip and (word or byte is not None):
            skip -= 1  # an escape is one character for readers that know no \\u
        elif sign is not None:
            skip = 0
            if sign in "\\{}":
                held.append(sign)
        elif byte is not None:
            if re.fullmatch("[0-9a-fA-F]{2}", byte):
                held.append(chr(int(byte, 16)))
        elif word is None:  # line breaks are no text
            skip = max(0, skip - len(m.group()))
        elif word in HIDDEN:
            hidden = len(groups)
        elif word == "par":
            found = ended()
            par += bool(found)
            yield from found
        elif word in ("b", "i", "fs", "plain"):
            cut()
            bold, italic, size = style
            style = {"b": (number != "0", italic, size), "i": (bold, number != "0", size), "fs": (bold, italic, int(number) if number else size), "plain": PLAIN}[word]
        elif word == "u" and number:
            held.append(chr(int(number) % 65536))
            skip = fallback
        elif word == "uc" and number and int(number) >= 0:
            fallback = int(number)
        elif word in CHARACTERS:
            held.append(CHARACTERS[word])
    yield from ended()


def rtf_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, par and run (from 0), text, bold, italic, size and reason of each document's runs.

    A text that isn't RTF, and one without text, is one row that tells the `reason` (not_rtf, no_text); a null text isn't RTF.
    """

    def make(source: str | None) -> Iterator[tuple]:
        if not (source or "").startswith("{\\rtf"):
            yield (None,) * 6 + ("not_rtf",)
            return
        some = False
        for run in runs_of(source):
            some = True
            yield (*run, "")
        if not some:
            yield (None,) * 6 + ("no_text",)

    return read_each(docs, key, [text], make, "par long, run int, text string, bold boolean, italic boolean, size int, reason string")


def rtf_paragraphs(runs: DataFrame, key: str) -> DataFrame:
    """key, pos, size (that of the first run), bold (whether all runs are) and text of paragraphs, as `sized_blocks` reads them."""
    listed = F.array_sort(F.collect_list(F.struct("run", "text", "size")))
    of = runs.filter("reason = ''").groupBy(key, F.col("par").alias("pos")).agg(listed.alias("x"), F.min("bold").alias("bold"))
    text = trimmed(F.array_join(F.transform("x", lambda r: r["text"]), ""))
    return of.select(key, "pos", F.get("x", F.lit(0))["size"].alias("size"), "bold", text.alias("text"))


def rtf_plain_text(runs: DataFrame, key: str) -> DataFrame:
    """key and text: paragraphs parted by an empty line."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return rtf_paragraphs(runs, key).groupBy(key).agg(F.array_join(listed, "\n\n").alias("text"))
