"""Markdown as typed blocks: one fold over a document's lines that carries the open items, fence, quote, table and paragraph."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.markup import stripped_marks

from .each import read_each

HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\Z", re.S)
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*\Z)|~{3,})")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-*+]|(\d{1,9})[.)])(?:( {1,4})(?! )|( )(?= )|\Z)")
TASK = re.compile(r"\[[ xX]\] +")
DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
REFERENCE = re.compile(r" {0,3}\[[^\]]+\]:[ \t]*\S+")
# Elements that begin a block of HTML, which ends with an empty line.
HTML_NAMES = """address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption
figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem meta nav noframes ol optgroup option p
param search section summary table tbody td tfoot th thead title tr track ul""".split()
HTML = re.compile(rf" {{0,3}}(?:</?(?:{'|'.join(HTML_NAMES)})(?=[\s/>]|\Z)|<(?:script|pre|style|textarea)(?=[\s>]|\Z)|<!--|<\?|<![A-Z])", re.I)


def _interrupts(line: str) -> bool:
    """Whether a line begins a block even where a paragraph could go on."""
    item = ITEM.match(line)
    begins = item and item.end() < len(line) and item[3] in (None, "1")
    return bool(begins or FENCE.match(line) or HEADING.match(line) or RULE.match(line) or QUOTE.match(line) or HTML.match(line))


def _cells(line: str) -> list[str]:
    text = line.strip()
    text = text[1:] if text.startswith("|") else text
    text = text[:-1] if text.endswith("|") and not text.endswith("\\|") else text
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", text)]


class Fold:
    """The blocks of the lines so far, and what is open. An item is its content's column, own lines, whether lists are inside, and its block."""

    def __init__(self):
        self.blocks, self.items, self.lists, self.blanks = [], [], "", 0
        self.fence, self.open, self.kind, self.after_blank = None, [], "", False

    def close(self) -> None:
        """Ends the open paragraph, quote, table, code or HTML."""
        kind, lines, self.kind, self.open, self.fence = self.kind, self.open, "", [], None
        if kind == "paragraph":
            self.blocks.append({"kind": kind, "text": "\n".join(lines).rstrip()})
        elif kind == "code":
            self.blocks.append({"kind": kind, "text": "\n".join(lines)})
        elif kind == "indented":
            self.blocks.append({"kind": "code", "text": "\n".join(lines).rstrip("\n")})
        elif kind == "quote":
            parts = [b.get("text") or "" for b in read(lines, spaces=True) if b["kind"] not in ("bullet", "table")]
            self.blocks.append({"kind": kind, "text": "\n".join(parts).strip()})
        elif kind == "table":
            width = len(lines[0])
            self.blocks.append({"kind": kind, "rows": [(r + [""] * width)[:width] for r in lines]})

    def item(self, column: int, m: re.Match, line: str) -> None:
        """A new item, of a list inside the items that are open."""
        rest = line[m.end() :]
        ordered = m[3] is not None
        width = m.end() if m[4] and rest.strip() else len(m[1]) + len(m[2]) + 1
        self.lists = self.lists[: len(self.items)] + ("o" if ordered else "u")
        block = {"kind": "bullet", "ordered": ordered, "depth": len(self.items), "lists": self.lists, "text": ""}
        if self.items:
            self.items[-1][2] = True
        self.blocks.append(block)
        self.items.append([column + width, [], False, block])
        self.fence, self.blanks = None, 0
        inner = ITEM.match(rest)
        if inner and not RULE.match(rest):
            self.item(column + width, inner, rest)
        elif rest.strip():
            self.own(TASK.sub("", rest, count=1) if TASK.match(rest) else rest)

    def own(self, line: str) -> None:
        """A line of the innermost item's own text; fences are watched, as markers in them are none."""
        lines = self.items[-1][1]
        lines += [""] * self.blanks + [line]
        self.blanks = 0
        mark = FENCE.match(line)
        if self.fence:
            if re.match(rf" {{0,3}}{self.fence[0]}{{{len(self.fence)},}}[ \t]*\Z", line):
                self.fence = None
        elif mark:
            self.fence = mark[2]

    def leave(self, column: int) -> None:
        """Ends the items whose content begins to the right of the column."""
        while self.items and self.items[-1][0] > column:
            _, lines, nested, block = self.items.pop()
            block["text"] = " ".join(b.get("text") or "" for b in read(lines) if b["kind"] != "bullet") if nested else "\n".join(lines).rstrip()
            self.fence = None
        if not self.items:
            self.lists = ""

    def in_list(self, line: str, indent: int) -> bool:
        """Takes a line that belongs to the open items."""
        if not line:
            self.blanks += 1
            return True
        top = self.items[-1][0]
        if indent >= top:
            inner = line[top:]
            m = None if self.fence else ITEM.match(inner)
            if m and not RULE.match(inner):
                self.item(top, m, inner)
            else:
                self.own(inner)
            return True
        lazy = not self.blanks and not self.fence and self.items[-1][1] and not FENCE.match(self.items[-1][1][-1])
        if lazy and not _interrupts(line) and not ITEM.match(line.lstrip(" ")):
            self.own(line.lstrip(" "))
            return True
        blanks = self.blanks
        self.leave(indent)
        left = line[self.items[-1][0] :] if self.items else line
        m = ITEM.match(left)
        if m and not RULE.match(left):
            self.item(self.items[-1][0] if self.items else 0, m, left)
            return True
        self.blanks = blanks if self.items else 0
        if self.items:
            self.own(left)
        return bool(self.items)

    def add(self, line: str) -> None:
        tabs = len(line) - len(line.lstrip(" \t"))
        line = line[:tabs].expandtabs(4) + line[tabs:] if line.strip() else ""
        indent = len(line) - len(line.lstrip(" "))
        if self.items and self.in_list(line, indent):
            return
        if self.kind == "code":
            if re.match(rf" {{0,3}}{self.fence[1][0]}{{{len(self.fence[1])},}}[ \t]*\Z", line):
                self.close()
            else:
                self.open.append(line[min(indent, self.fence[0]) :])
            return
        if self.kind == "quote":
            m = QUOTE.match(line)
            if m:
                self.open.append(line[m.end() :])
                return
            if line and self.open[-1].strip() and not _interrupts(line) and not _interrupts(self.open[-1]):
                self.open.append(line.lstrip(" "))
                return
            self.close()
        if self.kind == "indented":
            if indent >= 4 or not line:
                self.open.append(line[4:])
                return
            self.close()
        if not line:
            self.close()
            self.after_blank = True
            return
        if self.kind == "html":
            return
        if self.kind == "table":
            if not _interrupts(line):
                self.open.append(_cells(line))
                return
            self.close()
        if self.kind == "paragraph":
            if DELIMITERS.match(line) and ("|" in line or "|" in self.open[-1]) and len(_cells(line)) == len(_cells(self.open[-1])):
                header = self.open.pop()
                if self.open:
                    self.close()
                self.kind, self.open = "table", [_cells(header)]
                return
            m = UNDERLINE.match(line)
            if m:
                lines, self.open, self.kind = self.open, [], ""
                self.blocks.append({"kind": "heading", "level": 1 if m[1][0] == "=" else 2, "text": "\n".join(lines).strip()})
                return
            if not _interrupts(line):
                self.open.append(line)
                return
            self.close()
        self.begin(line, indent)

    def begin(self, line: str, indent: int) -> None:
        """The first line of a block outside lists."""
        if self.after_blank and self.blocks:
            self.blocks.append({"kind": "space"})
        self.after_blank = False
        fence, heading, item, quote = FENCE.match(line), HEADING.match(line), ITEM.match(line), QUOTE.match(line)
        if indent >= 4:
            self.kind, self.open = "indented", [line[4:]]
        elif fence:
            self.kind, self.fence = "code", (len(fence[1]), fence[2])
        elif heading:
            self.blocks.append({"kind": "heading", "level": len(heading[1]), "text": (heading[2] or "").strip()})
        elif RULE.match(line):
            self.blocks.append({"kind": "rule"})
        elif item:
            self.item(0, item, line)
        elif quote:
            self.kind, self.open = "quote", [line[quote.end() :]]
        elif HTML.match(line):
            self.kind = "html"
        elif not REFERENCE.match(line):
            self.kind, self.open = "paragraph", [line.lstrip(" ")]


def read(lines: list[str], spaces: bool = False) -> list[dict]:
    """The blocks of lines; with `spaces`, also where empty lines part them."""
    fold = Fold()
    for line in lines:
        fold.add(line)
    fold.leave(-1)
    fold.close()
    return [b for b in fold.blocks if spaces or b["kind"] != "space"]


def read_markdown(docs: DataFrame, key: str, text: str, whole: bool = False) -> DataFrame:
    """key, pos (from 0), kind, level, ordered, depth, lists, source, cells, text and rows: the blocks of each document's Markdown.

    lists: the kinds of the lists that an item is in, outermost first (`u` or `o`); source and cells: with marks, text and rows: without them.
    HTML and link references are left out; quotes are one block, their lists and tables left out. A null text has no blocks; with `whole`, a document
    without blocks is a row without a kind.
    """

    def make(source: str | None) -> Iterator[tuple]:
        blocks = read(re.split(r"\r\n|\n|\r", source or ""))
        for i, b in enumerate(blocks or ([{"kind": None}] if whole else [])):
            yield i, b["kind"], b.get("level"), b.get("ordered", False), b.get("depth", 0), b.get("lists"), b.get("text"), b.get("rows")

    raw = read_each(docs, key, [text], make, "pos long, kind string, level int, ordered boolean, depth int, lists string, source string, cells array<array<string>>")
    shown = F.when(F.col("kind") == "code", F.col("source")).otherwise(stripped_marks(F.col("source")))
    return raw.withColumns({"text": shown, "rows": F.transform("cells", lambda r: F.transform(r, stripped_marks))})
