"""Folds over the tags of a page: divisions, list items and blocks, each in one pass with a stack, whatever the nesting.

Patterns read ASCII letters in either case, as the column expressions beside them do.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from functools import partial

from .markup import DEFINITIONS

_tags = partial(re.compile, flags=re.ASCII | re.IGNORECASE)
# Elements that are blocks inside a division, and those that become blocks of their own.
INSIDE = "div|p|h[1-6]|ul|ol|li|table|tr|td|blockquote|pre|hr|dl|dt|dd"
OWN = "h[1-6]|p|li|blockquote|pre|table"
DIVISION, ITEM = _tags(rf"<div\b[^>]*>|</div>|<(?:{INSIDE})\b"), _tags(r"</?(?:ol|ul|li)\b")
OPENS, CLOSES = _tags(rf"<({OWN})\b[^>]*>|<hr\b[^>]*>"), _tags(rf"</({OWN})>")
STEPS = [(re.compile(p, re.ASCII), new) for p, new in DEFINITIONS]


def divided(html: str) -> str:
    """Divisions of text alone as paragraphs, others unwrapped; unmatched tags stay. Terms and definitions are paragraphs too."""
    out, at, held = [], 0, []  # held: for each open division where its tag is in `out`, and whether a block is inside
    for m in DIVISION.finditer(html):
        tag = m.group()
        if tag[1] == "/":
            if not held:
                continue
            place, blocks = held.pop()
            out += [html[at : m.start()], "" if blocks else "</p>"]
            out[place] = "" if blocks else "<p>"
            at = m.end()
        elif tag[-1] == ">":
            out += [html[at : m.start()], tag]
            held.append([len(out) - 1, False])
            at = m.end()
            continue
        if held:
            held[-1][1] = True
    text = "".join(out) + html[at:]
    for pattern, new in STEPS:
        text = pattern.sub(new, text)
    return text


def marked(html: str) -> str:
    """Each list item closed before a list inside it, and its opening tag with the depth and kind of the list it is in."""
    out, at, lists, before = [], 0, [], ""
    for m in ITEM.finditer(html):
        tag = m.group().lower()
        if tag == "<li":
            out += [html[at : m.end()], " data-ordered" if lists and lists[-1] == "o" else "", f' data-depth="{max(0, len(lists) - 1)}"']
            at = m.end()
        elif tag in ("<ul", "<ol"):
            if before == "<li":
                out += [html[at : m.start()], "</li>"]
                at = m.start()
            lists.append(tag[1])
        elif tag != "</li":
            if lists and lists[-1] == tag[2]:  # a stray closing tag closes nothing
                lists.pop()
            continue
        before = tag
    return "".join(out) + html[at:]


def blocks(html: str) -> tuple[list[str], str]:
    """The sources of the blocks, each up to the first end tag of its kind, and all that is in none of them."""
    ends = defaultdict(list)
    for m in CLOSES.finditer(html):
        ends[m[1].lower()].append(m.end())
    found, rest, at, place = [], [], 0, 0
    while m := OPENS.search(html, place):
        place = m.start() + 1  # an element without an end is none
        if m[1] is None:
            end = m.end()
        else:
            closing = ends[m[1].lower()]
            i = bisect_left(closing, m.end() + len(m[1]) + 3)
            if i == len(closing):
                continue
            end = closing[i]
        found.append(html[m.start() : end])
        rest.append(html[at : m.start()])
        at = place = end
    return found, "".join(rest) + html[at:]
