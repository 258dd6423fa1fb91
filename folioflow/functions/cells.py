"""Rows of cells as text: CSV, pipe tables, tab-separated text; names of sheets, headers and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_cell(cell: Column) -> Column:
    """Quoted only if it holds a quote, comma or line break; quotes doubled."""
    text = F.coalesce(cell, F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *map(csv_cell, cells))


def pipe_cell(cell: Column) -> Column:
    return F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def pipe_line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(pipe_cell, cells)), F.lit(" |"))


def padded_pipe_table(rows: Column) -> Column:
    """A table of an array of rows: the first is the header, all are as wide as the widest."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), cell), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def csv_text(rows: Column) -> Column:
    """Rows of cells as one CSV text, lines joined by CR and LF."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, csv_cell), ",")), "\r\n")


def distinct_headers(header: Column) -> Column:
    """Names of columns: trimmed, `column<n>` for blank ones, `<name>_<n>` for those met before; n is the place from 1."""
    names = F.transform(header, lambda h: F.trim(h))
    again = lambda n, i: (n != "") & F.array_contains(F.slice(names, F.lit(1), i), n)
    place = lambda i: (i + 1).cast("string")
    return F.transform(names, lambda n, i: F.when(n == "", F.concat(F.lit("column"), place(i))).when(again(n, i), F.concat(n, F.lit("_"), place(i))).otherwise(n))


def _quoted(text: Column) -> Column:
    """A text as JSON has it."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def sheets_json(sheets: Column) -> Column:
    """Sheets (name, rows) as indented JSON: a list of records, or an object of such lists by the sheets' names, with a line break at the end."""

    def records(rows: Column, indent: str) -> Column:
        keys = distinct_headers(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")))
        body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
        field = lambda r: lambda k, i: F.concat(F.lit(f"{indent}    "), _quoted(k), F.lit(": "), _quoted(F.coalesce(F.get(r, i), F.lit(""))))
        record = lambda r: F.when(F.size(keys) == 0, F.lit(f"{indent}  {{}}")).otherwise(F.concat(F.lit(f"{indent}  {{\n"), F.array_join(F.transform(keys, field(r)), ",\n"), F.lit(f"\n{indent}  }}")))
        return F.when(F.size(body) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(body, record), ",\n"), F.lit(f"\n{indent}]")))

    named = F.transform(sheets, lambda s: F.concat(F.lit("  "), _quoted(s["name"]), F.lit(": "), records(s["rows"], "  ")))
    one = records(F.get(sheets, F.lit(0))["rows"], "")
    return F.concat(F.when(F.size(sheets) == 1, one).otherwise(F.concat(F.lit("{\n"), F.array_join(named, ",\n"), F.lit("\n}"))), F.lit("\n"))


def tsv_line(*cells: Column) -> Column:
    return F.concat_ws("\t", *[F.replace(F.coalesce(c, F.lit("")), F.lit("\t"), F.lit(" ")) for c in cells])


def slug(name: Column) -> Column:
    """Letters and digits, other runs as hyphens, lower case; `sheet` if nothing is left."""
    text = F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""))
    return F.when(text == "", "sheet").otherwise(text)


def sheet_name(name: Column) -> Column:
    """Without the characters that workbooks refuse, 31 characters at most."""
    return F.substring(F.regexp_replace(name, r"[\[\]:*?/\\]", " "), 1, 31)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; none for names that start or end with it."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)\z", 1))


def base_name(name: Column) -> Column:
    """The name without its extension."""
    return F.when(extension(name) == "", name).otherwise(F.left(name, F.length(name) - F.length(extension(name)) - 1))


def stem(name: Column) -> Column:
    """The name up to its last dot, unless that is its first character; a dot at the end goes too."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*\z", "$1")


def readable_size(size: Column) -> Column:
    """Bytes for a sentence: whole MB, or GB with one decimal from 1024 MB on."""
    mb = size / (1 << 20)
    return F.when(mb >= 1024, F.format_string("%.1f GB", mb / 1024)).otherwise(F.concat(F.floor(mb + 0.5).cast("string"), F.lit(" MB")))
