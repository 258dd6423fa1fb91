"""Delimited text as rows of cells, with quotes that may begin and end anywhere in a cell."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .each import read_each


def rows_of(text: str, delimiter: str) -> list[list[str]]:
    """Rows of a text: a doubled quote between quotes is one, line breaks between quotes belong to the cell, an open quote takes the rest.

    Carriage returns outside quotes go; rows may differ in length; rows of empty cells alone are left out.
    """
    part = re.compile(rf'"((?:[^"]|"")*)(?:"|\Z)|({re.escape(delimiter)})|(\n)|([^"\n{re.escape(delimiter)}]+)')
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    for m in part.finditer(text):
        if m[2] or m[3]:
            row.append("".join(cell))
            cell = []
            if m[3]:
                rows.append(row)
                row = []
        else:
            cell.append(m[4].replace("\r", "") if m[4] else m[1].replace('""', '"'))
    if row or any(cell):
        rows.append([*row, "".join(cell)])
    return [r for r in rows if any(r)]


def sniffed(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the delimiter of each text: that met most in its first 20 lines outside quotes; of equals the first of , ; tab |, without any a comma."""
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20), "\n")
    bare = F.regexp_replace(head, '"[^"]*("|\\z)', "")  # an open quote takes the rest
    marks = (",", ";", "\t", "|")
    counts = F.array(*[F.struct((F.length("_bare") - F.length(F.replace("_bare", F.lit(c), F.lit("")))).alias("n"), F.lit(-i).alias("at"), F.lit(c).alias("c")) for i, c in enumerate(marks)])
    return docs.withColumn("_bare", bare).withColumn(name, F.array_max(counts)["c"]).drop("_bare")


def read_delimited(docs: DataFrame, key: str, text: str, delimiter: str) -> DataFrame:
    """key, pos (from 0) and cells: the rows of each document's text; `delimiter` names the column that says what separates its cells.

    A null text has no rows. The parser looks at one document at a time, as quotes may span all of it.
    """
    return read_each(docs, key, [text, delimiter], lambda t, d: enumerate(rows_of(t or "", d or ",")), "pos long, cells array<string>")


def read_tables(docs: DataFrame, key: str, text: str, delimiter: str) -> DataFrame:
    """key and rows: all rows of each document's text as one value, without a shuffle."""
    return read_each(docs, key, [text, delimiter], lambda t, d: [(rows_of(t or "", d or ","),)], "rows array<array<string>>")
