"""JSON texts as sheets: leaves of their values as rows, from which Spark makes headers and cells.

A leaf is a value that is not a record, with the path to it as its column. Which columns a sheet has, in the order in which they are first seen
over all its records, is a grouping of the leaves; so is each row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .each import read_each

LEAVES = "sheet long, name string, record long, place long, col string, cell string, grid boolean, reason string"


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _shown(value: object) -> str:
    """A leaf as the text of a cell."""
    match value:
        case None:
            return ""
        case str():
            return value
        case list():
            return ", ".join(_shown(x) for x in value)
        case float() if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _leaves(record: object) -> Iterator[tuple[str, str]]:
    """Paths and texts of a record's leaves in order; anything else than a record is one leaf named `value`."""
    open_ = [("", iter(record.items()))] if isinstance(record, dict) else []
    if not open_:
        yield "value", _shown(record)
    while open_:
        path, rest = open_[-1]
        for name, value in rest:
            if isinstance(value, dict):
                open_.append((f"{path}{name}.", iter(value.items())))
                break
            yield path + name, _shown(value)
        else:
            open_.pop()


def leaves_of(text: str | None) -> Iterator[tuple]:
    """Rows of LEAVES of one text. A record without leaves is a row without a column; a text without sheets is a row that tells why."""
    try:
        parsed = json.loads(text or "", parse_constant=_refuse)
        why = "" if isinstance(parsed, (dict, list)) else "single_value"
    except (ValueError, RecursionError):
        parsed, why = [], "invalid"
    if why == "" and parsed == []:
        why = "empty"
    if why:
        yield (None,) * 7 + (why,)
        return
    lists = [x for x in parsed.items() if isinstance(x[1], list)] if isinstance(parsed, dict) else [("Sheet1", parsed)]
    some = False
    for sheet, (name, records) in enumerate(lists or [("Sheet1", [parsed])]):
        grid = isinstance(parsed, list) and all(isinstance(r, list) for r in records)
        for i, record in enumerate(records):
            cells = dict(enumerate(map(_shown, record))).items() if grid else dict(_leaves(record)).items()
            for place, (column, cell) in enumerate(cells):
                some = True
                yield sheet, name, i, place, str(column), cell, grid, ""
            if not cells:
                yield sheet, name, i, None, None, None, grid, ""
                some |= grid
    if not some:
        yield (None,) * 7 + ("empty",)


def read_json(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sheet (its place), name, pos (0 is the header), cells and reason: the rows of each document's sheets.

    A list of records is one sheet, a list of lists a grid, an object whose values are lists a sheet for each, another object one
    row. A document without sheets is one row that tells the reason (invalid, single_value, empty); a null text is invalid. Sheets whose records
    have no leaves have no rows.
    """
    leaves = read_each(docs, key, [text], leaves_of, LEAVES)
    refused = leaves.filter("reason <> ''").select(key, "sheet", "name", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("array<string>").alias("cells"), "reason")
    # an outer grouping by sheet and record; what a sheet's header holds is a row for each of its columns
    leaf = F.when(F.col("col").isNotNull(), F.struct("place", "col", "cell"))
    by_row = leaves.filter("reason = ''").groupBy(key, "sheet", "name", "grid", "record").agg(F.array_sort(F.collect_list(leaf)).alias("row"))
    first = by_row.filter("NOT grid").select(key, "sheet", "name", "record", F.explode("row").alias("x")).groupBy(key, "sheet", "name", F.col("x.col").alias("col")).agg(F.min(F.struct("record", "x.place")).alias("seen"))
    headers = first.groupBy(key, "sheet", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "col"))), lambda x: x["col"]).alias("header"))
    names = headers.select(key, "sheet", "name", F.lit(0).cast("long").alias("pos"), F.col("header").alias("cells"), F.lit("").alias("reason"))
    cell = lambda c: F.coalesce(F.element_at(F.map_from_entries(F.transform("row", lambda x: F.struct(x["col"], x["cell"]))), c), F.lit(""))
    named = headers.select(F.col(key).alias("_key"), F.col("sheet").alias("_sheet"), "header")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("sheet") == F.col("_sheet"))
    records = by_row.filter("NOT grid").join(named, same).select(key, "sheet", "name", (F.col("record") + 1).alias("pos"), F.transform("header", cell).alias("cells"), F.lit("").alias("reason"))
    grids = by_row.filter("grid").select(key, "sheet", "name", F.col("record").alias("pos"), F.transform("row", lambda x: x["cell"]).alias("cells"), F.lit("").alias("reason"))
    return names.unionByName(records).unionByName(grids).unionByName(refused).select(key, "sheet", "name", "pos", "cells", "reason")
