"""Conversions of documents from one format to another, along the route that the planner finds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import cells as C
from folioflow.functions import markup as M
from folioflow.plans import routes as R
from folioflow.plans.catalog import FORMATS
from folioflow.sources.delimited import read_tables, sniffed
from folioflow.sources.markdown import read_markdown
from folioflow.sources.records import read_json
from folioflow.sources.rtf import rtf_paragraphs, rtf_plain_text, rtf_runs

from . import blocks as B
from . import html as H
from .rtf import rtf_of, sized_blocks

# MIME types of formats.
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "odt": "application/vnd.oasis.opendocument.text",
    "rtf": "application/rtf",
    "html": "text/html",
    "epub": "application/epub+zip",
    "md": "text/markdown",
    "txt": "text/plain",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "csv": "text/csv",
    "json": "application/json",
}


#: A workbook between two steps: its sheets as JSON, their names as workbooks allow them.
WORKBOOK = "array<struct<name:string,rows:array<array<string>>>>"
LOST = "array<struct<step:string,code:string,severity:string,n:bigint>>"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
MERGED = r"""(?i)<td\b[^>]*\b(?:col|row)span\s*=\s*["']?[2-9]"""
#: The largest file that is read, in bytes.
LARGEST = 100 << 20


def output_name(name: Column, fmt: str, suffix: Column | None = None) -> Column:
    """The name of a converted file: the original's up to its last dot, a suffix, the new extension."""
    return F.concat(C.stem(name), F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit(""), F.lit(f".{fmt}"))


def _lost(*items: tuple[str, str, Column]) -> Column:
    """Losses (code, severity, how many) that there are."""
    listed = F.array(*[F.struct(F.lit("").alias("step"), F.lit(c).alias("code"), F.lit(s).alias("severity"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for c, s, n in items])
    return F.filter(listed, lambda x: x["n"] > 0)


def _made(df: DataFrame, text: Column, lost: Column | None = None, suffix: Column | None = None, error: Column | None = None, file: str = "file") -> DataFrame:
    """What an edge gives: file, text, lost, suffix and error."""
    none = F.array().cast(LOST)
    return df.select(F.col(file).alias("file"), F.coalesce(text, F.lit("")).alias("text"), (none if lost is None else F.coalesce(lost, none)).cast(LOST).alias("lost"), (F.lit("") if suffix is None else suffix).alias("suffix"), (F.lit("") if error is None else error).alias("error"))


def _html_to_md(files: DataFrame) -> DataFrame:
    seen = _lost(*[(code, tier, F.regexp_count("text", F.lit(p))) for code, tier, p in M.LOSSES])
    parts = B.page_parts(files.select(F.struct("file", seen.alias("seen")).alias("k"), "text"), "k", "text")
    tables = F.array_join(F.filter("sources", lambda x: F.lower(x).startswith("<table")), "")
    more = _lost(("merged_cells", "changed", F.regexp_count(tables, F.lit(MERGED))), ("stranded_words", "lost", M.word_count(F.col("rest"))))
    known = parts.select(F.struct(F.col("k.file").alias("file"), F.concat("k.seen", more).alias("lost")).alias("k"), "sources")
    return _made(B.markdown_of(B.blocks_of(known, "k", whole=True), "k"), F.col("markdown"), F.col("k.lost"), file="k.file")


def _md_to_txt(files: DataFrame) -> DataFrame:
    return _made(files, M.markdown_plain_text(F.col("text")))


def _md_to_html(files: DataFrame) -> DataFrame:
    made = H.html_of(read_markdown(files, "file", "text", whole=True), "file")
    return _made(made, H.page_of(F.coalesce("file.stem", F.lit("")), F.col("html")))


def _md_to_rtf(files: DataFrame) -> DataFrame:
    known = files.select(F.struct("file", F.regexp_count("text", F.lit(IMAGE)).alias("images")).alias("k"), "text")
    made = rtf_of(read_markdown(known, "k", "text", whole=True), "k")
    # only rows of tables begin like this: marks inside texts are escaped
    return _made(made, F.col("rtf"), _lost(("rtf_tables", "changed", F.col("rtf").contains(r"\pard\sa60 ").cast("int")), ("md_images", "lost", F.col("k.images"))), file="k.file")


def _rtf_to(files: DataFrame, text: Callable[[DataFrame], DataFrame], lost: Column | None = None) -> DataFrame:
    runs = rtf_runs(files, "file", "text")
    refused = _made(runs.filter("reason <> ''"), F.lit(""), error=F.col("reason"))
    return _made(text(runs), F.col("text"), lost).unionByName(refused)


def _rtf_to_md(files: DataFrame) -> DataFrame:
    def text(runs: DataFrame) -> DataFrame:
        blocks = sized_blocks(rtf_paragraphs(runs, "file"), "file").withColumns({"depth": F.lit(0), "rows": F.lit(None).cast("array<array<string>>")})
        return B.markdown_of(blocks, "file").withColumnRenamed("markdown", "text")

    return _rtf_to(files, text, _lost(("rtf_headings_inferred", "note", F.lit(1))))


def _tables(files: DataFrame) -> DataFrame:
    """file (with the losses), rows and error of delimited texts."""
    known = sniffed(files, "text", "_d")
    keyed = known.select(F.struct("file", _lost(("csv_delimiter", "note", (F.col("_d") != ",").cast("int"))).alias("lost")).alias("k"), "text", "_d")
    return read_tables(keyed, "k", "text", "_d").withColumn("error", F.when(F.size("rows") == 0, "no_rows").otherwise(""))


def _csv_to_md(files: DataFrame) -> DataFrame:
    return _made(_tables(files), C.padded_pipe_table(F.col("rows")), F.col("k.lost"), error=F.col("error"), file="k.file")


def _csv_to_xlsx(files: DataFrame) -> DataFrame:
    book = F.to_json(F.array(F.struct(F.lit("Sheet1").alias("name"), "rows")))
    return _made(_tables(files), F.when(F.col("error") == "", book), F.col("k.lost"), error=F.col("error"), file="k.file")


def _json_to_xlsx(files: DataFrame) -> DataFrame:
    rows = read_json(files, "file", "text")
    by_sheet = rows.groupBy("file", "sheet", "name", "reason").agg(F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("x"))
    cells = F.transform("x", lambda r: r["cells"])
    name = F.coalesce(F.nullif(C.sheet_name(F.col("name")), F.lit("")), F.lit("Sheet1"))
    sheets = by_sheet.groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("reason") == "", F.struct("sheet", name.alias("name"), cells.alias("rows"))))).alias("s"), F.max("reason").alias("error"))
    nested = F.exists("s", lambda s: F.exists(F.get(s["rows"], F.lit(0)), lambda c: c.contains(".")))
    book = F.to_json(F.transform("s", lambda s: F.struct(s["name"].alias("name"), s["rows"].alias("rows"))))
    return _made(sheets, F.when(F.col("error") == "", book), _lost(("json_flattened", "changed", nested.cast("int"))), error=F.col("error"))


def _sheets(files: DataFrame) -> DataFrame:
    return files.withColumn("s", F.from_json("text", WORKBOOK))


def _titled(sheet: Callable[[Column], Column], title: Callable[[Column], Column]) -> Column:
    """The sheets one behind another, each with a title if there are several."""
    return F.array_join(F.transform("s", lambda s: F.concat(F.when(F.size("s") > 1, title(s["name"])).otherwise(""), sheet(s["rows"]))), "\n\n")


def _xlsx_to_csv(files: DataFrame) -> DataFrame:
    """A file for each sheet."""
    each = _sheets(files).select("file", F.size("s").alias("n"), F.posexplode_outer("s").alias("at", "sheet"))
    many = F.when((F.col("at") == 0) & (F.col("n") > 1), F.col("n"))
    return _made(each, C.csv_text(F.col("sheet.rows")), _lost(("multi_sheet_csv", "note", many)), F.when(F.col("n") > 1, F.concat(F.lit("-"), C.slug(F.col("sheet.name")))).otherwise(""))


def _xlsx_to_md(files: DataFrame) -> DataFrame:
    table = lambda rows: F.coalesce(F.nullif(C.padded_pipe_table(rows), F.lit("")), F.lit("_This sheet is empty._"))
    return _made(_sheets(files), _titled(table, lambda name: F.concat(F.lit("## "), name, F.lit("\n\n"))))


def _xlsx_to_txt(files: DataFrame) -> DataFrame:
    lines = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("\t"), F.lit(" "))), "\t")), "\n")
    return _made(_sheets(files), _titled(lines, lambda name: F.concat(name, F.lit("\n"), F.repeat(F.lit("="), F.length(name)), F.lit("\n"))))


def _xlsx_to_json(files: DataFrame) -> DataFrame:
    few = F.size(F.filter("s", lambda s: F.size(s["rows"]) < 2))
    return _made(_sheets(files), C.sheets_json(F.col("s")), _lost(("json_empty_sheets", "note", few), ("json_multi_sheet", "note", F.when(F.size("s") > 1, F.size("s")))))


#: What can be converted in rows of text; formats that are archives or PDF have no edge here, but a workbook may stand between two steps.
EDGES: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {
    ("html", "md"): _html_to_md,
    ("md", "txt"): _md_to_txt,
    ("md", "html"): _md_to_html,
    ("md", "rtf"): _md_to_rtf,
    ("rtf", "txt"): lambda files: _rtf_to(files, lambda runs: rtf_plain_text(runs, "file")),
    ("rtf", "md"): _rtf_to_md,
    ("txt", "md"): lambda files: _made(files, F.col("text")),
    ("csv", "txt"): lambda files: _made(files, F.col("text")),
    ("csv", "md"): _csv_to_md,
    ("csv", "xlsx"): _csv_to_xlsx,
    ("json", "xlsx"): _json_to_xlsx,
    ("xlsx", "csv"): _xlsx_to_csv,
    ("xlsx", "md"): _xlsx_to_md,
    ("xlsx", "txt"): _xlsx_to_txt,
    ("xlsx", "json"): _xlsx_to_json,
}


def _step(rows: DataFrame, a: str, b: str, tag: str) -> DataFrame:
    """Takes rows (file, text) over an edge; a file then has the format, name and losses of what was made. Files with an error go along as they are."""
    made, file = EDGES[a, b](rows), F.col("file")
    said = F.transform("lost", lambda x: F.struct(F.lit(tag).alias("step"), x["code"].alias("code"), x["severity"].alias("severity"), x["n"].alias("n")))
    error = F.when(F.col("error") != "", F.col("error")).when(F.col("text") == "", "empty_output").otherwise("")
    stem = F.concat(file["stem"], F.col("suffix"))
    new = {"fmt": F.lit(b), "stem": stem, "name": F.concat(stem, F.lit(f".{b}")), "lost": F.concat(file["lost"], said), "error": error}
    return made.select(F.when(file["error"] != "", file).otherwise(reduce(lambda f, x: f.withField(*x), new.items(), file)).alias("file"), "text")


def convert_mixed(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """id, name, fmt, text, lost and error of files (id, name, src, dst, text), each taken from its own format to the one it asks for.

    Only the pairs of formats that occur, 196 at most, come to the driver; the files of a pair are converted together. A file's columns travel with
    it, so that ids may repeat, and a step may make several files of one. What cannot be done is a row with an error: `empty_input`, `too_large`, `unknown_format`,
    `no_route`, `no_engine` (a route over a format that has no edge here), or what a step says (`empty_output`, `no_rows`, `not_rtf`, `no_text`, `invalid`,
    `single_value`, `empty`). lost: step (`.a → .b`, empty for a single one), code, severity and count of what was lost.

    A row id keeps equal files apart; it is drawn once and never joined with another reading of the files.
    """
    known = [f for f, _ in FORMATS]
    spark = files.sparkSession
    found = R.routes(spark).select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "via")
    text = F.coalesce("text", F.lit(""))
    routed = files.select("id", "name", "src", "dst", text.alias("text")).join(F.broadcast(found), (F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst")), "left")
    first = F.when(F.col("via") == "", F.col("dst")).otherwise(F.col("via"))
    can = F.concat_ws(">", "src", first).isin(*[">".join(e) for e in EDGES]) & ((F.col("via") == "") | F.concat_ws(">", "via", "dst").isin(*[">".join(e) for e in EDGES]))
    error = (
        F.when(~F.coalesce(F.col("src").isin(*known) & F.col("dst").isin(*known), F.lit(False)), "unknown_format").when(F.col("via").isNull(), "no_route").when(~can, "no_engine")
        .when(F.col("text") == "", "empty_input").when(F.octet_length("text") > largest, "too_large").otherwise("")
    )
    file = F.struct("id", "name", C.stem(F.col("name")).alias("stem"), F.col("src").alias("fmt"), F.array().cast(LOST).alias("lost"), error.alias("error"), F.monotonically_increasing_id().alias("row"))
    rows = routed.select("src", "dst", file.alias("file"), "text")
    out = rows.filter("file.error <> ''").select("file", F.lit("").alias("text"))
    vias = {(r["_src"], r["_dst"]): r["via"] for r in found.collect()}
    for src, dst in files.select("src", "dst").filter(F.col("src").isin(*known) & F.col("dst").isin(*known)).distinct().collect():
        stops = [x for x in (src, vias.get((src, dst)), dst) if x]
        steps = list(zip(stops, stops[1:]))
        if (src, dst) in vias and all(e in EDGES for e in steps):
            made = rows.filter((F.col("src") == src) & (F.col("dst") == dst) & (F.col("file.error") == "")).select("file", "text")
            for a, b in steps:
                made = _step(made, a, b, f".{a} → .{b}" if len(steps) > 1 else "")
            out = out.unionByName(made)
    return out.select("file.id", "file.name", "file.fmt", "text", "file.lost", "file.error")


def convert(files: DataFrame, src: str, dst: str) -> DataFrame:
    """id, name, mime, text, warnings and error of files (id, name, text) taken from one format to another, as `convert_mixed` does.

    A file without text has the error `empty_output`; a route that needs a format without an edge is a ValueError.
    """
    found = R.routes(files.sparkSession).filter((F.col("src") == src) & (F.col("dst") == dst)).first()
    if found is None:
        raise ValueError(f"no route from {src} to {dst}")
    stops = [src, *([found["via"]] if found["via"] else []), dst]
    for step in zip(stops, stops[1:]):
        if step not in EDGES:
            raise ValueError(f"{step[0]} to {step[1]} is not a conversion of text")
    made = convert_mixed(files.select("id", "name", F.lit(src).alias("src"), F.lit(dst).alias("dst"), "text"))
    warning = lambda x: F.concat(F.when(x["step"] != "", F.concat(x["step"], F.lit(": "))).otherwise(""), x["code"], F.lit(":"), x["n"].cast("string"))
    error = F.when(F.col("error") == "empty_input", "empty_output").otherwise(F.col("error"))
    name = F.when(F.col("fmt") == dst, F.col("name")).otherwise(output_name(F.col("name"), dst))
    return made.select("id", name.alias("name"), F.lit(MIME[dst]).alias("mime"), "text", F.transform("lost", warning).alias("warnings"), error.alias("error"))
