"""Constant relations of the conversion graph."""

from __future__ import annotations

# Formats in canonical order, with their family; the hub of each family.
FORMATS = (
    ("pdf", "text"), ("docx", "text"), ("odt", "text"), ("rtf", "text"), ("html", "text"), ("epub", "text"), ("md", "text"), ("txt", "text"),
    ("pptx", "slides"), ("odp", "slides"), ("xlsx", "sheet"), ("ods", "sheet"), ("csv", "sheet"), ("json", "sheet"),
)
HUBS = ("md", "xlsx")
FIDELITY = ("exact", "good", "lossy")
# From, to, fidelity, peak memory and output size as multiples of the input.
EDGES = (
    ("docx", "md", "good", 100, 0.11), ("docx", "txt", "good", 100, 0.09), ("docx", "pdf", "lossy", 100, 0.31), ("docx", "rtf", "lossy", 125, 0.2),
    ("odt", "md", "good", 30, 0.17), ("html", "md", "lossy", 10, 0.01), ("epub", "md", "lossy", 15, 0.3), ("rtf", "txt", "good", 20, 0.42), ("rtf", "md", "lossy", 25, 0.42),
    ("pdf", "txt", "lossy", 40, 0.27), ("pdf", "md", "lossy", 65, 0.28), ("md", "docx", "good", 475, 0.06), ("md", "odt", "good", 80, 0.04), ("md", "pdf", "good", 190, 2.68),
    ("md", "rtf", "lossy", 75, 1.8), ("md", "html", "good", 65, 1.85), ("md", "epub", "good", 95, 1.81), ("md", "txt", "exact", 25, 0.85), ("txt", "md", "exact", 5, 1.0),
    ("txt", "docx", "good", 120, 0.02), ("txt", "pdf", "good", 165, 1.51), ("xlsx", "csv", "exact", 15, 0.18), ("xlsx", "ods", "good", 135, 3.26), ("xlsx", "json", "good", 15, 0.75),
    ("xlsx", "md", "good", 15, 0.24), ("xlsx", "txt", "good", 15, 0.17), ("xlsx", "pdf", "lossy", 80, 0.65), ("xlsx", "docx", "lossy", 220, 0.03), ("ods", "xlsx", "good", 15, 0.39),
    ("ods", "csv", "exact", 10, 0.05), ("ods", "md", "good", 10, 0.08), ("ods", "txt", "good", 10, 0.05), ("ods", "pdf", "lossy", 25, 0.2), ("ods", "docx", "lossy", 70, 0.01),
    ("csv", "xlsx", "exact", 310, 5.95), ("csv", "md", "good", 45, 1.46), ("csv", "txt", "exact", 5, 1.0), ("json", "xlsx", "good", 145, 2.18), ("pptx", "txt", "lossy", 5, 0.03),
    ("pptx", "md", "lossy", 5, 0.03), ("odp", "txt", "lossy", 5, 0.12), ("odp", "md", "lossy", 10, 0.13), ("md", "pptx", "good", 320, 31.13), ("md", "odp", "good", 105, 0.04),
)
# What is said of an edge before it is taken, as codes; edges without one carry everything over.
CAVEATS = (
    ("docx", "md", "structure_and_links_kept"), ("docx", "txt", "words_and_breaks_kept"), ("docx", "pdf", "pages_laid_out_again"), ("docx", "rtf", "headings_emphasis_lists_kept"),
    ("odt", "md", "structure_and_tables_kept"), ("md", "odt", "blocks_as_opendocument_styles"), ("html", "md", "styling_scripts_images_dropped"), ("md", "html", "standalone_without_stylesheet"),
    ("epub", "md", "chapters_joined"), ("md", "epub", "heading_starts_chapter"), ("md", "docx", "blocks_as_word_styles"), ("md", "pdf", "own_typography"), ("md", "rtf", "tables_as_tabbed_lines"),
    ("txt", "docx", "blocks_as_default_paragraphs"), ("txt", "pdf", "single_typeface"), ("rtf", "txt", "words_and_breaks_kept"), ("rtf", "md", "headings_by_font_size"), ("pdf", "txt", "text_layer_only"),
    ("pdf", "md", "headings_and_paragraphs_inferred"), ("xlsx", "ods", "values_and_names_kept"), ("xlsx", "json", "records_by_first_row"), ("xlsx", "md", "pipe_table_a_sheet"),
    ("xlsx", "txt", "tabbed_block_a_sheet"), ("xlsx", "pdf", "wide_sheets_clipped"), ("xlsx", "docx", "values_as_word_tables"), ("ods", "xlsx", "values_and_names_kept"), ("ods", "md", "pipe_table_a_sheet"),
    ("ods", "txt", "tabbed_block_a_sheet"), ("ods", "pdf", "wide_sheets_clipped"), ("ods", "docx", "values_as_word_tables"), ("csv", "md", "first_row_as_header"), ("json", "xlsx", "nested_keys_flattened"),
    ("pptx", "txt", "slide_text_only"), ("pptx", "md", "heading_a_slide"), ("odp", "txt", "slide_text_only"), ("odp", "md", "heading_a_slide"), ("md", "pptx", "heading_starts_slide"),
    ("md", "odp", "heading_starts_plain_slide"),
)
# Other names of formats in file extensions.
ALIASES = (
    ("markdown", "md"), ("mdown", "md"), ("mkd", "md"), ("text", "txt"), ("tsv", "csv"), ("htm", "html"), ("xhtml", "html"), ("fodt", "odt"),
    ("ott", "odt"), ("ots", "ods"), ("otp", "odp"),
)
TEXT = tuple(f for f, family in FORMATS if family == "text")
SHEET = tuple(f for f, family in FORMATS if family == "sheet")
SLIDES = tuple(f for f, family in FORMATS if family == "slides")
# Refused pairs by rule, the first rule that claims a pair wins.
REFUSALS = (
    ("text_to_sheet", TEXT, SHEET),
    ("text_to_slides", tuple(f for f in TEXT if f not in ("md", "txt")), SLIDES),
    ("slides_to_pdf", SLIDES, ("pdf",)),
    ("slides_to_sheet", SLIDES, SHEET),
    ("sheet_to_slides", SHEET, SLIDES),
    ("slides_to_slides", SLIDES, SLIDES),
)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A relation as SQL text that any engine reads."""
    text = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)})"


def relations() -> str:
    """formats, edges, caveats and refusals as common table expressions."""
    order = {f: i for i, (f, _) in enumerate(FORMATS)}
    pairs: dict[tuple[str, str], str] = {}
    for rule, sources, targets in REFUSALS:
        for s in sources:
            for t in targets:
                if s != t:
                    pairs.setdefault((s, t), rule)
    return ", ".join([
        values("formats", "f, ord, family, hub", [(f, order[f], family, int(f in HUBS)) for f, family in FORMATS]),
        values("edges", "src, dst, rank, peak, growth", [(a, b, FIDELITY.index(c), p, g) for a, b, c, p, g in EDGES]),
        values("caveats", "src, dst, code", list(CAVEATS)),
        values("refused", "src, dst, rule", [(a, b, rule) for (a, b), rule in pairs.items()]),
    ])
