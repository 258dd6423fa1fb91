"""What a document is, from its name, first bytes and archive, and what went wrong with one, as codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.plans.catalog import ALIASES, FORMATS

#: Formats without a signature: their name is all there is to go by.
TEXTUAL = ("md", "txt", "csv", "html", "json")
# First bytes, in hexadecimal digits, and what they stand for.
ARCHIVE, PDF, RTF, OLD_OFFICE = "504B0304", "25504446", "7B5C727466", "D0CF11E0A1B11AE1"
# What MIME types of OpenDocument files and their templates begin with.
ODF = (("application/vnd.oasis.opendocument.text", "odt"), ("application/vnd.oasis.opendocument.spreadsheet", "ods"), ("application/vnd.oasis.opendocument.presentation", "odp"))
# Parts of error messages, in this order, with the code of the failure.
FAILURES = (("password", ("password", "encrypted")), ("damaged", ("end of central directory", "corrupted zip", "invalid signature")), ("not_pdf", ("invalid pdf", "missing pdf header")))


def detected(claimed: Column, content: Column) -> Column:
    """A struct of format, mismatch and reason: archives are settled later, empty files keep what their name claims."""
    head = F.coalesce(F.hex(F.substring(content, 1, 8)), F.lit(""))
    starts = lambda x: head.startswith(x)
    textual = F.coalesce(claimed.isin(*TEXTUAL), F.lit(False))
    none = F.lit(None).cast("string")
    fmt = F.when(head == "", claimed).when(starts(ARCHIVE), none).when(starts(PDF), "pdf").when(starts(RTF), "rtf").when(starts(OLD_OFFICE), none).when(textual, claimed)
    reason = F.when((head == "") | starts(PDF) | starts(RTF), "").when(starts(ARCHIVE), "archive").when(starts(OLD_OFFICE), "old_office").when(textual, "").when(claimed.isNotNull(), "other_bytes").otherwise("unknown")
    return F.struct(fmt.alias("format"), F.coalesce(fmt != claimed, F.lit(False)).alias("mismatch"), reason.alias("reason"))


def settled(claimed: Column, inside: Column) -> Column:
    """The same for an archive, once it is known what is inside (null: no document)."""
    return F.struct(inside.alias("format"), F.coalesce(inside != claimed, F.lit(False)).alias("mismatch"), F.when(inside.isNull(), "not_a_document").otherwise("").alias("reason"))


def odf_kind(mimetype: Column) -> Column:
    """odt, ods or odp; null for other types."""
    kind, name = F.lit(None).cast("string"), F.trim(mimetype)
    for start, fmt in reversed(ODF):
        kind = F.when(name.startswith(start), fmt).otherwise(kind)
    return kind


def failure(message: Column) -> Column:
    """The code of an error message; `unreadable` if it says nothing that is known."""
    code, text = F.lit("unreadable"), F.lower(message)
    for name, parts in reversed(FAILURES):
        found = F.lit(False)
        for part in parts:
            found = found | text.contains(part)
        code = F.when(F.coalesce(found, F.lit(False)), name).otherwise(code)
    return code


def accepted() -> list[str]:
    """All extensions that stand for a format, with their dots, formats first."""
    return [f".{name}" for name in (*(f for f, _ in FORMATS), *(a for a, _ in ALIASES))]


def listed(names: Column) -> Column:
    """Names for a sentence: sorted, `and` before the last, semicolons if a name holds a comma."""
    ordered = F.array_sort(names)
    n = F.size(ordered)
    comma = F.exists(ordered, lambda x: x.contains(","))
    rest = F.slice(ordered, F.lit(1), F.greatest(n - 1, F.lit(0)))
    last = F.element_at(ordered, -1)
    return F.when(n <= 1, F.array_join(ordered, "")).when(comma, F.concat(F.array_join(rest, "; "), F.lit("; and "), last)).otherwise(F.concat(F.array_join(rest, ", "), F.lit(" and "), last))


def delimiter_name(delimiter: Column) -> Column:
    return F.when(delimiter == ";", "semicolon").when(delimiter == "\t", "tab").when(delimiter == "|", "pipe").otherwise("comma")
