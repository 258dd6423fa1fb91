"""Bytes of text files as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Byte order marks, in hexadecimal digits.
UTF8, LITTLE, BIG = "EFBBBF", "FFFE", "FEFF"


@F.pandas_udf(StringType())
def _utf16(content: pd.Series) -> pd.Series:
    """Bytes that begin with the mark of their order; what cannot be decoded is replaced, a null stays one."""
    return content.map(lambda b: None if b is None else bytes(b)[2:].decode("utf-16-le" if bytes(b)[:2] == b"\xff\xfe" else "utf-16-be", "replace"))


def decoded(content: Column) -> Column:
    """Text of bytes: a mark of UTF-8 or UTF-16 is honoured and left out, without one it is UTF-8; bad bytes become U+FFFD.

    UTF-8 stays with built-in functions; only bytes marked as UTF-16 are handed to Python, others go there as null.
    """
    head = F.hex(F.substring(content, 1, 3))
    wide = head.startswith(LITTLE) | head.startswith(BIG)
    bare = F.when(head == UTF8, F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    return F.coalesce(_utf16(F.when(wide, content)), F.make_valid_utf8(bare.cast("string")))
