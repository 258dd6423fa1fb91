"""Documents read one by one into rows: what the readers share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and characters of input after which a batch is given out.
ROWS, CHARACTERS = 10_000, 1 << 20


def read_each(docs: DataFrame, key: str, inputs: list[str], make: Callable[..., Iterable[tuple]], fields: str) -> DataFrame:
    """key and `fields` (DDL): the rows that make(*inputs) gives for each document, gathered into batches of about a megabyte."""
    added = StructType.fromDDL(fields)
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0

            def out() -> pa.RecordBatch:
                columns = zip(*rows) if rows else [[] for _ in types]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[key, *added.names])

            for i in range(batch.num_rows):
                values = [column[i].as_py() for column in batch.columns[1:]]
                held += len(values[0] or "")
                for row in make(*values):
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield out()
                        at, rows, held = [], [], 0
                if held >= CHARACTERS:
                    yield out()
                    at, rows, held = [], [], 0
            if rows:
                yield out()

    read = docs.select(F.col(key), *[F.col(c).alias(f"_{i}") for i, c in enumerate(inputs)])
    return read.mapInArrow(run, StructType([read.schema[0], *added]))
