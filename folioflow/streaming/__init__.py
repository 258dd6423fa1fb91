"""Incremental ingest of files, and states of jobs kept over a stream of commands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from folioflow.functions.cells import extension
from folioflow.operators.progress import ALLOWED, walked


def new_files(spark: SparkSession, folder: str, glob: str = "*", largest: int = 100 << 20) -> DataFrame:
    """A stream of files as they arrive: path, fmt, length, status and content; too large ones are refused, not failed.

    Spark's file stream never gives out empty files, so these have no row.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)
    status = F.when(F.col("length") > largest, "too_large").otherwise("ok")
    return files.select("path", extension(F.regexp_extract("path", r"([^/]*)\z", 1)).alias("fmt"), "length", status.alias("status"), "content")


def ingest(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived since the last call with this checkpoint, each row once, those refused apart from the others (by `status`).

    Ends when all that is there is written; a call after a failure goes on where the last one stopped.
    """
    return files.writeStream.format("parquet").partitionBy("status").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def transitions(commands: DataFrame, key: str, at: str, order: str, command: str, allowed: dict[tuple[str, str], str] = ALLOWED) -> DataFrame:
    """A stream of commands with was, now and status, as `operators.progress.checked` has them; the state of each job outlives restarts.

    Commands of one micro-batch are taken in the order of (at, order, command), those of later batches after them. Rows without key or at are left out. A task holds
    the commands of one job in one batch, so the source's bound of a batch (such as maxFilesPerTrigger) bounds it.
    """
    names = commands.columns

    def step(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([at, order, command], kind="stable")
        found = walked(rows[command].where(rows[command].notna(), None).tolist(), held.get[0] if held.exists else "", allowed)
        held.update((found[1][-1],))
        yield rows[names].assign(was=found[0], now=found[1], status=found[2])

    whole = StructType([*commands.schema, *(StructField(n, StringType()) for n in ("was", "now", "status"))])
    known = commands.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    return known.groupBy(key).applyInPandasWithState(step, whole, StructType([StructField("state", StringType())]), "append", GroupStateTimeout.NoTimeout)
