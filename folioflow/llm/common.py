"""What the operators of this subpackage share: tables, the shared folder, bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a Python task holds at a time.
SLICE_BYTES = 6 << 20
#: Shuffle files of a query go when it ends; a stage that still asks for them is run again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that spark.checkpoint.dir names. Only a local session may do without: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is executed inside gives back its shuffle files once it has ended: for writes, whose results need them no longer."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def _at(spark: SparkSession, path: str) -> tuple:
    """A path and the store that Spark keeps it in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own in whatever store Spark keeps it."""
    at, store = _at(spark, path)
    store.delete(at, True)


def entries(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    at, store = _at(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that appears whole or not at all, and fails if there is one of that name."""
    at, store = _at(spark, path)
    made, _ = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(made)
    out.write(text.encode())
    out.close()
    if store.exists(at) or not store.rename(made, at):
        store.delete(made, False)
        raise FileExistsError(path)


def read_small(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


class Scratch:
    """The written tables of one job, below one folder of its own, each deleted once no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, shared_dir(spark), {}

    def park(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Writes df and reads it back: lineage ends there, and lost executors cost no recomputation."""
        path = f"{self.folder}/{len(self.paths)}"
        with freed_shuffles(self.spark):
            df.write.partitionBy(*partition_by).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = back
        return back

    def drop(self, *parked: DataFrame) -> None:
        """Deletes tables that `park` returned."""
        for path in [p for p, df in self.paths.items() if any(df is x for x in parked)]:
            self.paths[path] = None
            delete(self.spark, path)

    def keep(self, *parked: DataFrame) -> None:
        """Deletes all tables but these."""
        self.drop(*[df for df in self.paths.values() if df is not None and not any(df is x for x in parked)])


def park(df: DataFrame) -> DataFrame:
    """A written table that stays as long as the shared folder does."""
    return Scratch(df.sparkSession).park(df)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: the remainder of crc32(doc_id as text) by 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows (all, if there are fewer) chosen by a hash of all their columns, so that every row has the same chance.

    Pass a key such as doc_id along: copies of one text are then chosen one by one, and a large group of them neither fills the
    sample beyond its bound nor is missing from it.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit("sample")), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `limit` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column without nulls: null reads as empty."""
    return pc.fill_null(batch.column(text), "")
