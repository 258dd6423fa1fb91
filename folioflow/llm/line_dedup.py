"""Line deduplication over levelled sorted runs of line hashes.

A batch holds one row for each line key: its 128-bit hash, in how many documents it was found and the largest doc_id of those. It is
merge-anti-joined with the runs, and a run of two parts comes of it: the keys that no run held, and updates, the batch's counts of
keys that were known. So each key is in one run alone, and what later batches say of it are updates; both parts are tables bucketed
and sorted by the hash, so that the joins need no shuffle. Once a level has `fan_out` runs they are compacted into one run of the
next level, so a key is rewritten only as often as there are levels. `LineRuns.open` goes on with the runs of an earlier session.

Dropping works the same at every size: keys found in enough documents are joined with the documents' lines, the matching places
gathered by document, and the texts filtered. Keys that hold more than a share of all such lines are few by that very bound; they are
broadcast, so that their lines are not gathered in one task. Rows are told apart by 128 bits of their key and text.

Cases: a null or empty text is one empty line; keys under `min_chars` code points are never dropped; a document is a doc_id, so rows
that repeat one count once, and all rows of the largest doc_id keep the line; all rows without a doc_id count as one document, which is
never the largest; a document may hold a key on several lines and counts once; very long texts are split in their own row; an empty
table gives no rows; columns named n_lines or n_dropped are replaced, others pass through whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, delete, entries, freed_shuffles, read_small, shared_dir, write_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.regexp_replace(line, EDGES, ""), UPPER, LOWER)


def keyed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """r1, r2, doc_id, pos, h1, h2: the lines of rows (r1, r2, doc_id, text) whose key is long enough."""
    lines = rows.select("r1", "r2", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keys = lines.filter(F.length("line") >= min_chars).withColumn("k", line_key(F.col("line"))).filter(F.length("k") >= min_chars)
    return keys.select("r1", "r2", "doc_id", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("2nd"), "k").alias("h2"))


class LineRuns:
    """The runs of one corpus, as bucketed tables below `folder`; a run is the names of its keys and its updates.

    What the runs are is written there too, a new file for each change, which takes effect when the file gets its name. So another session
    opens them and goes on, and one that fails halfway leaves the runs as they were. One writer at a time: of two, the second fails.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, fan_out: int = 4):
        self.spark, self.folder, self.fan_out = spark, folder or shared_dir(spark), fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]
        self.batches: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The runs that are kept in folder; tables of changes that never took effect are deleted. Without any it begins new ones."""
        versions = [int(n) for n in entries(spark, f"{folder}/state") if n.isdigit()]
        if not versions:
            return cls(spark, folder)
        state = json.loads(read_small(spark, f"{folder}/state/{max(versions)}"))
        runs = cls(spark, folder, state["buckets"], state["fan_out"])
        runs.levels, runs.batches, runs.version = [[tuple(run) for run in level] for level in state["levels"]], state["batches"], max(versions)
        known = {name for run in runs._runs() for name in run}
        for name in known:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, n_docs BIGINT, max_doc BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {runs.buckets} BUCKETS LOCATION '{folder}/{name}'")
        runs._forget(n for n in entries(spark, folder) if n.startswith("line_run_") and n not in known)
        return runs

    def _commit(self) -> None:
        state = {"buckets": self.buckets, "fan_out": self.fan_out, "levels": self.levels, "batches": self.batches}
        write_small(self.spark, f"{self.folder}/state/{self.version + 1}", json.dumps(state))
        self.version += 1

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        placed = counts.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        with freed_shuffles(self.spark):
            placed.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _forget(self, names: Iterable[str]) -> None:
        for name in set(names):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Deletes all runs and their folder."""
        self._forget(name for run in self._runs() for name in run)
        delete(self.spark, self.folder)
        self.levels, self.batches, self.version = [[]], [], 0

    def _runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def _without(self, counts: DataFrame, name: str) -> DataFrame:
        return counts.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")

    def new_keys(self, counts: DataFrame) -> DataFrame:
        """The rows of a batch's counts whose key no run holds: one merge anti-join after another."""
        for keys, _ in self._runs():
            counts = self._without(counts, keys)
        return counts

    def add(self, lines: DataFrame, batch_id: str | None = None) -> None:
        """Adds a batch (doc_id, h1, h2), whose documents no other batch has; one whose batch_id is there already changes nothing."""
        if batch_id is not None and batch_id in self.batches:
            return
        once = lines.select("h1", "h2", "doc_id").distinct()
        batch = self._write(once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")))
        keys = self._write(self.new_keys(self.spark.table(batch))) if self._runs() else batch
        self.levels[0].append((keys, self._write(self._without(self.spark.table(batch), keys))))
        self.batches += [batch_id] if batch_id is not None else []
        self._commit()
        self._forget({batch} - {keys})
        self._compact()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fan_out:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                keys, updates = zip(*level, strict=True)
                self.levels[i + 1].append((self._write(self._every(keys)), self._write(self._merged(updates))))
                self.levels[i] = []
                self._commit()
                self._forget(keys + updates)

    def _every(self, names: Sequence[str]) -> DataFrame:
        every = self.spark.table(names[0])
        for name in names[1:]:
            every = every.unionByName(self.spark.table(name))
        return every

    def _merged(self, names: Sequence[str]) -> DataFrame:
        return self._every(names).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def counts(self) -> DataFrame:
        """h1, h2, n_docs, max_doc over all batches: the keys with their updates."""
        keys, updates = zip(*self._runs(), strict=True)
        later = self._merged(updates).withColumnsRenamed({"n_docs": "n_later", "max_doc": "max_later"})
        total = F.col("n_docs") + F.coalesce("n_later", F.lit(0))
        return self._every(keys).join(later, ["h1", "h2"], "left").select("h1", "h2", total.alias("n_docs"), F.greatest("max_doc", "max_later").alias("max_doc"))


def places(lines: DataFrame, common: DataFrame, share: int = 500) -> DataFrame:
    """r1, r2 and gone (positions): the lines of common keys (h1, h2, n_docs, max_doc) outside the largest document."""
    total = common.agg(F.sum("n_docs")).first()[0] or 0
    heavy = common.filter(F.col("n_docs") * share > total)  # fewer than `share` keys
    rest = lines.join(F.broadcast(heavy), ["h1", "h2"], "left_anti").join(common.filter(F.col("n_docs") * share <= total), ["h1", "h2"])
    found = lines.join(F.broadcast(heavy), ["h1", "h2"]).unionByName(rest)
    return found.filter(~F.col("doc_id").eqNullSafe(F.col("max_doc"))).groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 5) -> DataFrame:
    """The documents without lines that at least min_docs documents hold, except in the largest key; adds n_lines and n_dropped.

    The lines go into the runs in `batches` batches by a hash of the key, as arriving data would; with five, the first four are
    compacted and the last meets the run of the second level.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    name = lambda c: F.col(f"`{c}`")
    doc_id, full = name(key).cast("long"), F.coalesce(name(text), F.lit(""))
    row = [F.xxhash64(F.lit(seed), doc_id, doc_id.isNull(), full).alias(seed) for seed in ("r1", "r2")]
    scratch = Scratch(docs.sparkSession)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    lines = scratch.park(keyed_lines(docs.select(*row, doc_id.alias("doc_id"), full.alias("text")), min_chars).withColumn("batch", batch), "batch")
    runs = LineRuns(docs.sparkSession)
    try:
        for i in range(batches):
            runs.add(lines.filter(F.col("batch") == i))
        common = scratch.park(runs.counts().filter(F.col("n_docs") >= min_docs))
    finally:
        runs.close()
    gone = scratch.park(places(lines.drop("batch"), common))
    scratch.keep(gone)
    # the input's columns travel as one struct, so that no name of theirs meets one of ours
    out = docs.select(*row, F.struct(*map(name, names)).alias("doc")).join(gone, ["r1", "r2"], "left")
    text_of = F.coalesce(F.col("doc").getField(text), F.lit(""))
    out = out.select("doc", F.split(text_of, "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.size("gone") == 0, text_of).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return out.select(*[kept.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in names], F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))
