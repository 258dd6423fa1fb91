"""Runs of line hashes over several sessions."""

import uuid

import pytest
from pyspark.sql import functions as F

from folioflow.llm.line_dedup import LineRuns


@pytest.fixture
def lines(spark):
    keyed = spark.range(6000).select((F.col("id") % 700).alias("doc_id"), F.xxhash64(F.col("id") * F.col("id") % 977).alias("h1"))
    return keyed.withColumn("h2", F.xxhash64("h1"))


def found(runs):
    return sorted(map(tuple, runs.counts().collect()))


def forgotten(spark, runs):
    """As another session sees it: nothing in memory, no table in the catalog."""
    for run in runs._runs():
        for name in run:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return runs.folder


def part(lines, i, n):
    return lines.filter(F.col("doc_id") % n == i)


def test_sessions_of_batches_equal_one_batch(spark, lines, tmp_path):
    one = LineRuns(spark)
    one.add(lines)
    want = found(one)
    one.close()
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    for session in ((0, 1), (2, 3), (4, 5)):  # the second session compacts
        runs = LineRuns.open(spark, folder)
        for i in session:
            runs.add(part(lines, i, 6), f"batch {i}")
            runs.add(part(lines, i, 6), f"batch {i}")  # told again
        forgotten(spark, runs)
    runs = LineRuns.open(spark, folder)
    assert found(runs) == want and [len(x) for x in runs.levels] == [2, 1] and len(runs.batches) == 6
    # keys are in one run alone, and runs stay bucketed, so that joins with them need no shuffle of theirs
    keys = [spark.table(k).select("h1", "h2") for k, _ in runs._runs()]
    assert sum(k.count() for k in keys) == len(want)
    runs.close()
    assert LineRuns.open(spark, folder).levels == [[]]


@pytest.mark.parametrize("fails_at", [1, 2])
def test_a_failed_batch_leaves_the_runs_as_they_were(spark, lines, tmp_path, monkeypatch, fails_at):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    runs = LineRuns.open(spark, folder)
    for i in range(3):
        runs.add(part(lines, i, 4), str(i))
    before, commit, calls = found(runs), LineRuns._commit, []

    def fails(self):
        calls.append(1)
        if len(calls) == fails_at:  # the first is the batch's, the second that of the compaction
            raise OSError("lost")
        commit(self)

    monkeypatch.setattr(LineRuns, "_commit", fails)
    with pytest.raises(OSError, match="lost"):
        runs.add(part(lines, 3, 4), "3")
    monkeypatch.undo()
    forgotten(spark, runs)
    again = LineRuns.open(spark, folder)
    assert (found(again) == before) == (fails_at == 1) and len(again.batches) == 2 + fails_at
    again.add(part(lines, 3, 4), "3")
    whole = LineRuns(spark)
    whole.add(lines)
    assert found(again) == found(whole)
    named = {n for run in again._runs() for n in run}
    assert {p.name for p in tmp_path.glob("*/line_run_*")} == named
    again.close()
    whole.close()


def test_two_writers_do_not_overwrite_each_other(spark, lines, tmp_path):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    LineRuns.open(spark, folder).add(part(lines, 0, 3))
    first, second = LineRuns.open(spark, folder), LineRuns.open(spark, folder)
    first.add(part(lines, 1, 3))
    with pytest.raises(FileExistsError):
        second.add(part(lines, 2, 3))
