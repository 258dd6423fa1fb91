"""Progress messages and states of jobs, against plain loops, and over restarts of a stream."""

import random

import pytest


def sequential(rows, interval):
    last, shape, kept = {}, {}, []
    for key, at, order, s in sorted(rows):
        if key not in last or shape[key] != s or at - last[key] >= interval:
            last[key] = at
            kept.append((key, at, order, s))
        shape[key] = s
    return kept


@pytest.mark.parametrize("span", [1, 2, 7, 600])
@pytest.mark.parametrize("density", [1, 8, 60, 400])
def test_throttle_equals_a_loop(spark, span, density):
    from folioflow.operators.progress import throttled

    rng = random.Random(density * 1000 + span)
    rows = [(rng.choice("aab"), rng.randrange(-2000, 2000 * 100 // density), i, rng.choice(["x"] * 40 + ["y"])) for i in range(600)]
    events = spark.createDataFrame([*rows, (None, 1, 1, "x"), ("a", None, 1, "x")], "k string, at long, id long, s string").selectExpr("*", "'e' AS extra")
    got = throttled(events, "k", "at", "id", "s", 100, span)
    assert got.columns == events.columns
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(sequential(rows, 100))


def test_throttle_of_one_dense_job_without_changes(spark):
    from folioflow.operators.progress import throttled

    events = spark.range(20_000).selectExpr("1 as k", "id * 7 as at", "id", "cast(null as string) as s")
    assert sorted(r.at for r in throttled(events, "k", "at", "id", "s", 100, 3).collect()) == [r[1] for r in sequential([(1, i * 7, i, "") for i in range(20_000)], 100)]
    assert throttled(events.filter("false"), "k", "at", "id", "s", 100).count() == 0


ROWS = [(1, 1, "add"), (1, 2, "progress"), (1, 3, "retarget"), (1, 4, "start"), (1, 5, "retarget"), (1, 6, "progress"), (1, 7, "finish"), (1, 8, "progress"), (1, 9, "fail"), (2, 1, "start"), (2, 2, None), (2, 3, "add"), (2, 4, "finish"), (2, 5, "start"), (2, 6, "fail"), (2, 9, "add")]
WANT = [
    ("", "queued", "ok"), ("queued", "queued", "refused"), ("queued", "queued", "ok"), ("queued", "converting", "ok"), ("converting", "converting", "refused"), ("converting", "converting", "ok"), ("converting", "done", "ok"), ("done", "done", "refused"), ("done", "done", "refused"),
    ("", "", "refused"), ("", "", "refused"), ("", "queued", "ok"), ("queued", "queued", "refused"), ("queued", "converting", "ok"), ("converting", "failed", "ok"), ("failed", "failed", "refused"),
]


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_states_are_checked(spark, span):
    from folioflow.operators.progress import checked

    events = spark.createDataFrame([(k, a, a, c) for k, a, c in ROWS] + [(None, 1, 1, "add")], "job long, at long, id long, command string")
    got = checked(events, "job", "at", "id", "command", span=span).orderBy("job", "at").collect()
    assert [(r.was, r.now, r.status) for r in got] == WANT and [r.command for r in got] == [c for *_, c in ROWS]


def test_states_outlive_restarts_of_a_stream(spark, tmp_path):
    from folioflow.operators.progress import checked
    from folioflow.streaming import ingest, transitions

    rng, ddl = random.Random(5), "job long, at long, id long, command string"
    rows = [(rng.randrange(5), i, i, rng.choice(["add", "start", "progress", "finish", "fail", "retarget", None])) for i in range(300)]
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        ingest(transitions(stream, "job", "at", "id", "command"), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    columns = ["job", "at", "id", "command", "was", "now", "status"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns).collect()
    want = checked(spark.createDataFrame(rows, ddl), "job", "at", "id", "command", span=50).select(columns).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and {r.status for r in got} == {"ok", "refused"} and len(got) == 300
