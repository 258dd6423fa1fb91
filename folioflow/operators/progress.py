"""Logs of jobs: which progress messages are passed on, and which changes of state are allowed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Later than any time.
NEVER = 1 << 62
# What a job does in a state, and the state that this leads to. What is not listed is refused and changes nothing.
ALLOWED = {
    ("", "add"): "queued", ("queued", "retarget"): "queued", ("queued", "start"): "converting", ("converting", "progress"): "converting",
    ("converting", "finish"): "done", ("converting", "fail"): "failed",
}


def _exits(interval: int) -> Callable[[pa.Table], pa.Table]:
    """For a chunk of one key: where the last message kept lies, by how early the first one may be kept."""

    def fold(chunk: pa.Table) -> pa.Table:
        at, forced = chunk["_at"].to_numpy(), chunk["_forced"].to_numpy()
        fixed = np.unique(at[forced])
        at = np.unique(at)
        after = np.searchsorted(at, at + interval)
        starts = np.append(np.searchsorted(at, fixed), len(at))
        after = np.minimum(after, starts[np.searchsorted(starts, np.arange(len(at)), side="right")])
        last = np.where(after < len(at), after, np.arange(len(at)))
        while (last[last] != last).any():  # twice as far each time
            last = last[last]
        bound = at[0] // interval * interval + interval  # a message kept before the chunk allows the next by then
        cut = min(int(np.searchsorted(at, bound)), int(starts[0]))
        upto, exits = at[: cut + 1].copy(), at[last[: cut + 1]]
        if cut < len(at):
            upto[-1] = NEVER
        keep = np.append(exits[1:] != exits[:-1], True)
        return pa.table([chunk[0][:1], chunk[1][:1], pa.array([upto[keep].tolist()]), pa.array([exits[keep].tolist()])], names=[*chunk.column_names[:2], "upto", "exits"])

    return fold


def _chained(interval: int) -> Callable[[pa.Table], pa.Table]:
    """For chunks of one key in order: the last message kept before each."""

    def fold(chunks: pa.Table) -> pa.Table:
        order = np.argsort(chunks["_chunk"].to_numpy())
        entered, last = np.empty(len(order), np.int64), None
        for i in order:
            known = chunks["_from"][int(i)].as_py()
            last = known if last is None else last
            entered[i] = last
            upto = chunks["upto"][int(i)].values.to_numpy()
            j = int(np.searchsorted(upto, last + interval))
            last = last if j == len(upto) else chunks["exits"][int(i)].values[j].as_py()
        return pa.table([chunks[0], chunks["_chunk"], pa.array(entered)], names=[chunks.column_names[0], "_chunk", "_entered"])

    return fold


def _passed(interval: int, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def fold(chunk: pa.Table) -> pa.Table:
        at, forced = chunk["_at"].to_numpy(), chunk["_forced"].to_numpy()
        times, fixed = np.unique(at), np.append(np.unique(at[forced]), NEVER)
        kept, last = [], int(chunk["_entered"][0].as_py())
        while True:  # the next kept time is a forced one or the first that is late enough
            i = int(np.searchsorted(times, last + interval))
            free, must = int(times[i]) if i < len(times) else NEVER, int(fixed[np.searchsorted(fixed, last, side="right")])
            if min(free, must) == NEVER:
                break
            last = min(free, must)
            if free == last:
                kept.append(last)
        return chunk.select(names).filter(pa.array(forced | (chunk["_first"].to_numpy() & np.isin(at, kept))))

    return fold


def throttled(events: DataFrame, key: str, at: str, order: str, shape: str, interval: int, span: int = 600) -> DataFrame:
    """The rows of events that are passed on: a key's first, each whose shape differs from that of the row before, and each at least `interval` after the last one passed on.

    at: a whole number, such as milliseconds; rows of one time come by order and shape. Rows without key or at are left out; other columns pass through.
    What is kept depends on what was kept before, so a key's rows are cut into chunks of `span` intervals: each chunk says where it would end for every
    way to enter it, chunks are chained between those that end alike however they are entered, and then each is read again. A key of any length is as many
    tasks as it has chunks; one task holds the rows of a chunk, or one row for each chunk of a chain.
    """
    names, length = events.columns, interval * span
    some = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("long"))
    cut = some.withColumn("_chunk", F.expr(f"(_at - pmod(_at, {length}L)) div {length}L"))
    spot = F.struct(F.col("_at").alias("a"), F.col(order).alias("o"), F.col(shape).alias("s"))
    ends = cut.groupBy(key, "_chunk").agg(F.max(spot).alias("_end"))
    before = ends.select(key, "_chunk", F.lag("_end").over(Window.partitionBy(key).orderBy("_chunk")).alias("_before"))
    w = Window.partitionBy(key, "_chunk").orderBy("_at", order, shape)
    met = cut.join(before, [key, "_chunk"]).withColumn("_prev", F.coalesce(F.lag(spot).over(w), F.col("_before")))
    forced = F.col("_prev").isNull() | ~F.col("_prev.s").eqNullSafe(F.col(shape)) | (F.col("_at") - F.col("_prev.a") >= interval)
    marked = met.withColumns({"_forced": F.coalesce(forced, F.lit(True)), "_first": ~F.lag("_at").over(w).eqNullSafe(F.col("_at"))}).drop("_prev", "_before")
    kind, chunk = marked.schema[key], StructField("_chunk", LongType())
    longs = StructType.fromDDL("upto array<bigint>, exits array<bigint>")
    exits = marked.select(key, "_chunk", "_at", "_forced").groupBy(key, "_chunk").applyInArrow(_exits(interval), StructType([kind, chunk, *longs]))
    alike = (F.size("upto") == 1) & (F.get("upto", F.lit(0)) == NEVER)
    along = Window.partitionBy(key).orderBy("_chunk")
    begun = F.coalesce(F.lag(alike).over(along), F.lit(True))
    chains = exits.withColumns({"_begun": begun, "_from": F.coalesce(F.lag(F.get("exits", F.lit(0))).over(along), F.lit(-NEVER))})
    chains = chains.withColumn("_chain", F.sum(F.when(F.col("_begun"), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    entered = chains.select(key, "_chunk", "_chain", "_from", "upto", "exits").groupBy(key, "_chain").applyInArrow(_chained(interval), StructType([kind, chunk, StructField("_entered", LongType())]))
    return marked.join(entered, [key, "_chunk"]).groupBy(key, "_chunk").applyInArrow(_passed(interval, names), events.schema)


def walked(commands: list[str | None], state: str, allowed: dict[tuple[str, str], str]) -> tuple[list[str], list[str], list[str]]:
    """The state before and after each command, and whether it was ok or refused."""
    was, now, status = [], [], []
    for command in commands:
        to = allowed.get((state, command))
        was.append(state)
        status.append("refused" if to is None else "ok")
        state = state if to is None else to
        now.append(state)
    return was, now, status


def checked(events: DataFrame, key: str, at: str, order: str, command: str, allowed: dict[tuple[str, str], str] = ALLOWED, span: int = 86_400_000) -> DataFrame:
    """events with was, now and status (ok or refused): the state of a job (key) before and after each command, in the order of (at, order, command).

    '' is the state of a job that is not there yet. A command that its state does not allow, such as null, is refused and changes nothing. Rows without key or at are left out.
    A job's log is cut into runs of `span` of `at`. A run maps each state to another; these maps are applied one after the other, and each run is read
    again from the state that it begins in. So a job of any length is as many tasks as it has runs; one task holds the rows of a run, or one row for each run of a job.
    """
    states = sorted({""} | {s for s, _ in allowed} | set(allowed.values()))
    names = events.columns
    order_by = [(c, "ascending") for c in ("_at", order, command)]
    cut = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("long")).withColumn("_run", F.expr(f"(_at - pmod(_at, {span}L)) div {span}L"))
    head = StructType([cut.schema[key], StructField("_run", LongType())])

    def ends(run: pa.Table) -> pa.Table:
        commands = run.sort_by(order_by)[command].to_pylist()
        return pa.table([run[0][:1], run[1][:1], pa.array([[walked(commands, s, allowed)[1][-1] for s in states]])], names=[key, "_run", "_ends"])

    def begins(runs: pa.Table) -> pa.Table:
        runs, state, found = runs.sort_by("_run"), "", []
        for to in runs["_ends"]:
            found.append(state)
            state = to[states.index(state)].as_py()
        return pa.table([runs[0], runs["_run"], pa.array(found)], names=[key, "_run", "_state"])

    def states_of(run: pa.Table) -> pa.Table:
        run = run.sort_by(order_by)
        columns = walked(run[command].to_pylist(), run["_state"][0].as_py(), allowed)
        return pa.table([*(run[c] for c in names), *map(pa.array, columns)], names=[*names, "was", "now", "status"])

    maps = cut.select(*dict.fromkeys((key, "_run", "_at", order, command))).groupBy(key, "_run").applyInArrow(ends, StructType([*head.fields, StructField("_ends", ArrayType(StringType()))]))
    starts = maps.groupBy(key).applyInArrow(begins, StructType([*head.fields, StructField("_state", StringType())]))
    whole = StructType([*events.schema, *(StructField(n, StringType()) for n in ("was", "now", "status"))])
    return cut.join(starts, [key, "_run"]).groupBy(key, "_run").applyInArrow(states_of, whole)
