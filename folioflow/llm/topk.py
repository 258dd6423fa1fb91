"""Exact top-k inner products by MaxScore over impact postings, window by window.

Vectors are integer weights; a term is one component with one sign. A window is some thousand vectors with a posting list for each
term: the vectors that hold it, ascending, and their weights. A query scores upwards only through the terms that agree with its signs,
each by at most its bound, the query's weight times the largest one in the list. Sorted by bound, the lists whose bounds together stay
below the k-th best score so far are non-essential: a vector in those alone cannot enter. The essential lists are traversed and added
up; the others are probed, widest bound first, only for vectors that can still reach the k-th score, and last of all the terms of the
other sign, which can only lower a score. The k-th score is carried from window to window and from shard to shard. Vectors that tie
with it go on, so the answer is exact. The shards' answers are merged by a window function.

Rows are numbered once. Shards (up to `shard` vectors) and blocks of queries (up to `block`) are dealt to groups of bounded size, and
each pair of groups meets in one task, which holds just these; a stated query set meets all rows, and nothing is broadcast.

Cases: vectors that are null or hold a null or a non-finite component take no part, nor do rows with a null id; shorter ones read as
padded with zeros; empty ones score 0; a row is never its own candidate, but other rows of the same id are; repeated ids are queries and
candidates of their own; ties go to the smaller id; weights and scores beyond 64 bits become the nearest such number; an empty table
gives no rows; only the two named columns and those of the condition are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 256
WINDOW = 2048
INT64 = np.iinfo(np.int64)


def weights(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double; null if the vector takes no part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


class Postings:
    """Posting lists of one window of vectors: term 2 * i holds the positive weights of component i, term 2 * i + 1 the negative ones."""

    def __init__(self, w: np.ndarray):
        self.w, self.dim = w, w.shape[1]
        lists = [np.flatnonzero(on) for i in range(self.dim) for on in (w[:, i] > 0, w[:, i] < 0)]
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.vectors = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        self.weights = w[self.vectors, np.repeat(np.arange(2 * self.dim) // 2, np.diff(self.at))] if lists else np.zeros(0, w.dtype)
        self.most = np.array([abs(self.weights[a:b]).max(initial=0) for a, b in zip(self.at[:-1], self.at[1:], strict=True)], dtype=w.dtype)

    def traverse(self, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Every vector's score from these terms alone."""
        places = np.concatenate([np.arange(self.at[t], self.at[t + 1]) for t in terms]) if len(terms) else np.zeros(0, np.int64)
        gain = self.weights[places] * np.repeat(q[terms // 2], self.at[terms + 1] - self.at[terms])
        if gain.dtype == object:
            out = np.zeros(len(self.w), dtype=object)
            np.add.at(out, self.vectors[places], gain)
            return out
        return np.bincount(self.vectors[places], gain, minlength=len(self.w))

    def best(self, q: np.ndarray, own: int, k: int, floor: float | int | None) -> tuple[np.ndarray, np.ndarray]:
        """Vectors (their numbers here) and scores of all that reach `floor` (any, if it is None), but for `own`."""
        agree = 2 * np.arange(self.dim) + (q < 0)
        bounds = abs(q) * self.most[agree]
        order = np.argsort(bounds, kind="stable")
        agree, upto = agree[order], np.cumsum(bounds[order])
        # with a positive k-th score, the first lists whose bounds stay below it together are non-essential
        split = int(np.searchsorted(upto, floor, side="left")) if floor is not None and floor > 0 else 0
        score = self.traverse(agree[split:], q)
        rest = upto[split - 1] if split else 0
        alive = np.flatnonzero(score + rest >= floor) if floor is not None else np.arange(len(self.w))
        alive = alive[alive != own]
        score = score[alive]
        for n in range(split - 1, -1, -8):  # probes of eight lists at a time
            part = agree[max(0, n - 7) : n + 1] // 2
            score = score + np.maximum(self.w[np.ix_(alive, part)] * q[part], 0).sum(axis=1)
            on = score + (upto[n - 8] if n >= 8 else 0) >= floor
            alive, score = alive[on], score[on]
        score = score + np.minimum(self.w[alive] * q, 0).sum(axis=1)
        if score.dtype == object:
            score = np.array([min(max(s, INT64.min), INT64.max) for s in score.tolist()], dtype=object)
        on = score >= floor if floor is not None else np.ones(len(alive), dtype=bool)
        return alive[on], score[on]


def best_of_shard(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int, floors: dict | None = None, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, scores) of each query's k best of one shard, ties to the smaller id; `floors` carries each query's k best scores on."""
    floors = {} if floors is None else floors
    dim = max(q.shape[1], w.shape[1])
    q, w = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, w))
    biggest = float(abs(q).max(initial=0)) * float(abs(w).max(initial=0)) * max(dim, 1)
    kind = np.float64 if biggest < 2**52 else object  # whole numbers that a double holds exactly, or else Python's
    q, w = q.astype(kind), w.astype(kind)
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, kind))] * len(q)
    for at in range(0, len(w), window):
        lists, numbers = Postings(w[at : at + window]), rows[at : at + window]
        place = {int(r): i for i, r in enumerate(numbers)}
        for n, row in enumerate(q_rows.tolist()):
            top = floors.get(row, np.zeros(0, kind))
            vectors, score = lists.best(q[n], place.get(row, -1), k, top[-1] if len(top) == k else None)
            if len(vectors):
                known = np.concatenate((held[n][0], ids[at + vectors])), np.concatenate((held[n][1], score))
                first = np.lexsort((known[0], -known[1]))[:k]
                held[n] = known[0][first], known[1][first]
                floors[row] = -np.sort(-np.concatenate((top, score)))[:k]
    sizes = [len(x) for x, _ in held]
    join = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64)
    return np.repeat(q_rows, sizes), join([x for x, _ in held]), join([s for _, s in held])


def pack(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (row, id, w) packed into (rows, ids, w, dim, n), up to `limit` vectors each, where they lie: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        ints = lambda c: c.to_numpy(zero_copy_only=False).astype(np.int64)

        def out() -> pa.RecordBatch:
            numbers, ids, n, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            dim = int(n.max(initial=0))
            w = np.zeros((len(ids), dim), dtype=np.int64)
            w[np.arange(dim) < n[:, None]] = flat
            return pa.RecordBatch.from_pydict({"rows": [numbers.tobytes()], "ids": [ids.tobytes()], "w": [w.tobytes()], "dim": [dim], "n": [len(ids)]}, schema=pa.schema({"rows": pa.binary(), "ids": pa.binary(), "w": pa.binary(), "dim": pa.int32(), "n": pa.int32()}))

        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                lists = part.column("w")
                if count and count + part.num_rows > limit:
                    yield out()
                    held, count = [], 0
                held.append((ints(part.column("row")), ints(part.column("id")), np.diff(lists.offsets.to_numpy()), ints(lists.flatten())))
                count += part.num_rows
        if count:
            yield out()

    return rows.mapInArrow(run, "rows binary, ids binary, w binary, dim int, n int")


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard: int = 8192, block: int = 1024, span: int = 4) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for each row of `vectors` that is_query holds for.

    A task holds `span` shards and `span` blocks of queries at most, give or take what hashing deals unevenly.
    """
    scratch = Scratch(vectors.sparkSession)
    whole = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), weights(F.col(f"`{vector}`")).alias("w"), F.coalesce(is_query, F.lit(False)).alias("q"))
    numbered = scratch.park(whole.filter(F.col("w").isNotNull() & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    shards, blocks = scratch.park(pack(numbered.select("row", "id", "w"), shard)), scratch.park(pack(numbered.filter("q").select("row", "id", "w"), block))
    groups = lambda df: max(1, -(-df.count() // span))
    n_shards, n_blocks = groups(shards), groups(blocks)
    dealt = lambda df, n: F.pmod(F.xxhash64("rows"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("b", dealt(blocks, n_blocks)).withColumn("s", every(n_shards))
    right = shards.withColumn("s", dealt(shards, n_shards)).withColumn("b", every(n_blocks))
    ints = lambda x: np.frombuffer(x, dtype=np.int64)

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64),) * 3]
        for q in queries.itertuples():
            floors: dict = {}
            for c in candidates.itertuples():
                found.append(best_of_shard(ints(q.rows), ints(q.w).reshape(q.n, q.dim), ints(c.rows), ints(c.ids), ints(c.w).reshape(c.n, c.dim), k, floors))
        return pd.DataFrame(dict(zip(("row", "vec_id", "score"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(run, "row long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    named = numbered.filter("q").select("row", F.col("id").alias("query_id"))
    return ranked.join(named, "row").select("query_id", "rank", "vec_id", "score")
