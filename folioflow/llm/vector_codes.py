"""Vectors compressed as codes: equal parts of each vector are named by the nearest entry of a codebook of that part (dual-tree Lloyd).

Components become integers floor(scale * x). The entries of a part's codebook start as that part of the vectors with the smallest ids; each round
assigns all parts to their nearest entries and replaces each entry by the floored mean of its parts. A round is one pass over the table:
a task builds, block by block, a tree over the parts of its vectors and meets it with a tree over the entries. Pairs of nodes whose least
distance is beyond the best bound of the part node are pruned; a part node with one entry left is assigned as a whole from its
cached sum and count; what is uncertain at the leaves is settled by integer distances. Counts and sums by entry, a bounded number, go on.

Cases: vectors that are null, hold null or non-finite components, are empty, cannot be cut into that many equal parts or have another length than
the one with the smallest id take no part; null ids do (last in order); ties of distance go to the lower index; vectors of equal id are ordered
by their components; fewer vectors than entries give fewer entries; an empty table gives no rows; components beyond 2^26 in size are an
OverflowError, as their squared distances would not fit; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a block, and parts in a leaf of the tree over them.
BLOCK, LEAF = 16_384, 8
#: Labels that are broadcast to add their sums, at most about 10 MB; beyond, those that hold a thousandth of all rows, at most a thousand.
BROADCAST_LABELS = 100_000


def finite(vector: Column) -> Column:
    """Whether a vector takes part, its length aside."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size(vector) > 0)


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, counts of them, one run behind another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Tree:
    """Points split at medians of their widest sides until no node holds more than `leaf`, a level of nodes at a time.

    A node is the points order[start:end]; its children are those at `left` and `left + 1` (0: none). Nodes of equal points are not split.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        start, end = np.zeros(1, dtype=np.int64), np.full(1, len(points))
        starts, ends, lows, highs, lefts, made = [], [], [], [], [], 1
        while len(start):
            place = _runs(start, end - start)
            own = points[self.order[place]]
            cuts = np.concatenate(([0], np.cumsum(end - start)[:-1]))
            low, high = np.minimum.reduceat(own, cuts), np.maximum.reduceat(own, cuts)
            widest = np.argmax(high - low, axis=1)
            split = (end - start > leaf) & ((high - low).max(axis=1) > 0)
            left = np.zeros(len(start), dtype=np.int64)
            left[split] = made + 2 * np.arange(split.sum())
            made += 2 * int(split.sum())
            for held, x in ((starts, start), (ends, end), (lows, low), (highs, high), (lefts, left)):
                held.append(x)
            node = np.repeat(np.arange(len(start)), end - start)
            on = split[node]
            node, place = node[on], place[on]
            values = own[on, widest[node]]
            self.order[place] = self.order[place[np.lexsort((values, node))]]
            start, end = start[split], end[split]
            mid = (start + end) // 2
            start, end = np.stack([start, mid], axis=1).ravel(), np.stack([mid, end], axis=1).ravel()
        self.start, self.end, self.left, self.low, self.high = (np.concatenate(x) for x in (starts, ends, lefts, lows, highs))
        sums = np.concatenate((np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points[self.order], axis=0)))
        self.sums, self.counts = sums[self.end] - sums[self.start], self.end - self.start


class Entries(Tree):
    """A codebook of one part as a tree with an entry in each leaf; equal entries share one, the first of them."""

    def __init__(self, entries: np.ndarray):
        super().__init__(entries, 1)
        self.entries = entries
        self.name = np.array([self.order[a:b].min() if not x else -1 for a, b, x in zip(self.start, self.end, self.left, strict=True)])


def assign(points: np.ndarray, book: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point, and counts and sums of the points by entry."""
    tree, k = Tree(points, LEAF), len(book.entries)
    nearest = np.empty(len(points), dtype=np.int64)
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, points.shape[1]), dtype=np.int64)
    mine, theirs = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # the pairs of nodes that are left, by node of points
    while len(mine):
        gap = np.maximum(0, np.maximum(tree.low[mine] - book.high[theirs], book.low[theirs] - tree.high[mine]))
        reach = np.maximum(tree.high[mine] - book.low[theirs], book.high[theirs] - tree.low[mine])
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        cuts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        kept = least <= np.repeat(np.minimum.reduceat(most, cuts), np.diff(np.append(cuts, len(mine))))
        mine, theirs = mine[kept], theirs[kept]
        cuts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        many, nodes = np.diff(np.append(cuts, len(mine))), mine[cuts]
        named = np.logical_and.reduceat(book.name[theirs] >= 0, cuts)
        sure = (many == 1) & named
        unsure = ~sure & named & (tree.left[nodes] == 0)
        # whole nodes, from cached sums
        whole, entry = nodes[sure], book.name[theirs[cuts[sure]]]
        nearest[tree.order[_runs(tree.start[whole], tree.counts[whole])]] = np.repeat(entry, tree.counts[whole])
        np.add.at(counts, entry, tree.counts[whole])
        np.add.at(sums, entry, tree.sums[whole])
        # integer distances of each point of the uncertain leaves to the entries left, ties to the lower index
        leaf, of = nodes[unsure], many[unsure]
        if len(leaf):
            rows = tree.order[_runs(tree.start[leaf], tree.counts[leaf])]
            wide = np.repeat(of, tree.counts[leaf])
            names = book.name[theirs[_runs(np.repeat(cuts[unsure], tree.counts[leaf]), wide)]]
            apart = np.repeat(points[rows], wide, axis=0) - book.entries[names]
            far = (apart * apart).sum(axis=1)
            first = np.cumsum(wide) - wide
            best = np.minimum.reduceat(np.where(far == np.repeat(np.minimum.reduceat(far, first), wide), names, k), first)
            nearest[rows] = best
            np.add.at(counts, best, 1)
            np.add.at(sums, best, points[rows])
        on = np.repeat(~sure & ~unsure, many)
        mine, theirs = mine[on], theirs[on]
        # both nodes are opened, where they can be; pairs stay together by node of points
        for links, first in ((book.left, False), (tree.left, True)):
            nodes = mine if first else theirs
            times = 1 + (links[nodes] > 0)
            second = np.zeros(times.sum(), dtype=np.int64)
            second[np.cumsum(times)[times == 2] - 1] = 1
            mine, theirs, opened = np.repeat(mine, times), np.repeat(theirs, times), np.repeat(times == 2, times)
            nodes = mine if first else theirs
            nodes[opened] = links[nodes[opened]] + second[opened]
        order = np.argsort(mine, kind="stable")
        mine, theirs = mine[order], theirs[order]
    return nearest, counts, sums


def _blocks(batches: Iterator[pa.RecordBatch], ints: str, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size with their vectors as (vectors, parts, components)."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            flat = batch.column(ints).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and max(-flat.min(), flat.max()) > 1 << 26:
                raise OverflowError("components beyond 2^26 cannot be compared in 64 bits")
            yield batch, flat.reshape(batch.num_rows, parts, -1)


def _sums(book, ints: str, parts: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = None
        for _, vectors in _blocks(batches, ints, parts):
            if trees is None:
                trees = [Entries(x) for x in book.value]
                counts, totals = np.zeros(book.value.shape[:2], dtype=np.int64), np.zeros(book.value.shape, dtype=np.int64)
            for p, tree in enumerate(trees):
                _, c, s = assign(np.ascontiguousarray(vectors[:, p]), tree)
                counts[p] += c
                totals[p] += s
        if trees is not None:
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e], pa.int64()), "sums": pa.array(totals[p, e].tolist(), pa.list_(pa.int64()))})

    return sums


def _codes(book, ints: str, parts: int, made: tuple[str, str]):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Entries(x) for x in book.value]
        for batch, vectors in _blocks(batches, ints, parts):
            near = np.stack([assign(np.ascontiguousarray(vectors[:, p]), tree)[0] for p, tree in enumerate(trees)], axis=1)
            apart = vectors - book.value[np.arange(parts)[None, :], near]
            new = {made[0]: pa.array(near.tolist(), pa.list_(pa.int32())), made[1]: pa.array((apart * apart).sum(axis=(1, 2)), pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return codes


class Codebooks:
    """values: (parts, entries, components)."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()


def prepared(vectors: DataFrame, key: str, vector: str, ints: str, parts: int, scale: int) -> tuple[DataFrame, list[list[int]], int]:
    """The rows that take part with `ints`, the integer vectors of the smallest keys in order (one, to begin with), and their length."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    kept = vectors.filter(finite(F.col(vector))).withColumn(ints, whole)
    first = kept.filter(F.size(ints) % parts == 0).orderBy(F.asc_nulls_last(key), ints).select(F.size(ints)).limit(1).collect()
    length = first[0][0] if first else 0
    return kept.filter(F.size(ints) == length), length


def fit(rows: DataFrame, key: str, ints: str, length: int, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks of rows with integer vectors of one length. What comes to the driver is a sum for each part and entry."""
    spark = rows.sparkSession
    seeds = rows.orderBy(F.asc_nulls_last(key), ints).select(ints).limit(entries).collect()
    values = np.array([x[0] for x in seeds], dtype=np.int64).reshape(len(seeds), parts, length // parts).transpose(1, 0, 2).copy()
    if np.abs(values).max(initial=0) > 1 << 26:
        raise OverflowError("components beyond 2^26 cannot be compared in 64 bits")
    width = length // parts
    for _ in range(rounds if len(seeds) else 0):
        book = spark.sparkContext.broadcast(values)
        partial = rows.select(ints).mapInArrow(_sums(book, ints, parts), "part int, entry int, n long, sums array<long>")
        total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
        values = values.copy()
        for x in total.collect():  # at most parts x entries rows
            values[x["part"], x["entry"]] = [x[f"s{i}"] // x["n"] for i in range(width)]
        book.unpersist()
    return Codebooks(values)


def encode(rows: DataFrame, ints: str, books: Codebooks, codes: str = "codes", error: str = "error") -> DataFrame:
    """Adds codes (an entry's index for each part) and error (squared distances summed over the parts)."""
    out = rows.withColumns({codes: F.lit(None).cast("array<int>"), error: F.lit(None).cast("long")})
    if not books.values.size:
        return out
    book = rows.sparkSession.sparkContext.broadcast(books.values)
    return out.mapInArrow(_codes(book, ints, len(books.values), (codes, error)), out.schema)


def with_label_sums(rows: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over rows of equal label, nulls together. Rows of labels that hold many of them are not brought together."""
    sums = rows.groupBy(F.col(label).alias("_label")).agg(F.sum(value).alias(name), F.count("*").alias("_n"))
    sums = Scratch(rows.sparkSession).park(sums)
    same = lambda right: rows[label].eqNullSafe(right["_label"])
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), same(sums)).drop("_label", "_n")
    most = sums.agg(F.sum("_n")).first()[0] / 1000
    hot, rest = sums.filter(F.col("_n") > most), sums.filter(F.col("_n") <= most)
    often = rows.join(F.broadcast(hot), same(hot))
    seldom = rows.join(F.broadcast(hot), same(hot), "left_anti")
    return often.unionByName(seldom.join(rest, seldom[label].eqNullSafe(rest["_label"]))).drop("_label", "_n")
