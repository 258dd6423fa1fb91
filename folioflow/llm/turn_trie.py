"""Prefix trie of conversations: which of them begin with the same turns, and what sharing those turns would save.

Turns are encoded as digests of 16 bytes, conversations as their digests one behind another, so that the order of the bytes is the order
of the sequences. Rows are dealt by ranges of (sequence, conv_id); a task cuts its range into shards of a bounded number of turns. A shard
encodes its digests as numbers of a dictionary and builds a ternary search tree over its distinct sequences, the median first, so that
siblings are balanced; one iterative traversal adds up members, leaves and savings.

Nodes on the paths of a shard's first and last sequence may go on in its neighbours: their parts are added up by node key, with
corrections for what two neighbours have both counted (the common path of the last sequence of one and the first of the next). All
other nodes are final where they are made.

Cases: rows with a null conv_id take no part; a null role or text is empty; turns of equal number (or none) are ordered by their digest,
and rows that are equal are turns of their own; an empty table gives no rows, not even the root; other columns are not read. A conversation is one
row of 16 bytes and a size for each turn; texts of any length are only digested and measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of a turn's digest, and turns that one tree holds.
WIDTH, SHARD_TURNS = 16, 200_000
#: Boundary nodes that are broadcast to find parents: at most about 60 MB; more are joined, each in so many copies.
BROADCAST_ROWS, SALT = 500_000, 16
ROOT = bytes(WIDTH)
COMPLETE, PART, EDGE, PIECE = range(4)
SCHEMA = "kind int, key binary, parent_key binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, pid int, first_ids binary, last_ids binary, sizes array<int>"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
ARROW = pa.schema([(n, {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[part.split()[1]]) for n, part in zip(NAMES, SCHEMA.split(", "), strict=True)])
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids (digests of the turns in order) and sizes (UTF-8 bytes of their texts) of turns (conv_id, turn, role, text)."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.md5(F.coalesce("role", F.lit("")).cast("binary")), F.lit(":"), text).cast("binary"))
    read = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), digest.alias("id"), F.octet_length(text).alias("size")).alias("x"))
    listed = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("x", lambda x: x["id"]), "")).alias("ids"), F.transform("x", lambda x: x["size"]).alias("sizes"))


def with_heads(convs: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """conv_id, ids and sizes: each conversation with its first `head` turns (at most `most`) exchanged for those of conversation `base`."""
    heads = convs.select(F.col("conv_id").alias("base"), F.substring("ids", 1, WIDTH * most).alias("head_ids"), F.slice("sizes", 1, most).alias("head_sizes"))
    joined = convs.withColumns({"base": base, "head": head}).join(heads, "base", "left")
    none, n = F.array().cast("array<int>"), F.size("sizes")
    ids = F.concat(F.substring(F.coalesce("head_ids", F.lit(b"")), F.lit(1), F.col("head") * WIDTH), F.substring(F.col("ids"), F.col("head") * WIDTH + 1, n * WIDTH))
    sizes = F.concat(F.slice(F.coalesce("head_sizes", none), F.lit(1), F.col("head")), F.slice(F.col("sizes"), F.col("head") + 1, F.greatest(n - F.col("head"), F.lit(0))))
    return joined.select("conv_id", ids.alias("ids"), sizes.alias("sizes"))


class TernaryTree:
    """Prefixes of sequences of numbers. Node 0 is the empty prefix, so 0 as a link is none; `eq` leads to the tree of a node's children."""

    def __init__(self):
        self.turn, self.lo, self.eq, self.hi, self.parent, self.depth, self.size, self.end = [-1], [0], [0], [0], [-1], [0], [0], [-1]

    def _new(self, turn: int, parent: int, size: int) -> int:
        for held, x in ((self.turn, turn), (self.lo, 0), (self.eq, 0), (self.hi, 0), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.size, size), (self.end, -1)):
            held.append(x)
        return len(self.turn) - 1

    def insert(self, turns: list[int], sizes: list[int], number: int) -> None:
        turn, lo, eq, hi, at = self.turn, self.lo, self.eq, self.hi, 0
        for t, size in zip(turns, sizes, strict=True):
            node, links = eq[at], eq
            link = at
            while node and turn[node] != t:
                links, link = (lo, node) if t < turn[node] else (hi, node)
                node = links[link]
            if not node:
                node = links[link] = self._new(t, at, size)
            at = node
        self.end[at] = number

    def order(self) -> list[int]:
        """All nodes, each before those below it, siblings by their numbers."""
        out, stack = [], [~0]
        while stack:
            x = stack.pop()
            if x >= 0:
                stack += [y for y in (self.hi[x], ~x, self.lo[x]) if y]
                continue
            out.append(~x)
            if self.eq[~x]:
                stack.append(self.eq[~x])
        return out


def build(coded: list[list[int]], sizes: list[list[int]]) -> TernaryTree:
    """The tree of sorted distinct sequences, medians first."""
    tree, spans = TernaryTree(), [(0, len(coded))]
    while spans:
        low, high = spans.pop()
        if low < high:
            mid = (low + high) // 2
            tree.insert(coded[mid], sizes[mid], mid)
            spans += [(mid + 1, high), (low, mid)]
    return tree


def _digests(ids: bytes) -> list[bytes]:
    return [ids[i : i + WIDTH] for i in range(0, len(ids), WIDTH)]


def _key(parent: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(parent + digest, digest_size=WIDTH).digest()


class Rows:
    """Rows of SCHEMA, given out as batches."""

    def __init__(self):
        self.rows = []

    def add(self, kind: int, **columns) -> None:
        self.rows.append(columns | {"kind": kind})

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            for i in range(0, len(self.rows), 10_000):
                yield pa.RecordBatch.from_pylist(self.rows[i : i + 10_000], schema=ARROW)
            self.rows = []


def corrections(last: bytes, first: bytes, sizes: list[int], rows: Rows) -> None:
    """Takes back what two neighbouring shards have both counted, `last` and `first` being the sequences that meet."""
    a, b = _digests(last), _digests(first)
    common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    keys = [ROOT]
    for digest in b[:common]:
        keys.append(_key(keys[-1], digest))
    twice, leaf = 0, -1 if common == len(a) else 0  # a leaf of the one shard that goes on, or is met again, in the next
    for depth in range(common, -1, -1):
        twice += sizes[depth - 1] if depth else 0
        rows.add(PART, key=keys[depth], parent_key=keys[depth - 1] if depth else None, depth=depth, n_convs=0, n_children=-1 if depth < common else 0, n_leaves=leaf, saved_tokens=twice)


def _grow(runs: list[tuple[bytes, list[int], list[int]]], rows: Rows) -> None:
    """Rows of one shard's nodes. runs: distinct sequences in order with their sizes and their conversations in order."""
    parts = [_digests(ids) for ids, _, _ in runs]
    words, codes = np.unique(np.array([d for x in parts for d in x], dtype=f"S{WIDTH}"), return_inverse=True)
    flat, at, coded = codes.tolist(), 0, []
    for x in parts:
        coded.append(flat[at : at + len(x)])
        at += len(x)
    tree = build(coded, [sizes for _, sizes, _ in runs])
    n, order = len(tree.turn), tree.order()
    members, least, leaves, children, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    on_edge = [False] * n
    for x in order:
        if tree.end[x] >= 0:
            convs = runs[tree.end[x]][2]
            members[x], least[x] = len(convs), convs[0]
            if tree.end[x] in (0, len(runs) - 1):
                y = x
                while y >= 0 and not on_edge[y]:
                    on_edge[y], y = True, tree.parent[y]
    for x in reversed(order):
        leaves[x] = leaves[x] if tree.eq[x] else 1
        saved[x] += (members[x] - 1) * tree.size[x]
        p = tree.parent[x]
        if p >= 0:
            members[p] += members[x]
            leaves[p] += leaves[x]
            saved[p] += saved[x]
            children[p] += 1
            least[p] = least[x] if least[p] is None else min(least[p], least[x])
    keys = {0: ROOT}
    for x in order:
        p = tree.parent[x]
        columns = {"conv_id": least[x], "depth": tree.depth[x], "n_convs": members[x], "n_children": children[x], "n_leaves": leaves[x], "saved_tokens": saved[x]}
        ends = ",".join(map(str, runs[tree.end[x]][2])) if tree.end[x] >= 0 else None
        if on_edge[x]:
            if x:
                keys[x] = _key(keys[p], bytes(words[tree.turn[x]]).ljust(WIDTH, b"\0"))
            rows.add(PART, key=keys[x], parent_key=keys[p] if x else None, **columns)
            if ends is not None:
                rows.add(PIECE, key=keys[x], conv_id=runs[tree.end[x]][2][0], ends=ends)
        else:
            said = {"parent_key": keys[p]} if on_edge[p] else {"parent_conv_id": least[p]}
            rows.add(COMPLETE, ends=EMPTY_SHA if ends is None else hashlib.sha256(ends.encode()).hexdigest(), **said, **columns)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[bytes, list[int], list[int]]]]:
    """Runs of equal sequences, as many as hold about `most` turns; a run that is long goes on in the next shard."""
    runs, held = [], 0
    for batch in batches:
        for conv, ids, sizes in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "ids", "sizes")], strict=True):
            if held >= most:
                yield runs
                runs, held = [], 0
            if runs and runs[-1][0] == ids:
                runs[-1][2].append(conv)
                held += 1
            else:
                runs.append((ids, sizes, [conv]))
                held += 1 + len(sizes)
    if runs:
        yield runs


def _nodes(most: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, first, last = Rows(), None, None
        for runs in _shards(batches, most):
            if last is not None:
                corrections(last, runs[0][0], runs[0][1], rows)
            first, last = first or runs[0], runs[-1][0]
            _grow(runs, rows)
            yield from rows.batches(5_000)
        if first is not None:
            rows.add(EDGE, pid=TaskContext.get().partitionId(), first_ids=first[0], sizes=first[1], last_ids=last)
        yield from rows.batches()

    return nodes


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows()
    for batch in batches:
        for last, first, sizes in zip(*[batch.column(c).to_pylist() for c in ("last_ids", "first_ids", "sizes")], strict=True):
            corrections(last, first, sizes, rows)
    yield from rows.batches()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of each key's pieces, which come in order: no more than a piece is held."""
    key, digest = None, None
    for batch in batches:
        keys, out = batch.column("key").to_pylist(), []
        for k, ends in zip(keys, batch.column("ends").to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + ends.encode())
                continue
            if key is not None:
                out.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(ends.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in out], pa.binary()), "ends": pa.array([e for _, e in out], pa.string())})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [digest.hexdigest()]})


def nodes(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each distinct prefix of convs (conv_id, ids, sizes)."""
    scratch = Scratch(convs.sparkSession)
    parked = scratch.park(convs)
    # hot sequences are dealt over several ranges, as their conversations differ
    n = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parked.repartitionByRange(n, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    parts = scratch.park(dealt.mapInArrow(_nodes(shard_turns), SCHEMA))
    of = lambda kind: parts.filter(F.col("kind") == kind)

    edges = of(EDGE).select("pid", "first_ids", "last_ids", "sizes")
    nexts = edges.select("pid", F.lead("pid").over(Window.orderBy("pid")).alias("next"))  # a row for each range
    meet = edges.select("pid", "last_ids").join(nexts, "pid").join(edges.select(F.col("pid").alias("next"), "first_ids", "sizes"), "next").select("last_ids", "first_ids", "sizes")
    sums = {"conv_id": F.min, "depth": F.max, "parent_key": F.max} | dict.fromkeys(("n_convs", "n_children", "n_leaves", "saved_tokens"), F.sum)
    merged = of(PART).unionByName(meet.mapInArrow(_meetings, SCHEMA)).groupBy("key").agg(*[f(c).alias(c) for c, f in sums.items()])
    ends = of(PIECE).select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, "key binary, ends string")
    shared = scratch.park(merged.join(ends, "key", "left"))

    names = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    below = of(COMPLETE).filter("parent_key IS NOT NULL").select("parent_key", *columns).unionByName(shared.select("parent_key", *columns))
    if shared.count() <= BROADCAST_ROWS:
        found = below.join(F.broadcast(names), "parent_key", "left")
    else:  # a node may have any number of children
        salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = below.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALT)).cast("int")).join(salted, ["parent_key", "salt"], "left")
    whole = of(COMPLETE).filter("parent_key IS NULL").select("parent_conv_id", *columns).unionByName(found.select("parent_conv_id", *columns))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
