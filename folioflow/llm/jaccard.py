"""Exact n-gram Jaccard join by grouped prefixes, and the classes of documents that it links.

1. One pass hashes each text's distinct word n-grams (64 bits) and counts, for all documents, in how many each bucket of a fixed
   sketch occurs. Documents with the same set are one from here on.
2. N-grams are ordered by the sketch's count, rarest first. Two sets of Jaccard similarity t or more share one of their first
   n - ceil(t * n) + 1 n-grams. Sets with the same such prefix and the same size are collapsed into one group.
3. Prefix n-grams that only one group holds are left out. First each group is paired with the hub of each of its n-grams, the group
   that has it earliest; pairs are filtered by size and position, expanded to members and verified by whole sets.
4. Links of step 3 make components. Only where the groups of an n-gram are in different components can a link be missing that
   matters; those group pairs are filtered, expanded and verified too. So a large family of near copies costs a pair for each
   member and not for each two, and yet no two linked documents end in different components.

The sketch is of fixed size and so is what is broadcast; it only decides the order, so results don't depend on it.

Written tables are deleted once nothing reads them any more; what stays is what the returned rows are made of.

Cases: a text with fewer words than n is one n-gram of all its words; one without words, or null, has none and links with nothing
(its component is itself); rows that repeat a doc_id are one document with the links of each row; a null doc_id gets no component;
ties need no rule, as the answer is a set of links; a text of any length is one set, made and compared whole; an empty table gives no
rows; only the named key and text columns are read, so others may have any names. N-grams are compared by 64-bit hashes and sets by
128-bit ones, so the answer is exact up to collisions of those.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, texts
from .words import coded

SKETCH_BITS = 21
BLOCK = 1 << 15
SEEN_BITS = 22
P1, P2, P3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams."""
    offsets, codes, words = coded(column, lower=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    h = hashes[codes]
    grams = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        grams ^= grams >> np.uint64(29)
        grams *= P1
        grams += h[k : k + len(grams)] * P2
    grams ^= grams >> np.uint64(32)
    grams *= P3
    grams ^= grams >> np.uint64(29)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:  # all words as one, told apart from n-grams by the seed
            out.append(np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), seed=1)] if b > a else [], dtype=np.uint64))
    return out


def _sets(docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """kind 0: doc_id, n, sid (128-bit hash of the set); kind 1: blocks (n) of the sketch of each task (data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"doc_id": pa.int64(), "n": pa.int32(), "sid": pa.binary(), "data": pa.binary(), "kind": pa.int32()})
        seen = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in slices(batches, "t"):
            sets = shingle_sets(texts(batch, "t"), n)
            np.add.at(seen, (np.concatenate(sets) & mask).astype(np.int32), 1)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.nulls(len(sets), pa.binary()), pa.array([0] * len(sets), pa.int32())], schema=schema)
        parts = [(i, zlib.compress(b.astype("<u4").tobytes(), 1)) for i, b in enumerate(seen.reshape(-1, BLOCK)) if b.any()]
        yield pa.RecordBatch.from_pydict({"doc_id": [None] * len(parts), "n": [i for i, _ in parts], "sid": [None] * len(parts), "data": [d for _, d in parts], "kind": [1] * len(parts)}, schema=schema)

    return scratch.park(docs.mapInArrow(run, "doc_id long, n int, sid binary, data binary, kind int"), "kind")


def _summed(blocks: DataFrame, size: int) -> np.ndarray:
    """Adds up blocks (n, data) of counters on the executors; the driver gets `size` counters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for i, data in zip(frame["n"], frame["data"], strict=True):
                block = np.frombuffer(zlib.decompress(data), dtype="<u4")
                held[i] = held[i] + block if i in held else block.copy()
        yield pd.DataFrame({"n": list(held), "data": [zlib.compress(b.tobytes(), 1) for b in held.values()]})

    out = np.zeros(size, dtype=np.uint32)
    for i, data in blocks.select("n", "data").repartition("n").mapInPandas(run, "n int, data binary").collect():
        out[i * BLOCK : (i + 1) * BLOCK] = np.frombuffer(zlib.decompress(data), dtype="<u4")
    return out


def _prefixes(docs: DataFrame, order: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """doc_id, pid (128-bit hash of prefix and size), n, prefix (ordered hashes) of each set that isn't empty."""
    counts = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mask = counts.value, np.uint64(len(counts.value) - 1)
        for batch in slices(batches, "t"):
            rows = []
            for key, s in zip(batch.column("k").to_pylist(), shingle_sets(texts(batch, "t"), n), strict=True):
                if len(s):
                    length = len(s) - -(-len(s) * num // den) + 1
                    prefix = s[np.lexsort((s, seen[(s & mask).astype(np.int64)]))[:length]].tobytes()
                    rows.append((key, xxhash.xxh3_128_digest(prefix, seed=len(s)), len(s), prefix))
            if rows:
                key, pid, size, prefix = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(pid, pa.binary()), pa.array(size, pa.int32()), pa.array(prefix, pa.binary())], names=["doc_id", "pid", "n", "prefix"])

    return docs.mapInArrow(run, "doc_id long, pid binary, n int, prefix binary")


def _postings(groups: DataFrame) -> DataFrame:
    """token, gid, n, pos: a row for each prefix n-gram of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(p, dtype=np.int64) for p in batch.column("prefix").to_pylist()]
            sizes = np.array([len(p) for p in prefixes], dtype=np.int64)
            total = int(sizes.sum())
            if total:
                repeat = lambda c: np.repeat(batch.column(c).to_numpy(), sizes)
                pos = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), pa.array(repeat("gid")), pa.array(repeat("n")), pa.array(pos.astype(np.int32))], names=["token", "gid", "n", "pos"])

    return groups.select("prefix", "gid", "n").mapInArrow(run, "token long, gid long, n int, pos int")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of n-grams that two or more groups hold, each with its hub (gid, n, pos): the group that has the n-gram earliest.

    Rows come ordered by token, so one is kept if a neighbour has its token; tasks stream over any number of rows of a token.
    """
    names = ["token", "gid", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple | None = None  # of the last row's token: its first row
        last: tuple | None = None  # the last row so far, if nothing before it has its token
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in names]
            if last is not None:
                cols = [np.concatenate(([x], c)) for x, c in zip(last, cols, strict=True)]
            token = cols[0]
            new = np.concatenate(([hub is None or last is not None or hub[0] != token[0]], token[1:] != token[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            hubs = [np.where(first >= 0, c[first], h) for c, h in zip(cols, hub or [0] * 4, strict=True)]
            keep = ~new | np.concatenate((~new[1:], [False]))
            last = tuple(c[-1] for c in cols) if new[-1] else None
            hub = tuple(h[-1] for h in hubs)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols] + [pa.array(h[keep]) for h in hubs[1:]], names=[*names, "h_gid", "h_n", "h_pos"])

    ordered = postings.repartition("token").sortWithinPartitions("token", "pos", F.xxhash64("gid"))
    return ordered.mapInArrow(run, "token long, gid long, n int, pos int, h_gid long, h_n int, h_pos int")


def _near(num: int, den: int, a: str = "a", b: str = "b") -> Column:
    """Size and position filters of two postings with columns named a_n, a_pos, b_n, b_pos."""
    an, ap, bn, bp = (F.col(x).cast("long") for x in (f"{a}_n", f"{a}_pos", f"{b}_n", f"{b}_pos"))
    return (den * F.least(an, bn) >= num * F.greatest(an, bn)) & ((num + den) * F.least(an - ap, bn - bp) >= num * (an + bn))


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Only for documents that some pair may need are sets made and shuffled."""
    spark = pairs.sparkSession

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << SEEN_BITS, dtype="<u4")
        for frame in frames:
            seen[frame["h"].to_numpy()] = 1
        parts = [(i, zlib.compress(b.tobytes(), 1)) for i, b in enumerate(seen.reshape(-1, BLOCK)) if b.any()]
        yield pd.DataFrame({"n": [i for i, _ in parts], "data": [d for _, d in parts]})

    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SEEN_BITS)).cast("int")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    needed = spark.sparkContext.broadcast(np.packbits(_summed(ends.select(place("id").alias("h")).mapInPandas(places, "n int, data binary"), 1 << SEEN_BITS) > 0, bitorder="little"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            kept = batch.filter(pa.array((needed.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))
            for part in slices(iter([kept]), "t"):
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([s.tobytes() for s in shingle_sets(texts(part, "t"), n)], pa.binary())], names=["id", "data"])

    sets = scratch.park(docs.filter("k is not null").withColumn("h", place("k")).mapInArrow(some, "id long, data binary").filter("length(data) > 0"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("data").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("data").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs: merged in linear time
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    out = scratch.park(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct())
    scratch.drop(sets)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, comp (the smallest id reachable) of every id in edges (a, b), by alternating large and small stars."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(least, "u")
        if large:
            out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first())

    given, before = edges, state(edges)
    while before[0]:
        large = scratch.park(stars(edges, True))
        small = scratch.park(stars(large, False))
        scratch.drop(large, *[edges] * (edges is not given))
        edges, now = small, state(small)
        if now == before:
            break
        before = now
    stars_only = edges.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("comp"))
    return stars_only.unionByName(stars_only.select(F.col("comp").alias("id"), "comp")).distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; two documents link when den * intersection >= num * union."""
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    scratch = Scratch(docs.sparkSession)
    park = scratch.park
    found = _sets(docs, n, scratch)
    sets = found.filter("kind = 0").select("doc_id", "n", "sid")
    order = _summed(found.filter("kind = 1"), 1 << SKETCH_BITS)
    prefixes = park(_prefixes(docs.filter("k is not null"), order, n, num, den))
    full = sets.filter("n > 0 and doc_id is not null")
    reps = park(full.groupBy("sid").agg(F.min("doc_id").alias("rep")))
    # sets with the same prefix and size: one group, named after its smallest member
    one = prefixes.select("doc_id", "pid").join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct()
    grouped = park(one.join(one.groupBy("pid").agg(F.min("doc_id").alias("gid")), "pid").select("gid", "pid", F.col("doc_id").alias("rep")))
    members = grouped.select("gid", "rep").distinct()
    named = prefixes.join(grouped.filter("rep = gid").select("gid", "pid", F.col("gid").alias("doc_id")), ["doc_id", "pid"]).select("gid", "n", "prefix", "pid").dropDuplicates(["gid", "pid"])
    postings = park(_shared(_postings(named)))
    scratch.drop(prefixes)
    to_hub = postings.filter("gid <> h_gid").select(*[F.col(x).alias(y) for x, y in (("gid", "g"), ("n", "a_n"), ("pos", "a_pos"), ("h_gid", "h"), ("h_n", "b_n"), ("h_pos", "b_pos"))]).filter(_near(num, den)).select("g", "h")
    in_group = members.filter("rep <> gid").select(F.least("gid", "rep").alias("a"), F.greatest("gid", "rep").alias("b"))
    expanded = to_hub.distinct().join(members.withColumnRenamed("gid", "g"), "g").select(F.least("rep", "h").alias("a"), F.greatest("rep", "h").alias("b"))
    tried = park(expanded.unionByName(in_group).distinct())
    close = _verified(tried, docs, n, num, den, scratch)
    # rows of one doc_id with several texts
    own = full.select("doc_id", "sid").join(reps, "sid").groupBy("doc_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("reps")).filter(F.size("reps") > 1)
    links = park(close.unionByName(own.select(F.explode("reps").alias("a"), "b").filter("a <> b")))
    first = park(components(links, scratch))

    def label(df: DataFrame, comps: DataFrame, name: str, out: str) -> DataFrame:
        return df.join(comps.select(F.col("id").alias(name), F.col("comp").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))

    labelled = park(label(members, first, "rep", "comp"))
    scratch.keep(found, reps, postings, tried, links, labelled)
    span = labelled.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    spread = postings.select("token", "gid", "n", "pos").join(span, "gid")
    mixed = park(spread.join(spread.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("token"), "token"))
    scratch.drop(postings)
    side = lambda s: mixed.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("gid", "n", "pos", "low", "high")])
    apart = (F.col("a_low") != F.col("b_high")) | (F.col("a_high") != F.col("b_low"))
    group_pairs = side("a").join(side("b"), "token").filter(F.expr("a_gid < b_gid") & apart & _near(num, den))
    group_pairs = group_pairs.select(F.col("a_gid").alias("g"), F.col("b_gid").alias("h")).unionByName(span.filter("low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))).distinct()
    left, right = (labelled.select(F.col("gid").alias(g), F.col("rep").alias(r), F.col("comp").alias(c)) for g, r, c in (("g", "x", "cx"), ("h", "y", "cy")))
    missing = group_pairs.join(left, "g").join(right, "h").filter("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    untried = park(missing.join(tried, ["a", "b"], "left_anti"))
    scratch.keep(found, reps, links, untried)
    more = _verified(untried, docs, n, num, den, scratch)
    comps = park(components(links.unionByName(more), scratch))
    scratch.keep(found, reps, comps)
    rows = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sid")
    named = label(rows.join(reps, "sid", "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep"))), comps, "rep", "component_id")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
