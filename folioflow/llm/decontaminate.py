"""Benchmark decontamination: finds the word windows of test items in documents, and removes the spans or the documents that hold them.

Words are the runs of letters, digits and characters beyond ASCII, A-Z in lower case. Windows are `n` consecutive words of an item; an item
of fewer words is one window as a whole. The windows of all items are a hash set that is broadcast; a task looks up the windows of its
documents whose words all occur in the set's vocabulary, and verifies each hit word by word.

The set is broadcast in blocks of a bounded size: items are dealt to as many blocks as their bytes need, and documents pass one block after
another, carrying the hits so far; after every four blocks they are written. Nothing else is shuffled.

Cases: a null text has no words; an item without words has no window; rows that repeat an item_id are one item; a window of an item whose id is
null hits like any other, but counts as no item; equal windows of several items count for all of them; empty tables give no rows or no hits;
texts are taken whole; other columns are kept, also those named like the new ones, which then get other names by `spare`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, spare, texts

#: Bytes of item texts in a block: its index takes about six times as much in a worker.
BLOCK_BYTES = 8 << 20
#: What each byte is to words: itself, a small letter, or a space.
BYTES = np.array([b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)], dtype=np.uint8)


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Bytes of the texts with spaces for all that is no word, where each text begins (with the end behind), and both as an array."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int32)
    held = column.buffers()[2]
    data = BYTES[np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]]] if held is not None and n else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    return data, offsets, pa.StringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))


def words(column: pa.StringArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's words begin among all words (with the end behind), and the words."""
    lists = pc.ascii_split_whitespace(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        flat = flat.filter(pa.array(full))
    return offsets, flat.dictionary_encode()


class Index:
    """The windows of a block of items: for each length the sorted hashes, one place of each window, and its items."""

    def __init__(self, ids: list[str | None], column: pa.Array, n: int):
        offsets, coded = words(normalised(column)[2])
        self.vocabulary, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.names = sorted({x for x in ids if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        item = np.array([number.get(x, -1) for x in ids], dtype=np.int64)
        counts = np.diff(offsets)
        lengths = np.minimum(counts, n)
        self.windows, self.factor = {}, 0x9E3779B97F4A7C15
        for length in sorted(set(lengths[lengths > 0].tolist())):
            of = np.flatnonzero(lengths == length)
            many = counts[of] - length + 1
            row = np.repeat(of, many)
            starts = offsets[row] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            self.windows[length] = self._table(starts, item[row], length)

    def hashes(self, codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.uint64)
        for k in range(length):
            out = out * np.uint64(self.factor) + codes[starts + k].astype(np.uint64) + np.uint64(1)
            out ^= out >> np.uint64(29)
        return out

    def _table(self, starts: np.ndarray, items: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        hashes = self.hashes(self.codes, starts, length)
        order = np.argsort(hashes, kind="stable")
        hashes, starts, items = hashes[order], starts[order], items[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        for k in range(length):
            if (~new[1:] & (self.codes[starts[1:] + k] != self.codes[starts[:-1] + k])).any():
                raise ArithmeticError("two windows share a hash of 64 bits: choose another factor")
        window = np.cumsum(new) - 1
        pairs = np.unique(np.stack([window, items], axis=1)[items >= 0], axis=0)
        ends = np.searchsorted(pairs[:, 0], np.arange(window[-1] + 2))
        return hashes[new], starts[new], ends, pairs[:, 1]

    def hits(self, offsets: np.ndarray, coded: pa.DictionaryArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: it, the first words of the windows that occur, and the numbers of these windows."""
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        codes = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, dtype=np.int32)
        unknown = np.concatenate(([0], np.cumsum(codes < 0)))
        end = np.repeat(offsets[1:], np.diff(offsets))
        for length, (hashes, places, *_) in self.windows.items():
            starts = np.arange(max(0, len(codes) - length + 1))
            starts = starts[(starts + length <= end[: len(starts)]) & (unknown[length:] == unknown[: len(starts)])]
            if not len(starts):
                continue
            found = self.hashes(codes, starts, length)
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            same = hashes[at] == found
            starts, at = starts[same], at[same]
            for k in range(length):  # verified word by word
                same = codes[starts + k] == self.codes[places[at] + k]
                starts, at = starts[same], at[same]
            if len(starts):
                yield length, starts, at

    def items(self, length: int, windows: np.ndarray) -> np.ndarray:
        _, _, ends, items = self.windows[length]
        windows = np.unique(windows)
        many = ends[windows + 1] - ends[windows]
        return items[np.repeat(ends[windows] - (np.cumsum(many) - many), many) + np.arange(many.sum())]


def _ranges(hit: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true values, one run after another."""
    return np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))


def _scan(index, names: tuple[str, str, str, str], text: str, first: bool):
    n_words, hits, spans, items = names
    kinds = {n_words: pa.int64(), hits: pa.list_(pa.int64()), spans: pa.list_(pa.int64()), items: pa.list_(pa.string())}

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, block = texts(batch, text), index.value
        data, at, column = normalised(own)
        offsets, coded = words(column)
        n = batch.num_rows
        ranges, found, places = [[]] * n if first else batch.column(hits).to_pylist(), [[]] * n if first else batch.column(items).to_pylist(), [[]] * n if first else batch.column(spans).to_pylist()
        new, cover = {}, np.zeros(offsets[-1] + 1, dtype=np.int32)
        for length, starts, windows in block.hits(offsets, coded):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + length, -1)
            rows = np.searchsorted(offsets, starts, side="right") - 1
            cuts = np.flatnonzero(np.diff(rows)) + 1
            for row, of in zip(rows[np.concatenate(([0], cuts))].tolist(), np.split(windows, cuts), strict=True):
                new.setdefault(row, []).append(block.items(length, of))
        covered = np.cumsum(cover)[:-1] > 0
        for row, of in new.items():
            low, high = offsets[row], offsets[row + 1]
            hit = covered[low:high].copy()
            for start, end in zip(ranges[row][::2], ranges[row][1::2]):
                hit[start:end] = True
            held = _ranges(hit)
            ranges[row], found[row] = held.tolist(), sorted({*found[row], *(block.names[i] for i in np.unique(np.concatenate(of)))})
            part = data[at[row] : at[row + 1]]
            edges = _ranges(part != 32)  # starts and ends of words as bytes
            raw = np.frombuffer(own[row].as_buffer(), dtype=np.uint8)
            points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            places[row] = np.stack([points[edges[::2][held[::2]]], points[edges[1::2][held[1::2] - 1]]], axis=1).ravel().tolist()
        made = {n_words: np.diff(offsets), hits: ranges, spans: places, items: found}
        return pa.RecordBatch.from_arrays([pa.array(made[c], kinds[c]) if c in made else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield look(batch)

    return scan


def scan(docs: DataFrame, items: DataFrame, text: str = "text", n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs with n_words, hits (starts and ends of runs of hit words, counted in words), spans (the same in code points of the text)
    and items (ids whose windows occur, as sorted strings). items: item_id, text."""
    spark = docs.sparkSession
    rows = items.filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("id"), "text").distinct()
    blocks = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    names = tuple(spare(docs, c) for c in ("n_words", "hits", "spans", "items"))
    kinds = dict(zip(names, ("long", "array<long>", "array<long>", "array<string>"), strict=True))
    out, scratch = docs, Scratch(spark)
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).toArrow().combine_chunks()
        column = part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string())
        index = spark.sparkContext.broadcast(Index(part.column("id").to_pylist(), column.cast(pa.string()), n))
        if block == 0:
            for name, kind in kinds.items():
                out = out.withColumn(name, F.lit(None).cast(kind))
        out = out.mapInArrow(_scan(index, names, text, block == 0), out.schema)
        if block % 4 == 3 and block + 1 < blocks:
            out = scratch.park(out)
    return out


def n_hit(hits: Column) -> Column:
    """How many words are hit."""
    return F.aggregate(hits, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda held, x: F.struct((held["n"] + held["sign"] * x).alias("n"), (-held["sign"]).alias("sign")), lambda held: held["n"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its hit spans; null stays null."""
    edges = F.concat(F.array(F.lit(0).cast("long")), F.coalesce(spans, F.array().cast("array<long>")), F.array(F.length(text).cast("long")))
    gaps = F.sequence(F.lit(0), F.size(edges) - 2, F.lit(2))
    cut = lambda i: F.substring(text, (F.get(edges, i) + 1).cast("int"), (F.get(edges, i + 1) - F.get(edges, i)).cast("int"))
    return F.when(text.isNotNull(), F.array_join(F.transform(gaps, cut), ""))


def without_documents(scanned: DataFrame, hits: str = "hits") -> DataFrame:
    """The documents that hold no window of any item."""
    return scanned.filter(F.size(hits) == 0)
