"""Token ids of documents in files, with Elias-Fano encoded boundaries.

A file holds the ids of a range of documents, one after another in ascending order of doc_id, as 16-bit numbers (32-bit ones if the
vocabulary needs that), and two Elias-Fano sequences: where each document ends, and the document ids. Such a sequence of n numbers
up to u takes about n * (2 + log2(u / n)) bits; `select` finds the i-th number from the i-th set bit of its upper half, with a
sample of every 256th set bit's place to start from, and `between` finds a few in a row. Readers ask for the boundaries of some
documents at a time: a table of 64-bit offsets of a whole file exists nowhere.

    file = b"FFTOK1" | ids | upper, lower, samples of both sequences | JSON header | header length, b"FFTOK1"

Ids go to the file as they are made; boundaries follow at the end. Files are written whole under another name and then renamed, so a
task that runs twice leaves one file. Paths are opened by Arrow's file systems (file, hdfs, s3, gs and so on; s3a counts as s3).

Cases: null and empty texts are documents whose only id is the end id; repeated doc_ids stay documents of their own, in any order
among themselves, and are dealt to several files if they are many; rows with a null doc_id come before all others; a text of any length
is encoded whole; an empty table makes no file and reads back as no rows; only the named key and text columns are read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import park, shared_dir, slices, texts
from .words import Memo, coded, spread

MAGIC = b"FFTOK1"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, upper: np.ndarray, lower: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.upper, self.lower, self.samples = n, low_bits, upper, lower, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = (top // n).bit_length() - 1 if n and top > n else 0
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(place[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[place] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), place[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """The i-th number: its upper half is the place of the i-th set bit, less i; the walk starts at the sample before it."""
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = start // 8, start % 8
        ones = int(self.upper[byte]) >> skip << skip
        while ones.bit_count() <= left:
            left -= ones.bit_count()
            byte += 1
            ones = int(self.upper[byte])
        for _ in range(left):
            ones &= ones - 1
        place = byte * 8 + (ones & -ones).bit_length() - 1
        low = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (int(self.lower[at // 8]) >> at % 8 & 1) << k
        return (place - i) << self.low_bits | low

    def between(self, i: int, j: int) -> np.ndarray:
        """The numbers from the i-th to before the j-th: only the bits between the samples around them are looked at."""
        if i >= j:
            return np.zeros(0, dtype=np.int64)
        start, after = int(self.samples[i // SAMPLE]), -(-j // SAMPLE)
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.upper)
        place = np.flatnonzero(np.unpackbits(self.upper[start // 8 : stop], bitorder="little")) + start // 8 * 8
        first = int(np.searchsorted(place, start)) + i % SAMPLE
        high = place[first : first + j - i] - np.arange(i, j)
        a, b = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.lower[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(j - i, self.low_bits).astype(np.int64)
        return high << self.low_bits | (bits << np.arange(self.low_bits)).sum(axis=1)

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (self.upper, self.lower, self.samples)]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class TokenFile:
    """One file, opened for reading: only its header and boundaries are in memory."""

    def __init__(self, path: str):
        files, at = opened(path)
        self.file = files.open_input_file(at)
        end = self.file.size() - 10
        size, magic = struct.unpack("<I6s", self.file.read_at(10, end))
        if magic != MAGIC:
            raise ValueError(f"{path} holds no token ids")
        self.head = json.loads(self.file.read_at(size, end - size))
        at, sequences = len(MAGIC) + self.head["id_bytes"], []
        for x in self.head["sequences"]:
            upper, lower, samples = (np.frombuffer(self.file.read_at(n, at + sum(x["bytes"][:k])), dtype=kind) for k, (n, kind) in enumerate(zip(x["bytes"], (np.uint8, np.uint8, "<u8"), strict=True)))
            at += sum(x["bytes"])
            sequences.append(EliasFano(x["n"], x["low_bits"], upper, lower, samples))
        self.ends, self.docs = sequences
        self.kind = np.dtype(self.head["kind"])

    def __len__(self) -> int:
        return self.ends.n

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from place start to end of the file's one long array."""
        w = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - start) * w, len(MAGIC) + start * w), dtype=self.kind)

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where document i starts, and where it and the next ones up to before j end."""
        return np.concatenate(([self.ends.select(i - 1) if i else 0], self.ends.between(i, j)))

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found through `select`."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Ids of documents i to before j; those without one come first."""
        nulls = self.head["nulls"]
        known = self.docs.between(max(0, i - nulls), max(0, j - nulls)) + self.head["least"]
        return [None] * (min(j, nulls) - min(i, nulls)) + known.tolist()

    def close(self) -> None:
        self.file.close()


class TokenWriter:
    """A file in the making: ids are written at once, of each document its length and id are held until the end."""

    def __init__(self, path: str, kind: str):
        self.files, self.path = opened(path)
        self.kind, self.id_bytes, self.nulls = kind, 0, 0
        self.lengths: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.unfinished = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.unfinished)
        self.out.write(MAGIC)

    def add(self, keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents in ascending order of key, nulls first."""
        self.out.write(ids.tobytes())
        self.id_bytes += ids.nbytes
        self.nulls += keys.null_count
        self.keys.append(keys.drop_null().to_numpy(zero_copy_only=False))
        self.lengths.append(lengths.astype(np.uint32))

    def close(self) -> tuple[int, int]:
        """How many documents and ids the file has."""
        keys, ends = np.concatenate(self.keys), np.cumsum(np.concatenate(self.lengths), dtype=np.uint64)
        least = int(keys[0]) if len(keys) else 0
        sequences = [EliasFano.of(ends), EliasFano.of(keys - least)]
        head = json.dumps({"kind": self.kind, "nulls": self.nulls, "least": least, "id_bytes": self.id_bytes, "sequences": [{"n": s.n, "low_bits": s.low_bits, "bytes": [len(p) for p in s.parts()]} for s in sequences]}).encode()
        for part in [*sequences[0].parts(), *sequences[1].parts(), head, struct.pack("<I6s", len(head), MAGIC)]:
            self.out.write(part)
        self.out.close()
        self.files.move(self.unfinished, self.path)
        return len(ends), int(ends[-1])


def word_encoder(path: str) -> tuple[Callable[[list[str]], list[bytes]], str]:
    """Ids of words by the tokenizers library, and their kind of number.

    The tokenizer must split at white space and drop it, so that a text's ids are those of its words one after another.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def encode(words: list[str], some: int = 100) -> list[bytes]:
        """`some` words at a time as one text with a space between; where a token starts tells whose it is."""
        found, sizes = [], np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        for at in range(0, len(words), 50_000):
            rows = range(at, min(at + 50_000, len(words)), some)
            for i, e in zip(rows, tokenizer.encode_batch([" ".join(words[i : i + some]) for i in rows], add_special_tokens=False), strict=True):
                raw, n = np.array(e.ids, dtype=kind).tobytes(), int(kind[2:])
                places = np.fromiter((o[0] for o in e.offsets), dtype=np.int64, count=len(e.ids))
                cuts = (np.searchsorted(places, np.cumsum(sizes[i : i + some])[:-1]) * n).tolist()
                found += [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        return found

    return encode, kind


_memo: dict[str, tuple[Memo, str]] = {}


def _worker_memo(path: str) -> tuple[Memo, str]:
    """One for each Python worker, which serves many tasks."""
    if path not in _memo:
        encode, kind = word_encoder(path)
        _memo[path] = Memo(encode), kind
    return _memo[path]


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Writes the ids of all documents in ascending order of key; returns a row for each file: file (number), path, n_docs, n_ids.

    Documents are dealt to files by ranges of key; as many files as the input has partitions, unless told otherwise.
    """
    folder = folder or shared_dir(docs.sparkSession)
    # the row's number deals rows of one key to several files if need be
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(files or max(1, rows.rdd.getNumPartitions()), "k", "row").sortWithinPartitions("k", "row").select("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, kind = _worker_memo(tokenizer)
        number, out = TaskContext.get().partitionId(), None
        path, end = f"{folder}/part-{number:06d}.ids", np.array([end_id], dtype=kind)
        for batch in slices(batches, "t"):
            out = out or TokenWriter(path, kind)
            offsets, codes, words = coded(texts(batch, "t"))
            ids, ends = spread(memo(words), codes, kind)
            # the end id goes behind each document's ids
            out.add(batch.column("k"), np.diff(ends[offsets]) + 1, np.insert(ids, ends[offsets[1:]], end))
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"file": [number], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    return park(dealt.mapInArrow(run, "file long, path string, n_docs long, n_ids long"))


def read(files: DataFrame, some: int = 1024, step: int = 4 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of the files that `write` names."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("path", before.alias("before")).repartition(max(1, files.count()))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = TokenFile(path)
                for first in range(0, len(file), some):
                    docs = file.doc_ids(first, min(first + some, len(file)))
                    bounds = file.bounds(first, first + len(docs))
                    crcs, i = np.zeros(len(docs), dtype=np.int64), 0
                    while i < len(docs):  # some documents at a time, the longest alone if need be
                        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + step, side="right")) - 1)
                        ids, at = file.ids(int(bounds[i]), int(bounds[j])).astype("<u4"), bounds - bounds[i]
                        for d in range(i, j):
                            crcs[d] = zlib.crc32(ids[at[d] : at[d + 1]])
                        i = j
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": bounds[:-1] + before, "n_tokens": np.diff(bounds), "ids_crc32": crcs})
                file.close()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
