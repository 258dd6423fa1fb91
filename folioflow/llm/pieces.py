"""SentencePiece BPE with seeded merge-dropout, and lossless decoding.

A text is escaped as the model wants it (a space in front, spaces as U+2581) and cut into units, each a run of U+2581 with what
follows it; no piece of a BPE model reaches over such a cut. In a unit, an agenda holds the candidate merges, best piece first, then
leftmost. A candidate taken from the agenda is skipped if its keyed hash (seed, document key, the unit's place in the document, place
in the unit) falls below the dropout rate; the rest is the usual merging. With rate 0 the pieces are those of the sentencepiece library.

So each occurrence of a word is cut by itself. Thousands of occurrences are taken at a time, a column of a matrix for each, and every
step takes the next candidate of all their agendas at once: nothing is remembered of words, and memory is that of one slice of text.
Units of over 56 characters have an agenda of their own, a heap. Characters without a piece become byte pieces, as does a literal
U+2581, which would otherwise come back as a space: decoding gives back every text exactly.

Cases: null and empty texts have no pieces and decode to ""; a null key hashes like any other; rows that repeat a key and text get
equal ids, whichever task has them; very long texts are slices of their own, and units of any length take n log n steps; ties between
candidates go to the leftmost. Columns of the input named like an added one are replaced, all others pass through.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, spare, texts
from .words import coded

MARK = "▁"
UNIT = re.compile(r" *[^ ]*")
M64 = (1 << 64) - 1
#: Text that is encoded and decoded at a time: the places of ids and bytes take many times its size.
SLICE_BYTES = 2 << 20
#: Units are merged together with others of up to the same of these lengths; longer ones alone.
LENGTHS = (3, 5, 7, 9, 11, 13, 16, 20, 28, 40, 56)
COLUMNS = 4096
GOLDEN, PLACE, LENGTH = 0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: A candidate in a matrix is its rank and its row in one number; this one stands for none.
ROW_BITS = 6
NONE = 1 << 30


def occurrences(documents: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys (64 bits) of the units at these places of documents with these hashes."""
    h = documents.astype(np.int64).view(np.uint64) + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def skip(key: int, start: int, length: int) -> int:
    """Keyed hash (32 bits) of a candidate merge: where it starts and how long it is."""
    h = key ^ (start * PLACE + length * LENGTH & M64)
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & M64
    return (h ^ (h >> 29)) & 0xFFFFFFFF


#: The part of `skip` that depends on the candidate alone, by start and length.
MIXES = np.array([[s * PLACE + n * LENGTH & M64 for n in range(1 << ROW_BITS)] for s in range(1 << ROW_BITS)], dtype=np.uint64)


class Ranks:
    """Which piece two neighbours make: an open hash table of pairs of symbols, asked for many pairs at once."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        bits = max(10, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        slots, left = self._slots(pairs), np.arange(len(pairs))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = pairs[free]  # of those that want one slot, the last gets it
            got = self.keys[slots[left]] == pairs[left]
            self.ranks[slots[left[got]]] = ranks[left[got]]
            left = left[~got]
            slots[left] = slots[left] + 1 & self.mask

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(GOLDEN)) >> self.shift).view(np.int64)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        slots = self._slots(pairs)
        found = self.keys[slots]
        out = np.where(found == pairs, self.ranks[slots], np.int32(NONE >> ROW_BITS))
        open_ = np.flatnonzero((found != pairs) & (found >= 0))
        while len(open_):
            slots[open_] = slots[open_] + 1 & self.mask
            found = self.keys[slots[open_]]
            hit = found == pairs[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class PieceModel:
    """The pieces of a SentencePiece BPE model, read through the library.

    A symbol is a piece's id, or for a character without a piece a number behind all ids; `nothing` stands beside a unit's ends.
    """

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [library.id_to_piece(i) for i in range(library.vocab_size())]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_unused(i) for i in range(len(self.pieces))]
        self.byte = np.zeros(256, dtype=np.int64)
        self.ids: dict[str, int] = {}
        surface = []
        scored = []
        for i, piece in enumerate(self.pieces):
            if library.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                surface.append(bytes([int(piece[1:-1], 16)]))
            else:
                surface.append(b"" if special[i] else piece.replace(MARK, " ").encode())
                if not special[i]:
                    self.ids[piece] = i
                    scored.append((-library.get_score(i), i, piece))
        if MARK not in self.ids:
            raise ValueError(f"{path} has no piece for a space")
        ordered = sorted(scored)
        self.rank = {piece: k for k, (_, _, piece) in enumerate(ordered)}  # of pieces that may be merged: their place, best first
        self.by_rank = np.array([i for _, i, _ in ordered], dtype=np.int64)
        self.nothing = len(self.pieces)
        self.stride = self.nothing + 1 + 0x110000
        self.symbols = np.arange(self.nothing + 1, self.stride)  # by code point
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != MARK:
                self.symbols[ord(piece)] = i
        self.symbols[ord(" ")] = self.ids[MARK]
        symbol = lambda part: self.ids.get(part, self.nothing + 1 + ord(part) if len(part) == 1 else None)
        pairs = [(symbol(p[:k]), symbol(p[k:]), r) for p, r in self.rank.items() for k in range(1, len(p))]
        left, right, ranks = (np.array(x, dtype=np.int64) for x in zip(*[x for x in pairs if None not in x], strict=True))
        self.ranks = Ranks(left * self.stride + right, ranks)
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_n = np.array([len(x) for x in surface])
        self.surface_at = np.cumsum(self.surface_n) - self.surface_n

    def matrices(self, units: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and agenda of units of up to `length` characters: a column for each, a row of `nothing` above and below."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        unit = np.repeat(np.arange(len(units)), n)
        row = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n) + 1
        symbols = np.full((length + 2, len(units)), self.nothing, dtype=np.int64)
        symbols[row, unit] = self.symbols[points]
        ranks = np.full(symbols.shape, NONE >> ROW_BITS, dtype=np.int32)
        ranks[1:-1] = self.ranks((symbols[1:-1] * self.stride + symbols[2:]).ravel()).reshape(length, len(units))
        return symbols, ranks << ROW_BITS | np.arange(length + 2, dtype=np.int32)[:, None]

    def merge(self, symbols: np.ndarray, agenda: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
        """Merges the columns of such matrices in place, with candidates skipped at `rate`; returns which symbols are left."""
        rows, n = symbols.shape
        left = symbols != self.nothing
        after, before = (np.repeat(np.arange(rows, dtype=np.int64) + step, n) for step in (1, -1))
        s, a, gone, limit = symbols.reshape(-1), agenda.reshape(-1), left.reshape(-1), np.uint64(int(rate * (1 << 32)))
        while True:
            best = agenda.min(axis=0)
            column = np.flatnonzero(best < NONE)
            if not len(column):
                return left
            best = best[column]
            row = best.astype(np.int64) & (1 << ROW_BITS) - 1
            at = row * n + column
            second = after[at] * n + column
            third = after[second]
            if limit:
                h = keys[column] ^ MIXES[row - 1, third - row]
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                stays = ((h ^ (h >> np.uint64(29))) & np.uint64(0xFFFFFFFF)) >= limit
                a[at[~stays]] = NONE
                best, row, column, at, second, third = (x[stays] for x in (best, row, column, at, second, third))
            made = self.by_rank[best >> ROW_BITS]
            s[at] = made
            gone[second] = False
            a[second] = NONE
            after[at] = third
            first = before[at]
            third = third * n + column
            before[third] = row
            above = first * n + column
            ranks = self.ranks(np.concatenate((s[above] * self.stride + made, made * self.stride + s[third])))
            a[above] = ranks[: len(at)] << ROW_BITS | first
            a[at] = ranks[len(at) :] << ROW_BITS | row

    def cut(self, units: list[str], codes: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units of these codes one after another, and where each one's ids end (with a leading 0), given their keys."""
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        kind = np.searchsorted(LENGTHS, sizes)  # the last kind is merged one by one
        kinds, number = kind[codes], np.zeros(len(units), dtype=np.int64)
        found, n = [], np.zeros(len(codes), dtype=np.int64)
        for k in np.unique(kinds).tolist():
            some = np.flatnonzero(kinds == k)
            if k == len(LENGTHS):
                lists = [self.alone(units[c], key, rate) for c, key in zip(codes[some].tolist(), keys[some].tolist(), strict=True)]
                n[some] = [len(x) for x in lists]
                found.append((some, np.array([i for x in lists for i in x], dtype=np.int64)))
                continue
            mine = np.flatnonzero(kind == k)
            number[mine] = np.arange(len(mine))
            symbols, agenda = self.matrices([units[i] for i in mine.tolist()], LENGTHS[k])
            for at in range(0, len(some), COLUMNS):
                part = some[at : at + COLUMNS]
                which = number[codes[part]]
                s, a = symbols.take(which, axis=1), agenda.take(which, axis=1)
                left = self.merge(s, a, keys[part], rate)
                n[part] = left.sum(axis=0)
                found.append((part, s.T[left.T]))
        ends = np.concatenate(([0], np.cumsum(n)))
        out = np.zeros(ends[-1], dtype=np.int64)
        for part, values in found:
            m = n[part]
            out[np.arange(len(values)) + np.repeat(ends[part] - (np.cumsum(m) - m), m)] = values
        return self._with_bytes(out, ends)

    def _with_bytes(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the bytes of characters that have no piece."""
        odd = symbols > self.nothing
        if not odd.any():
            return symbols, ends
        points = symbols[odd] - self.nothing - 1
        raw = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        n = np.ones(len(symbols), dtype=np.int64)
        n[odd] += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        out = np.repeat(symbols, n)
        out[np.repeat(odd, n)] = self.byte[np.frombuffer(raw, dtype=np.uint8)]
        return out, np.concatenate(([0], np.cumsum(n)))[ends]

    def alone(self, unit: str, key: int, rate: float) -> list[int]:
        """Ids of one unit of any length (spaces not yet escaped). A literal mark is None until it becomes bytes, so nothing merges with it."""
        parts: list[str | None] = [None if c == MARK else MARK if c == " " else c for c in unit]
        n = len(parts)
        rank = self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and parts[left] is not None and parts[right] is not None:
                joined = parts[left] + parts[right]
                k = rank.get(joined)
                if k is not None:
                    heapq.heappush(agenda, (k, left, right, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        limit = int(rate * (1 << 32))
        gone = bytearray(n)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if gone[left] or gone[right] or after[left] != right or parts[left] + parts[right] != joined:
                continue
            if limit and skip(key, left, len(joined)) < limit:
                continue
            parts[left] = joined
            gone[right] = 1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        out: list[int] = []
        for i in range(n):
            if not gone[i]:
                found = self.ids.get(parts[i]) if parts[i] is not None else None
                out += [found] if found is not None else self.byte[list((parts[i] or MARK).encode("utf-8", "surrogatepass"))].tolist()
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each document's bytes end, given where its ids end (with a leading 0)."""
        n = self.surface_n[ids]
        stop = np.concatenate(([0], np.cumsum(n)))
        place = np.arange(stop[-1], dtype=np.int64)
        place += np.repeat(self.surface_at[ids] - stop[:-1], n)
        return self.surface[place], stop[ends]


_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """Read once for each Python worker, which serves many tasks."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encode(column: pa.Array, documents: np.ndarray, model: PieceModel, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's ids end (with a leading 0), given the documents' hashes."""
    offsets, codes, words = coded(column, " ")
    units = [" " + w for w in words]  # a unit is a space and a word
    blank = words.index("") if "" in words else -1
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    odd = np.unique(rows[codes == blank]).tolist() if blank >= 0 else []  # two spaces on end, or some at an end
    if odd:
        known = {u: k for k, u in enumerate(units)}
        parts, done = [], 0
        for i in odd:
            text = column[i].as_py()
            found = [u for u in UNIT.findall(" " + text) if u] if text else []
            parts += [codes[offsets[done] : offsets[i]], np.array([known.setdefault(u, len(known)) for u in found], dtype=codes.dtype)]
            done = i + 1
        parts.append(codes[offsets[done] : offsets[-1]])
        n = np.diff(offsets)
        n[odd] = [len(p) for p in parts[1::2]]
        codes, units, offsets = np.concatenate(parts), list(known), np.concatenate(([0], np.cumsum(n)))
        rows = np.repeat(np.arange(len(column)), n)
    ids, ends = model.cut(units, codes, occurrences(documents[rows], np.arange(len(rows)) - offsets[rows]), rate)
    return ids, ends[offsets]


def encode(docs: DataFrame, model_path: str, seed: int = 17, rate: float = 0.1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds piece_ids (array), n_pieces, ids_crc32 (unsigned, ids as little-endian unsigned 32-bit numbers) and decoded_equal."""
    return _coded(docs, model_path, seed, rate, key, text, True)


def digests(docs: DataFrame, model_path: str, seed: int = 17, rate: float = 0.1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_pieces, ids_crc32 and decoded_equal alone: what `encode` adds, without texts and ids leaving the workers."""
    return _coded(docs.select(key, text), model_path, seed, rate, key, text, False).drop(text)


def _coded(docs: DataFrame, model_path: str, seed: int, rate: float, key: str, text: str, with_ids: bool) -> DataFrame:
    new = [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_equal", T.BooleanType())]
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in {f.name for f in new}])
    document = spare(kept, "document")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in slices(batches, text, SLICE_BYTES):
            column = texts(batch, text)
            ids, ends = _encode(column, batch.column(document).to_numpy(), model, rate)
            back, stops = model.decode(ids, ends)
            wide, sources, back = ids.astype("<u4"), column.to_pylist(), back.tobytes()
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            # the first byte of a document is the space that encoding put there
            equal = [back[a + 1 : b] == s.encode() for a, b, s in zip(stops[:-1], stops[1:], sources, strict=True)]
            arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))] * with_ids + [pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64()), pa.array(equal, pa.bool_())]
            old = [(batch.column(i), n) for i, n in enumerate(batch.schema.names) if n != document]
            yield pa.RecordBatch.from_arrays([a for a, _ in old] + arrays, names=[n for _, n in old] + [f.name for f in new])

    return kept.withColumn(document, F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"))).mapInArrow(run, T.StructType([*kept.schema.fields, *new]))


def decode(ids: list[int], model_path: str) -> str:
    """The text of one document's ids."""
    back, _ = model_of(model_path).decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))
    return back.tobytes()[1:].decode("utf-8", "surrogatepass")
