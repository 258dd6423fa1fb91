"""Words of whole Arrow batches as codes into a list of distinct words, so that Python looks at each distinct word once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def coded(texts: pa.Array, separator: str | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """offsets (len + 1), codes and distinct words of the texts.

    Without a separator, words are the runs between `[\\x20\\x09-\\x0D]+`; with one, all parts between it, empty ones too. lower: A-Z only.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    if separator is None and "" in words:  # an empty text, or white space at either end
        full = codes != words.index("")
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        codes = codes[full]
    return offsets, codes, words


class Memo:
    """Values of words that a worker has met, in bounded memory: of `limit` words or `most` bytes and of those met since, the older ones go first.

    A word longer than `longest` is made anew each time.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int = 500_000, most: int = 48 << 20, longest: int = 4096):
        self.make, self.limit, self.most, self.longest = make, limit, most, longest
        self.known, self.older, self.bytes = {}, {}, 0

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.limit or self.bytes > self.most:
            self.known, self.older, self.bytes = {}, self.known, 0
        known, older = self.known, self.older
        missing = [w for w in words if w not in known]
        if missing:
            again = {w: older[w] for w in missing if w in older}
            fresh = [w for w in missing if w not in again] if again else missing
            made = dict(zip(fresh, self.make(fresh), strict=True))
            long = {w: v for w, v in made.items() if len(w) > self.longest}
            kept = again | {w: v for w, v in made.items() if w not in long}
            known.update(kept)
            self.bytes += sum(len(w) + len(v) for w, v in kept.items())
            if long:
                return [long[w] if w in long else known[w] for w in words]
        return [known[w] for w in words]


def spread(values: list[bytes], codes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of the codes one after another as an array of `kind`, and where each code's items end (with a leading 0)."""
    flat = np.frombuffer(b"".join(values), dtype=kind)
    counts = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // np.dtype(kind).itemsize
    starts = np.cumsum(counts) - counts
    n = counts[codes]
    ends = np.concatenate(([0], np.cumsum(n)))
    place = np.arange(ends[-1], dtype=np.int64)
    place += np.repeat(starts[codes] - ends[:-1], n)
    return flat[place], ends
