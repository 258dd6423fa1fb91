"""Secret scans: fixed patterns, and character Markov models for the secrets that no pattern names.

The base rules find assignments, access keys and long hex runs. Beside them, each run of 12 or more key characters, letters alone
included, is scored by character bigram models, of random strings (one for each alphabet that secrets are written in) and of ordinary
identifiers; a run whose log-likelihood ratio, of its likeliest alphabet, is high enough for its length is a span of kind `markov`. Of a run
that touches base spans, each part of 12 or more characters outside them is scored as a run of its own. The models learn from labelled
samples: values of base spans are labelled random, words and identifiers outside them ordinary, as they stand and in capitals; strings
made by a keyed hash are labelled random, a bounded number for each alphabet, whatever the table holds.

Cases: null and empty texts have no span; positions count code points, end exclusive; spans are ordered by start, then kind; with
no identifier to learn from, no span is added; repeated rows get equal answers; spans of several
kinds may start at one place, then the listed order of kinds decides; a text of any length is searched whole; an empty table gives no
rows; only the named key and text columns are read, and only the key is passed on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, slices, texts

KINDS = ("assign", "access", "hex", "markov")
#: An assignment whose value is too short still takes its characters; so the length is tested afterwards.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: As runs are taken whole, a minimum inside the pattern finds the same as a test afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 12
RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9_]{6,}")
#: A text without any of these has no span; RE2 in Arrow decides that for whole batches.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_-]{12}"""
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
N = len(ALPHABET) + 1  # the last symbol stands for the start
CODE = np.full(128, N - 1, dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Alphabets of the random strings that are made as labelled samples, and how many strings of each are made.
UPPER, LOWER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
MADE = {
    "hex": DIGITS + "abcdef", "hex_upper": DIGITS + "ABCDEF", "base32": UPPER + "234567", "lower": LOWER, "upper": UPPER, "letters": UPPER + LOWER, "base36": LOWER + DIGITS, "base36_upper": UPPER + DIGITS,
    "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64_url": UPPER + LOWER + DIGITS + "_-",
}
SAMPLES = 4_000


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base rules, ordered by start, then kind as listed."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def bigrams(run: str) -> np.ndarray:
    """Codes of the pairs of neighbours, the start before the first character."""
    c = CODE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
    return np.concatenate(([N - 1], c[:-1])) * N + c


def made_strings(alphabet: str, n: int, key: str) -> list[str]:
    """n random strings of 12 to 47 characters of an alphabet, always the same ones for a key."""
    drawn = np.frombuffer(hashlib.shake_256(f"{key}:{alphabet}".encode()).digest(4 * 48 * n), dtype=np.uint32) % len(alphabet)
    return ["".join(row[: 12 + i % 36]) for i, row in enumerate(np.array(list(alphabet))[drawn].reshape(n, 48))]


def _counts(docs: DataFrame, text: str, max_docs: int) -> np.ndarray:
    """How often each bigram occurs in the values of base spans (0) and in the identifiers outside them (1)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, N * N), dtype=np.int64)
        for frame in frames:
            for t in frame["t"]:
                spans = base_spans(t)
                for start, kind, end in spans:
                    value = ASSIGN.match(t, start)[1] if kind == "assign" else t[start:end]
                    for run in re.findall(r"[A-Za-z0-9+/_-]{12,}", value):
                        np.add.at(seen[0], bigrams(run), 1)
                words = {t[m.start() : m.end()] for m in IDENTIFIER.finditer(t) if not any(s < m.end() and m.start() < e for s, _, e in spans)}
                if words:
                    np.add.at(seen[1], np.concatenate([bigrams(w) for w in words]), 1)
        kind, pair = np.nonzero(seen)
        yield pd.DataFrame({"kind": kind, "pair": pair, "n": seen[kind, pair]})

    rows = sampled(docs.filter(F.length(text) > 0), max_docs).select(F.col(text).alias("t"))
    counts = np.zeros((2, N, N))
    for kind, pair, n in rows.mapInPandas(count, "kind long, pair long, n long").groupBy("kind", "pair").agg(F.sum("n")).collect():
        counts[kind, pair // N, pair % N] = n  # 2 * 67 * 67 rows at most
    return counts


def _log(counts: np.ndarray) -> np.ndarray:
    """The log-likelihood of each bigram after its first character."""
    smooth = counts.reshape(N, N) + 0.5
    return np.log(smooth / smooth.sum(axis=1, keepdims=True)).ravel()


def fit(docs: DataFrame, text: str = "text", max_docs: int = 40_000) -> np.ndarray:
    """The log-likelihood ratio of each bigram (random over ordinary) by the labels of a table alone, from about max_docs rows chosen by a hash of the whole row."""
    random, ordinary = _counts(docs, text, max_docs)
    return _log(random) - _log(ordinary)


def fit_alphabets(docs: DataFrame, text: str = "text", max_docs: int = 40_000, samples: int = SAMPLES) -> np.ndarray:
    """The log-likelihood ratios of each bigram, a row for the values found in the table and one for each alphabet of MADE.

    Ordinary identifiers count as they stand and in capitals, so that words in capitals are as ordinary as others.
    """
    found, ordinary = _counts(docs, text, max_docs)
    if not ordinary.any():
        return np.zeros((1, N * N))
    capital = np.arange(N)
    capital[26:52] -= 26
    both = ordinary.copy()
    np.add.at(both, (capital[:, None], capital[None, :]), ordinary)
    random = [np.bincount(np.concatenate([bigrams(s) for s in made_strings(a, samples, "labelled")]), minlength=N * N) for a in MADE.values()]
    return np.array([_log(x) for x in (found, *random)]) - _log(both)


def scan(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", min_total: float = 24.0, min_mean: float = 0.9) -> DataFrame:
    """One row a document: key, kinds, starts, ends (arrays, ordered) and the log-likelihood ratio of the markov spans in `ratios`.

    ratio: what `fit` or `fit_alphabets` learned; of several rows the largest sum counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            column = texts(batch, "t")
            kinds, starts, ends, ratios = ([[] for _ in range(len(column))] for _ in range(4))
            for i in np.flatnonzero(pc.match_substring_regex(column, ANY).to_numpy(zero_copy_only=False)):
                for start, kind, end, r in sorted(_spans(column[i].as_py(), ratio, min_total, min_mean), key=lambda x: (x[0], KINDS.index(x[1]))):
                    kinds[i].append(kind), starts[i].append(start), ends[i].append(end), ratios[i].append(r)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(ratios, pa.list_(pa.float64()))], names=[key, "kinds", "starts", "ends", "ratios"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, kinds array<string>, starts array<int>, ends array<int>, ratios array<double>")


def _spans(text: str, ratio: np.ndarray, min_total: float, min_mean: float) -> list[tuple[int, str, int, float | None]]:
    base = base_spans(text)
    found: list[tuple[int, str, int, float | None]] = [(*x, None) for x in base]
    for m in RUN.finditer(text):
        for s, e in _uncovered(*m.span(), base):
            pairs = bigrams(text[s:e])
            total = max(float(row[pairs].sum()) for row in np.atleast_2d(ratio))
            if total >= least_ratio(e - s, min_total, min_mean):
                found.append((s, "markov", e, total))
    return found


def _uncovered(start: int, end: int, base: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """The parts of a run of LEAST or more characters outside the base spans."""
    parts, at = [], start
    for b, _, f in base:
        if at < f and b < end:
            parts.append((at, b))
            at = max(at, f)
    return [(s, e) for s, e in [*parts, (at, end)] if e - s >= LEAST]


def least_ratio(length: int, min_total: float, min_mean: float) -> float:
    """The ratio that a run needs: min_mean a character, min_total at least."""
    return max(min_total, min_mean * length)


def digest(kinds: list[str], starts: list[int], ends: list[int]) -> str:
    """sha256 of the spans as text, as the query returns it for the base ones."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in zip(kinds, starts, ends, strict=True)).encode()).hexdigest()
