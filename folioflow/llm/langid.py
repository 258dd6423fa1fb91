"""Language identification by compression.

Each language has a raw-content dictionary for zstandard: the runs of up to RUN non-space characters that most of its training
documents hold, rarest first (matches near the end are cheapest); so texts without spaces are learned from like others. A text is cut
into blocks, each block is compressed once with every dictionary, and the language whose blocks are smallest in sum wins. Where the
runner-up is nearly as small, the answer is marked as rejected.

Cases: a null text, an empty one and one without letters (characters that str.isalpha calls so) are `und` with score 0; equal sizes go
to the language with more training documents, then to the smaller name; without training rows every text is `und`; repeated rows get
equal answers; a text of any length is compressed whole, block by block; an empty table gives no rows; columns of the input named like
an added one are replaced, all others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, sampled, slices, texts

UNDETERMINED = "und"
#: Longer words are cut into runs of this length.
RUN = 40


@dataclass(frozen=True)
class LanguageModel:
    """Languages, most frequent in training first, and the dictionary of each."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = 20_000, max_words: int = 9_000, dict_bytes: int = 65_536) -> LanguageModel:
    """Learns from about max_docs labelled rows (chosen by a hash of the whole row), max_words words and dict_bytes bytes a language at most."""
    scratch = Scratch(docs.sparkSession)
    rows = sampled(docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()), max_docs).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    runs = rows.select("l", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(rf"\S{{1,{RUN}}}"), F.lit(0)))).alias("w"))
    counts = scratch.park(runs.groupBy("l", "w").agg(F.count("*").alias("n")))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    found: dict[str, list[tuple[int, str]]] = {name: [] for name in sorted(sizes, key=lambda x: (-sizes[x], x))}
    if found:
        for r in _most(counts, max_words).collect():
            found[r["l"]].append((-r["n"], r["w"]))
    scratch.drop(counts)
    return LanguageModel(tuple(found), tuple(_dictionary([w for _, w in sorted(ws)], dict_bytes) for ws in found.values()))


def _most(counts: DataFrame, limit: int) -> DataFrame:
    """Rows (l, w, n) of about `limit` words a language that most documents hold; of those that tie for the last places a share by hash.

    How many words have which count tells where to cut, so no language's words have to be ranked in one task.
    """
    cuts, left = {}, {}
    for r in sorted(counts.groupBy("l", "n").agg(F.count("*").alias("words")).collect(), key=lambda r: (r["l"], -r["n"])):
        room = left.setdefault(r["l"], limit)
        if room > 0:
            cuts[r["l"]] = (r["n"], min(1.0, room / r["words"]))
        left[r["l"]] = room - r["words"]
    known = counts.sparkSession.createDataFrame([(name, n, share) for name, (n, share) in cuts.items()], "l string, cut long, share double")
    drawn = F.pmod(F.xxhash64("w"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    return counts.join(F.broadcast(known), "l").filter((F.col("n") > F.col("cut")) | ((F.col("n") == F.col("cut")) & drawn)).select("l", "w", "n")


def _dictionary(words: list[str], limit: int) -> bytes:
    kept, size = [], 0
    for w in words:
        size += len(w.encode()) + 1
        if size > limit:
            break
        kept.append(w)
    return (" ".join(reversed(kept)) + " ").encode()


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", level: int = 9, block_bytes: int = 2048, min_margin: float = 0.02) -> DataFrame:
    """Adds lang_pred, score (0 to 1), margin (how much larger the runner-up is, as a share) and rejected (margin below min_margin)."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = {f.name for f in added}
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        for content in model.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        for batch in slices(batches, text):
            rows = [_answer(t, coders, model.languages, block_bytes) for t in texts(batch, text).to_pylist()]
            lang, score, margin = zip(*rows, strict=True)
            margin = np.array(margin)
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin), pa.array(margin < min_margin)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in added)])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))


def _answer(text: str, coders: list, languages: tuple[str, ...], block: int) -> tuple[str, float, float]:
    if not coders or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0
    data = text.lower().encode("utf-8", "replace")
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    sizes = [sum(len(c(b)) for b in blocks) for c in coders]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = [s - sizes[best] for i, s in enumerate(sizes) if i != best]
    score = 1 / (1 + sum(math.exp(-0.35 * d / math.sqrt(len(blocks))) for d in rest))
    return languages[best], score, min(rest, default=sizes[best]) / sizes[best]
