"""The stages of the corpus pipeline against brute force, on null ids, repeated rows, ties and empty tables."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

import corpus_pipeline as P
from folioflow.llm import pieces, queries

from .test_operators import naive_cut, nearest_rates

WORDS = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "su") for b in ("ten", "vol", "kar", "pin") for c in ("a", "es", "or")]
LINE = "this line stands in three documents of the corpus"


def prose(n):
    drawn = random.Random(n).choices(WORDS, k=40)
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(drawn))


ROWS = [
    (1, prose(1)), (1, prose(1)), (2, prose(2)), (3, prose(2)), (None, prose(2)), (None, prose(3)), (None, prose(3)), (None, prose(4)),
    (5, prose(5)), (5, prose(6)), (6, prose(5)), (7, prose(7) + "\n" + LINE), (8, prose(8) + "\n" + LINE), (9, prose(9) + "\n" + LINE), (10, None), (11, ""), (11, ""), (None, ""), (12, prose(12)), (12, prose(12) + " more"),
]
TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def full(rows):
    return [(k, t, "en", "web", len(t or "")) for k, t in rows]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_near(rows):
    rows = list(dict.fromkeys(rows))
    classes = [{i} for i in range(len(rows))]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            x, y = shingles(a[1]), shingles(b[1])
            if x and y and 10 * len(x & y) >= 8 * len(x | y):
                one, two = (next(c for c in classes if k in c) for k in (i, j))
                if one is not two:
                    classes.remove(two)
                    one |= two
    return [[rows[i] for i in c if (rows[i][0] is None, rows[i][0] or 0) == min((rows[k][0] is None, rows[k][0] or 0) for k in c)] for c in classes]


def stage(spark, name, rows, sf=""):
    return [tuple(r) for r in dict(P.STAGES)[name](spark, spark.createDataFrame(rows, TYPES).repartition(3), sf).collect()]


def brute_rules(text):
    """Whether a text breaks a rule of the policy, by counting."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {g for g, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, g in enumerate(windows) if g in often for k in range(5)}
    chars, symbols, again = sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    return len(w) < 10 or 100 * len(repeated) > 20 * len(w) or 10 * symbols > len(w) or (len(lines) >= 4 and 100 * again > 30 * len(lines)) or not 2 * len(w) <= chars <= 20 * len(w)


def brute_lines(rows):
    holders = defaultdict(set)
    keys = lambda t: [(line, re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))) for line in (t or "").split("\n")]
    for r in rows:
        for _, k in keys(r[1]):
            holders[k].add(r[0])
    gone = lambda k, doc: len(k) >= 20 and len(holders[k]) >= 3 and doc != max(d for d in holders[k] if d is not None)
    texts = ["\n".join(line for line, k in keys(r[1]) if not gone(k, r[0])) for r in rows]
    return [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, texts)]


def brute_copies(doc_id, rate):
    h = xxhash.xxh64_intdigest(b"mix", 42)
    h = h if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    return int(rate) + (h % (1 << 24) < (rate - int(rate)) * (1 << 24))


def brute_pieces(library, doc_id, text):
    h = xxhash.xxh64_intdigest(struct.pack("<i", 17), 42)
    h = h if doc_id is None else xxhash.xxh64_intdigest(str(doc_id).encode(), h)
    units = [u for u in pieces.UNIT.findall(" " + text) if u]
    keys = pieces.occurrences(np.full(len(units), h, dtype=np.uint64).view(np.int64), np.arange(len(units))).tolist()
    return [x for u, k in zip(units, keys) for x in naive_cut(library, u, k, 0.1)]


POOR = [
    (20, "a b c d e f g h i j k l m"), (21, "# * $ % & words among # * $ % & symbols stay few here"), (22, "\n".join(["one line"] * 4 + ["and another line of it"] * 2)), (23, "x" * 900 + " " + prose(23)),
    (24, prose(24) + " " + prose(24)), (25, " \t\x0b" + prose(25) + "\u3000\n\n"), (26, "w" * 3_000_000), (None, prose(27)), (28, " ".join(prose(1000 + i) for i in range(400))), (29, "nine words are not enough for the first rule"),
]


def test_quality_rules_stage_equals_brute_force_and_leaves_other_columns_out(spark):
    rows = full(ROWS + POOR)
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], TYPES + ", _words string, fail_bits int").repartition(3)
    got = P.quality_rules_stage(spark, odd, "")
    assert got.columns == list(P.COLUMNS) and Counter(map(tuple, got.collect())) == Counter(r for r in rows if not brute_rules(r[1]))
    assert {20, 21, 22, 24, 26, 29} & {r[0] for r in got.collect()} == set() and {25, 28} <= {r[0] for r in got.collect()}


RUDE = [f"{a}{b}" for a in ("gru", "bla", "zot") for b in ("mpf", "ck", "rgh")]


def toxic_rows(spark, folder):
    """Documents of which a third is labelled toxic, far above the target, and their table of labels."""
    rows = [(i, (prose(i + 100) if i % 3 else " ".join(random.Random(i).choices(RUDE, k=35)) + f" end{i}") + f" number{i}") for i in range(90)] + [(None, prose(300)), (95, None), (96, "")]
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(None, 1, 0), (89, None, None)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return full(rows)


def test_mixing_stage_equals_brute_force(spark, tmp_path):
    rows = toxic_rows(spark, tmp_path)
    docs = spark.createDataFrame(rows, TYPES).repartition(3).cache()
    rated, names, mix = queries.mixed(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), P.DOMAIN, P.MIX, P.COLUMNS)
    found = rated.collect()
    t, p = np.array([float(r.n_tokens) for r in found]), np.array([r.p for r in found])
    assert mix.met and names == ("clean", "toxic")
    assert np.allclose([r.rate for r in found], nearest_rates(t, p, np.array([P.MIX[n] for n in names]) * t.sum()), atol=2e-2)
    want = Counter({tuple(r[c] for c in P.COLUMNS): brute_copies(r.doc_id, r.rate) for r in found})
    assert Counter(map(tuple, P.mixing_stage(spark, docs, str(tmp_path)).collect())) == +want
    docs.unpersist()


def test_pieces_stage_equals_brute_force(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    rows = full([(1, prose(1)[:90]), (1, prose(1)[:90]), (None, "no id  here\n"), (3, None), (4, ""), (5, "\u65e5\u672c don't ▁ Zz")])
    got = P.pieces_stage(spark, spark.createDataFrame(rows, TYPES).repartition(3), "").collect()
    have = Counter((r.doc_id, tuple(r.piece_ids), r.n_pieces, r.ids_crc32, r.decoded_equal) for r in got)
    ids = [(r[0], brute_pieces(library, r[0], r[1] or "") if r[1] else []) for r in rows]
    assert have == Counter((k, tuple(x), len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes()), True) for k, x in ids)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = [*toxic_rows(spark, tmp_path), *full([(200 + i, prose(200 + i) + "\n" + LINE) for i in range(4)] + [(300, prose(201) + " tail"), (301, "too short")])]
    spark.createDataFrame(rows, TYPES).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute_lines([r for r in rows if not brute_rules(r[1])])
    kept = [c[0] for c in brute_near(kept)]  # no two of these rows have one doc_id
    assert 300 not in {r[0] for r in kept} and sum(LINE in r[1] for r in kept) == 1
    found = queries.mixed(spark.createDataFrame(kept, TYPES), spark.read.parquet(f"{tmp_path}/labels.parquet"), P.DOMAIN, P.MIX, P.COLUMNS)[0].collect()
    want = Counter({(r.doc_id, len(r.text)): brute_copies(r.doc_id, r.rate) for r in found})
    size = {r[0]: len(r[1]) for r in kept}
    got = P.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, size[r.doc_id]) for r in got) == +want and all(r.decoded_equal and r.n_pieces == len(r.piece_ids) > 0 for r in got)


def test_near_duplicates_stage_keeps_one_row_of_each_class(spark):
    got, classes = Counter(stage(spark, "near_duplicates", full(ROWS))), brute_near(full(ROWS))
    assert sum(got.values()) == len(classes) and all(sum(got[r] for r in c) == 1 for c in classes)
    assert sum(n for r, n in got.items() if r[0] is None) == 3


def test_near_duplicates_stage_returns_a_small_plan(spark, capsys):
    frame = P.near_duplicates_stage(spark, spark.createDataFrame(full(ROWS), TYPES).repartition(3), "")
    capsys.readouterr()
    frame.explain()
    plan = capsys.readouterr().out
    assert 0 < plan.count("Exchange") <= 8 and plan.count("Scan parquet") <= 2  # the rows, those that clash and those that stay


def test_line_dedup_stage(spark):
    got = {r[0]: r for r in stage(spark, "line_dedup", full(ROWS)) if r[0] in (7, 8, 9)}
    assert [LINE in got[k][1] for k in (7, 8, 9)] == [False, False, True] and all(len(r[1]) == r[4] for r in got.values())


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], TYPES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_rows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    rows = full([(i, prose(i)) for i in range(6)] + [(0, prose(0))])
    real = P.F.xxhash64

    def clashing(*columns):  # the first hash of every row is the same
        return P.F.lit(7).cast("long") if len(columns) > 2 and "row" in str(columns[0]) else real(*columns)

    with monkeypatch.context() as m:
        m.setattr(P.F, "xxhash64", clashing)
        frame = P.numbered(spark.createDataFrame(rows, TYPES).repartition(2))
    got = frame.select("row", "doc_id").collect()
    assert len(got) == 7 and len({r.row for r in got}) == 6 and len({r.row for r in got if r.doc_id == 0}) == 1
