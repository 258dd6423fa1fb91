"""Conversation trie, benchmark decontamination and vector codes, each compared with brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, turn_trie, vector_codes
from folioflow.llm import queries as Q

TURNS = "conv_id long, turn long, role string, text string, key string, ids string"


def naive_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(hashlib.md5(role.encode()).hexdigest().encode() + b":" + text.encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            below[node[:d]][0] += not children[node]
            below[node[:d]][1] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], *below[n], hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == n).encode()).hexdigest())
        for n, m in members.items()
    )


def trie(spark, turns, shard_turns=turn_trie.SHARD_TURNS):
    convs = turn_trie.sequences(spark.createDataFrame(turns, TURNS))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    out = turn_trie.nodes(turn_trie.with_heads(convs, F.col("conv_id") - F.col("conv_id") % 5, head, 8), shard_turns).collect()
    return sorted((x[0], x[1], -1 if x[2] is None else x[2], *x[3:]) for x in out)


@pytest.mark.parametrize("shard_turns", [1, 7, 200_000])
def test_trie_equals_brute_force_whatever_the_shards(spark, shard_turns):
    draw = random.Random(3)
    turns = []
    for c in range(-7, 60):
        hot = c % 3 == 0  # a third of all conversations are the same
        for t in range(0 if c in (8, 9) else 12 if hot else draw.randrange(1, 12)):
            role, text = ("user", f"héllo {t}") if hot else (draw.choice(["user", "bot", None]), draw.choice(["a", "b", "", None, "ü" * 300]))
            turns.append((c, draw.choice([t, t, None, 4]), role, text, "x", "y"))
    turns += turns[:5] + [(None, 1, "user", "no conversation", "x", "y"), (7, 0, "", None, None, None), (1000, None, None, None, None, None)]
    assert trie(spark, turns, shard_turns) == naive_trie(turns)


def test_trie_of_a_hot_conversation_over_many_ranges_and_of_none(spark):
    turns = [(c, t, "user", f"{t}", "", "") for c in range(0, 400) for t in range(10, 13)] + [(c, 0, "user", "only", "", "") for c in range(500, 520)]
    assert trie(spark, turns, 5) == naive_trie(turns)
    assert trie(spark, []) == []


def test_ternary_search_tree_is_balanced_and_traversed_in_order():
    coded = [[i, j] for i in range(31) for j in range(2)]
    tree = turn_trie.build(coded, [[1, 1]] * len(coded))
    order = tree.order()
    assert [tree.turn[x] for x in order if tree.depth[x] == 1] == list(range(31)) and len(order) == 1 + 31 * 3

    def height(x):
        return 1 + max(height(tree.lo[x]), height(tree.hi[x])) if x else 0

    assert height(tree.eq[0]) <= 6


def naive_words(text):
    return [(m.group(), m.start(), m.end()) for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]


def naive_scan(docs, items, n):
    windows = defaultdict(set)
    for item, text in items:
        w = [x[0] for x in naive_words(text)]
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        w = naive_words(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(x[0] for x in w[i : i + size]))
                if got is not None:
                    hit |= set(range(i, i + size))
                    found |= got
        kept, at = [], 0
        for i in sorted(hit):
            if i - 1 not in hit:
                kept.append((text or "")[at : w[i][1]])
            at = w[i][2]
        kept.append((text or "")[at:])
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None), "".join(kept) if text is not None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, block_bytes):
    draw = random.Random(5)
    vocabulary = ["alpha", "Beta", "gämma", "δ", "7", "x y", "\u0085", "omega", "Ä", "z"]
    some = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    items = [(i, some(draw.choice([1, 2, 4, 5, 9, 30]))) for i in range(40, 70)]
    items = [x for x in items if len(naive_words(x[1])) > 1]
    items += [(3, None), (4, "!?"), (None, "alpha alpha 7 7 alpha z z"), items[0], (items[1][0], some(6)), (2000, "ALPHA--7,omega.Beta\tz")]
    docs = [(i, some(draw.choice([0, 1, 3, 40, 120]))) for i in range(120)] + [(7, None), (8, ""), (None, items[0][1]), (9, "x " * 50_000 + items[2][1]), (9, "..." + items[2][1].upper() + "!")]
    made = spark.createDataFrame([(d, t, 1, "old") for d, t in docs], "doc_id long, text string, Hits int, n_words string")
    out = decontaminate.scan(made, spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string"), n=4, block_bytes=block_bytes)
    assert out.columns == ["doc_id", "text", "Hits", "n_words", "_n_words", "_hits", "spans", "items"]
    got = out.select("doc_id", "_n_words", decontaminate.n_hit(F.col("_hits")), "items", decontaminate.without_spans(F.col("text"), F.col("spans")).alias("kept"), "Hits", "n_words").collect()
    assert all(x["Hits"] == 1 and x["n_words"] == "old" for x in got)
    assert sorted([tuple(x)[:5] for x in got], key=repr) == naive_scan(docs, items, 4)
    assert decontaminate.without_documents(out, "_hits").count() == sum(not x[2] for x in naive_scan(docs, items, 4))


def test_decontamination_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(x) for x in decontaminate.scan(docs, none).collect()] == [(1, "a b c", 3, [], [], [])]
    assert decontaminate.scan(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def naive_codes(rows, parts, entries, rounds):
    kept = sorted(((k, [int(np.floor(256 * float(x))) for x in v]) for k, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min((far(v[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p][1] == i]
                if own:
                    books[p][i] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((k, [i for _, i in f], sum(d for d, _ in f)) for (k, _), f in zip(kept, near())), key=repr), books


def test_vector_codes_equal_brute_force(spark, monkeypatch):
    draw = random.Random(9)
    value = lambda: draw.choice([draw.uniform(-1, 1), 0.5, -0.25, 0.0])
    rows = [(i, [value() for _ in range(8)], draw.choice([1, 2, None, 3])) for i in range(300)]
    rows += [(i, [0.5] * 8, 1) for i in range(300, 460)]  # a very common vector
    rows += [(3, rows[0][1], 2), (None, [0.1] * 8, None), (500, None, 1), (501, [None] + [0.0] * 7, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] + [0.0] * 7, 1), (504, [], 1), (505, [0.0] * 7, 1), (506, [0.0] * 12, 1)]
    expected, books = naive_codes([r for r in rows if r[0] is None or r[0] < 500], 4, 9, 2)
    made = spark.createDataFrame([(*r, "kept") for r in rows], "vec_id long, embedding array<float>, label int, error_of string").repartition(5)
    kept, length = vector_codes.prepared(made, "vec_id", "embedding", "ints", parts=4, scale=256)
    fitted = vector_codes.fit(kept, "vec_id", "ints", length, parts=4, entries=9, rounds=2)
    assert length == 8
    coded = vector_codes.encode(kept, "ints", fitted)
    # floats are read as 32 bits, so brute force takes them from there
    got = sorted(((x["vec_id"], x["codes"], x["error"]) for x in coded.collect()), key=repr)
    as_float = [(k, [None if v is None else float(np.float32(v)) for v in vs] if vs else vs, lab) for k, vs, lab in rows if k is None or k < 500]
    expected, books = naive_codes(as_float, 4, 9, 2)
    assert got == expected and fitted.values.tolist() == books
    for most in (100, 1):
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", most)
        summed = vector_codes.with_label_sums(coded.select("vec_id", "label", "error"), "label", "error", "sum").collect()
        totals = defaultdict(int)
        for x in summed:
            totals[x["label"]] += x["error"]
        assert len(summed) == len(got) and all(x["sum"] == totals[x["label"]] for x in summed)


def test_vector_codes_of_few_vectors_and_none(spark):
    few = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    kept, length = vector_codes.prepared(few, "vec_id", "embedding", "ints", parts=2, scale=256)
    books = vector_codes.fit(kept, "vec_id", "ints", length, parts=2, entries=64, rounds=2)
    assert sorted((x["vec_id"], x["codes"], x["error"]) for x in vector_codes.encode(kept, "ints", books).collect()) == [(1, [0, 0], 0), (2, [0, 0], 0)]
    kept, length = vector_codes.prepared(few.limit(0), "vec_id", "embedding", "ints", parts=2, scale=256)
    books = vector_codes.fit(kept, "vec_id", "ints", length, parts=2, entries=64, rounds=2)
    assert vector_codes.encode(kept, "ints", books).count() == 0
    large = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    kept, length = vector_codes.prepared(large, "vec_id", "embedding", "ints", parts=2, scale=256)
    with pytest.raises(OverflowError):
        vector_codes.fit(kept, "vec_id", "ints", length, parts=2, entries=64, rounds=2)


def test_registered_queries_have_their_sql():
    for name in ("op11_conversation_trie", "op12_benchmark_leaks", "op13_vector_codes"):
        assert name in Q.queries() and name in Q.SQL


def test_memo_is_bounded_by_bytes_and_makes_long_words_anew():
    from folioflow.llm.words import Memo

    made = []
    memo = Memo(lambda ws: made.extend(ws) or [w.encode() for w in ws], most=40, longest=20)
    assert memo(["a" * 15, "b" * 15, "c" * 30]) == [b"a" * 15, b"b" * 15, b"c" * 30]
    assert memo(["a" * 15, "c" * 30]) == [b"a" * 15, b"c" * 30] and made.count("a" * 15) == 1 and made.count("c" * 30) == 2
    memo(["d"])
    memo(["e" * 20, "f" * 20]), memo(["g"]), memo(["a" * 15])
    assert len(memo.known) <= 2


def test_shares_that_are_drawn(spark):
    from folioflow.llm import mixing

    docs = spark.createDataFrame([(10, [0.5, 0.5], 2), (20, [1.0, 0.0], 0), (30, [0.0, 1.0], 1), (5, [1.0, 0.0], None)], "n_tokens long, p array<double>, copies int")
    assert mixing.realised(docs, 2) == (10 / 50, 40 / 50) and mixing.realised(docs.limit(0), 2) == (0.0, 0.0)
