"""The models of random strings without scaling: what they find of each alphabet and length, what they leave, and the query against a naive search."""

import hashlib

import numpy as np
import pytest

from folioflow.llm import queries, secrets

from .test_operators import naive_secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def halves(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("text is not null")
    return docs.filter("crc32(cast(doc_id as string)) % 2 = 0"), docs.filter("crc32(cast(doc_id as string)) % 2 = 1")


@pytest.fixture(scope="module")
def ratio(halves):
    return secrets.fit_alphabets(halves[0])


def naive_best(text, ratio):
    """The naive search of all rows of ratio, together."""
    return sorted({span for row in ratio for span in naive_secrets(text, row)}, key=lambda x: (x[0], secrets.KINDS.index(x[1])))


def caught(strings, ratio):
    return np.mean([any(kind == "markov" for _, kind, _, _ in secrets._spans(f"see {s} there", ratio, 24.0, 0.9)) for s in strings])


def test_strings_of_every_alphabet_and_length_are_found(ratio):
    assert ratio.shape == (1 + len(secrets.MADE), secrets.N**2)
    for name, alphabet in secrets.MADE.items():
        strings = secrets.made_strings(alphabet, 3_600, "held out")
        for length, least in ((12, 0.75), (16, 0.9), (20, 0.95)):
            some = [s[:length] for s in strings if len(s) >= length][:300]
            some = [s for s in some if not secrets.base_spans(s)]
            assert caught(some, ratio) >= least, (name, length)


def test_ordinary_runs_stay_as_they_stand_and_in_capitals(halves, ratio):
    runs = set()
    for r in halves[1].collect():
        base = secrets.base_spans(r.text)
        runs |= {r.text[s:e] for m in secrets.RUN.finditer(r.text) for s, e in secrets._uncovered(*m.span(), base)}
    assert len(runs) > 500
    assert caught(runs, ratio) == 0 and caught({x.upper() for x in runs}, ratio) == 0
    assert caught(["20240131235959", "2024-01-31-23-59-59", "internationalization", "MAX_CONNECTION_RETRY_COUNT", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "-" * 80, "=" * 80, "1" * 40], ratio) == 0


def test_nothing_ordinary_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "q7Jx0Pz2Lm9Vb4Kd " * 2)], "doc_id long, text string")
    assert not secrets.fit_alphabets(docs.filter("doc_id < 3")).any() and not secrets.fit_alphabets(docs.limit(0)).any()


def test_made_strings_are_the_same_every_time():
    a = secrets.made_strings("ab", 100, "k")
    assert a == secrets.made_strings("ab", 100, "k") != secrets.made_strings("ab", 100, "other")
    assert {len(s) for s in a} == set(range(12, 48)) and set("".join(a)) == {"a", "b"}


def test_the_query_equals_a_naive_search(spark, tmp_path):
    words = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 300")
    made = [secrets.made_strings(a, 40, "planted")[30] for a in secrets.MADE.values()]
    more = [f"key {s} and {s.upper()}, {s}" for s in made] + ['api_key="abcdef" AKIA' + "Z9" * 9, "é " + "0f" * 13 + "Q7jX0pZ2lM9vB4kD", None, "", "token: short"]
    spark_docs = words.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(more, 1)], "doc_id long, text string"))
    spark_docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ratio = secrets.fit_alphabets(docs)
    kinds = set()
    found = {r.doc_id: r for r in queries.op2_secret_scan(spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert found.keys() == texts.keys()
    for k, text in texts.items():
        spans = naive_best(text, ratio)
        named = [f"{kind}:{s}:{e}" for s, kind, e in spans]
        base = ",".join(x for x in named if not x.startswith("markov"))
        kinds |= {kind for _, kind, _ in spans}
        r = found[k]
        assert (r.spans, r.base_sha256) == (",".join(named), hashlib.sha256(base.encode()).hexdigest())
        assert (r.n_assign, r.n_access, r.n_hex, r.n_markov) == tuple(sum(kind == x for _, kind, _ in spans) for x in secrets.KINDS)
    assert kinds == set(secrets.KINDS)
