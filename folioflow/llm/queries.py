"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express.

Each applies one operator with its production parameters to its whole table and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, line_dedup, mixing, pieces, quality_model, quality_rules, secrets, token_files, topk, turn_trie, vector_codes
from .common import Scratch, held_out, park, table

#: The installed package that holds public vocabulary files; a path may be given instead.
TOKENIZERS = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    from importlib import import_module

    return import_module(TOKENIZERS).path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit_alphabets(docs))
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")))
    base = F.filter(spans, lambda x: ~x.startswith("markov:"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"), F.array_max("ratios").alias("best_ratio"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read(token_files.write(docs, tokenizer_path("word_bpe_49k.json"), end_id=2))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=90, den=100)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.lit(quality_rules.mask(("base", 1))).cast("long")
    failed = F.col("fail_bits").bitwiseAND(base) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & quality_rules.passes(("web", 1))).alias("kept"), "fail_bits")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the policy `web`: documents that fail it, and those that it alone keeps out."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), ("web", 1))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = park(quality_model.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_model.fit(stats.join(labels, "doc_id").filter(~held_out(F.col("doc_id"))))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


#: Domains of the labelled table, and the share of expected tokens that each shall have.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END"
MIX = {"good": 0.97, "poor": 0.025, "toxic": 0.005}


def mixed(docs: DataFrame, labels: DataFrame, domain: str, weights: dict[str, float], keep: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...], mixing.Mix]:
    """The columns of docs in `keep` with n_tokens, p (by domain, in the order that is returned) and rate."""
    scratch = Scratch(docs.sparkSession)
    model, names = mixing.fit_posteriors(mixing.labelled_rows(docs, labels.select("doc_id", F.expr(domain).alias("domain")), scratch))
    found = scratch.park(mixing.posteriors(docs, model, names).select(*keep, "n_tokens", "p"))
    scratch.keep(found)
    mix = mixing.fit_rates(found.select("n_tokens", "p"), tuple(weights.get(n, 0.0) for n in names))
    return found.withColumn("rate", mix.rate(F.col("p"))), names, mix


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the row's likeliest domain: `target_met`, whether its expected tokens are within 0.1 % of the target, and the shares of tokens that
    are wanted, expected and drawn (after rates are rounded to copies)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated, names, mix = mixed(docs, table(spark, sf_dir, "labels"), DOMAIN, MIX, ("doc_id",))
    rated = rated.withColumn("copies", mixing.copies(F.col("rate"), F.col("doc_id")))
    best = F.array_max(F.transform("p", lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))["i"]
    met = [abs(e - t) <= 1e-3 * t for e, t in zip(mix.expected, mix.targets, strict=True)]
    listed = lambda xs: F.get(F.array(*map(F.lit, xs)), -best)
    share = lambda xs: listed([x / (sum(xs) or 1.0) for x in xs])
    shares = [share(mix.targets).alias("target_share"), share(mix.expected).alias("expected_share"), share(mixing.realised(rated, len(names))).alias("drawn_share")]
    return rated.select("doc_id", "n_tokens", listed(names).alias("domain"), *[F.get("p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(names)], "rate", "copies", listed(met).alias("target_met"), *shares)


def op10_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = turn_trie.sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    return turn_trie.nodes(turn_trie.with_heads(convs, F.col("conv_id") - F.col("conv_id") % 5, head, 8))


def op12_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontaminate.n_hit(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows, length = vector_codes.prepared(vectors, "vec_id", "embedding", "ints", parts=16, scale=256)
    rows = Scratch(spark).park(rows.select("vec_id", "label", "ints"))
    books = vector_codes.fit(rows, "vec_id", "ints", length, parts=16, entries=64, rounds=2)
    coded = park(vector_codes.encode(rows, "ints", books).select("vec_id", "label", F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"), "error"))
    summed = vector_codes.with_label_sums(coded, "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_language_id, op2_secret_scan, op3_exact_topk, op4_token_files, op5_ngram_jaccard, op6_quality_rules, op7_line_dedup, op8_quality_score, op9_mix_sources, op10_piece_dropout, op11_conversation_trie, op12_benchmark_leaks, op13_vector_codes, rule_ablations, pipeline)
    return {f.__name__: f for f in named}


def _lloyd(n: int, last: bool) -> str:
    """SQL of one assignment with the entries c{n}, and of the entries that follow."""
    near = f"""
        a{n} AS (SELECT vec_id, r, p, x, e, err FROM (
            SELECT v.vec_id, v.r, v.p, v.x, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS err FROM v JOIN c{n} c ON c.p = v.p)
            QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY err, e) = 1)"""
    return near if last else near + f""",
        m{n} AS (SELECT p, e, list(s ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS s FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY p, e, i) GROUP BY p, e),
        c{n + 1} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.p = c.p AND m.e = c.e)"""


VECTOR_CODES_SQL = f"""
        WITH w AS (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS (SELECT vec_id, r, p, w[p * len(w) // 16 + 1:(p + 1) * len(w) // 16] AS x FROM (SELECT vec_id, r, w, unnest(range(0, 16)) AS p FROM w)),
        c0 AS (SELECT p, r - 1 AS e, x FROM v WHERE r <= 64),{_lloyd(0, False)},{_lloyd(1, False)},{_lloyd(2, True)},
        o AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(err) AS BIGINT) AS error FROM a2 GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
        FROM o JOIN w USING (r)"""

SQL = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    "op5_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
                 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.node = l.a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM s JOIN (SELECT id, min(node) AS component_id FROM reach GROUP BY id) r ON r.id = s.doc_id""",
    "op6_quality_rules": r"""
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
        m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                     CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
        b AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
                     + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
                     + CASE WHEN n_words >= 10 AND word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b""",
    "op7_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, u.i, u.line, translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'line': x})) AS u FROM documents)),
        c AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INTEGER) >= 3),
        m AS (SELECT l.*, c.top IS NOT NULL AND doc_id IS DISTINCT FROM c.top AS gone FROM l LEFT JOIN c ON l.k = c.k)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op11_conversation_trie": r"""
        WITH t AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || ':' || coalesce(text, ''))) AS w
                   FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        crc AS (SELECT c, w, xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda x, y:
                    list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(x, y)), 4294967295)) % 9 AS h FROM t),
        v AS (SELECT a.c, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w FROM crc a LEFT JOIN t b ON b.c = a.c - a.c % 5),
        p AS (SELECT c, d, w[1:d] AS p, len(w) AS n FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM v)),
        g AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY p, d),
        k AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
        s AS (SELECT g.p, g.d, (g.n_convs - 1) * CASE WHEN g.d = 0 THEN 0 ELSE strlen(g.p[g.d].t) END AS saved, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf FROM g LEFT JOIN k ON k.p = g.p),
        u AS (SELECT p[1:j] AS p, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT p, saved, leaf, unnest(range(0, d + 1)) AS j FROM s) GROUP BY 1)
        SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, CASE WHEN g.d > 0 THEN up.conv_id END AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
               CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, g.ends_sha256
        FROM g JOIN u ON u.p = g.p LEFT JOIN k ON k.p = g.p LEFT JOIN g up ON up.p = g.p[1:g.d - 1] AND up.d = g.d - 1""",
    "op12_benchmark_leaks": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw))),
        m AS (SELECT dw.r, dw.l, dw.i, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
        h AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT DISTINCT r, i, unnest(range(0, l)) AS k FROM m) GROUP BY r),
        n AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items, sha256(coalesce(n.x, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)""",
    "op13_vector_codes": VECTOR_CODES_SQL,
}

SQL["rule_ablations"] = f"""WITH x AS ({SQL["op6_quality_rules"]}) SELECT rule, CAST(count(*) FILTER (WHERE fail_bits & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (WHERE fail_bits = bit) AS BIGINT) AS n_only
        FROM x, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32)) r(rule, bit) GROUP BY rule"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
