"""Quality rules in a bitmask ledger, by DataFrame functions alone.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each failed rule; a policy is a
named and versioned mask of rules that reject. Applying another policy, or asking what each rule alone costs (ablation), reads the
bits and never the texts again.

Cases: a null or empty text has no words and measures 0 throughout; ratios over nothing are 0; very long texts are sorted within
their own row, n log n; repeated rows get equal rows; other columns pass through, and those named like a measurement are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window; a window found twice or more in a text is a repetition.
WINDOW = 5


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    names = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"}
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in names])
    words, lines, windows, ordered, at = (spare(docs, c) for c in ("words", "lines", "windows", "ordered", "at"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.withColumns({
        words: F.filter(F.split(t, SPACE + "+"), lambda w: w != ""),
        lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
    })
    found = found.withColumns({
        "n_words": F.size(words).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        windows: F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>")),
    })
    # Most texts repeat no window, which a set of hashes tells; only the others sort their windows.
    found = found.withColumn(ordered, F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.coalesce(F.get(ordered, a)["h"] == F.get(ordered, b)["h"], F.lit(False))
    repeated = F.filter(ordered, lambda x, k: F.when(k > 0, same(k, k - 1)).otherwise(F.lit(False)) | same(k, k + 1))
    found = found.withColumn(at, F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(F.transform(at, lambda i, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), i - F.get(at, k - 1)))), F.lit(0), lambda a, x: a + x)
    found = found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # One entry for each text, unnested: a filter on measurements then stays above, and isn't expanded into the expressions below.
    entry = F.array(F.struct(*sorted(names)))
    return found.select(*[f"`{c}`" for c in docs.columns], F.inline(entry))


@dataclass(frozen=True)
class Rule:
    """A rule's place in the ledger is its bit for good; `fails` is an SQL condition over measurements."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", 4, "n_words >= 10 AND word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
)

#: Versions of policies: the names of the rules that reject. A published version never changes.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("web", 1): ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(policy: tuple[str, int], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return reduce(int.__or__, (bits[name] for name in POLICIES[policy]), 0)


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with measurements and fail_bits, one bit for each rule that fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules]
    return measured(docs, text).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0)).cast("long"))


def passes(policy: tuple[str, int], bits: Column | None = None) -> Column:
    """True where the policy keeps the document."""
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(kept_ledger: DataFrame, policy: tuple[str, int], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, n_failed, n_only (documents that the policy would keep without this rule), from one count for each pattern of bits."""
    patterns = kept_ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    named = [r for r in rules if r.name in POLICIES[policy]]
    pairs = patterns.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in named])).alias("r")).select("bits", "n", "r.rule", "r.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return pairs.groupBy("rule").agg(F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
