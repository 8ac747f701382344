"""Quality rules as a ledger: every rule is evaluated once into a failure bit; policies and ablations are bit operations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, whole, words_of

WINDOW = 5
SYMBOLS = r"[^#*$%&|<>]+"

#: Rules by name, in the order of their bits; a rule is true where the document fails.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "capitals": "100 * n_upper > 60 * word_chars",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 30 * n_words)",
}
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols"),
    "v2": (*BASE, "symbols", "repeated_lines", "capitals", "word_length"),
}


def mask(names: tuple[str, ...] | list[str], rules: Mapping[str, object] = RULES) -> int:
    order = list(rules)
    return sum(1 << order.index(n) for n in names)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements of the whole text, by row-local expressions alone: no row leaves its task.

    `n_words`, `word_chars`, `n_symbols`, `n_upper`, `n_lines` (lines with a word), `n_dup_lines` (of these, equal to
    an earlier one) and `n_repeat_words` (words in five-word windows that the text has twice or more). Windows
    are compared by a 64-bit hash. They are sorted only in texts that repeat one, so the cost per text is n log n at most.
    A null text counts as empty: all measurements are zero. Columns of these names are replaced.
    """
    t = whole(text)
    bare = F.regexp_replace(t, GAP, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({"_words": words_of(t), "_bare": bare, "_lines": lines})
    w = F.col("_words")
    n = F.size(w)
    df = df.withColumn(
        "_grams",
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    g = F.col("_grams")
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    df = df.withColumn(
        "_sorted",
        F.when(repeats, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))),
    )
    s = F.col("_sorted")

    def again(x: Column, j: Column) -> Column:
        same = (x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"])
        return F.when(F.coalesce(same, F.lit(False)) | F.coalesce(x["g"] == F.get(s, j + 1)["g"], F.lit(False)), x["i"])

    df = df.withColumn("_at", F.sort_array(F.filter(F.transform(s, again), lambda x: x.isNotNull())))
    at = F.col("_at")
    covered = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1), p + WINDOW) - p).cast("bigint"))
    return df.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length("_bare").cast("bigint"),
        "n_symbols": F.length(F.regexp_replace("_bare", SYMBOLS, "")).cast("bigint"),
        "n_upper": F.length(F.regexp_replace("_bare", r"[^\p{Lu}]+", "")).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")),
    }).drop("_words", "_bare", "_lines", "_grams", "_sorted", "_at")


def ledger(df: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """Measurements and `failed`, a bitmask with one bit for each rule in the order of `rules` (63 at most)."""
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, rule in enumerate(rules.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(df, text).withColumn("failed", failed)


def fails(names: tuple[str, ...], rules: Mapping[str, object] = RULES, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(names, rules))) != 0


def apply_policy(ledger: DataFrame, policy: str | tuple[str, ...], rules: Mapping[str, object] = RULES) -> DataFrame:
    """Adds `kept`: no rule of the policy failed. No text is read again."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return ledger.withColumn("kept", ~fails(names, rules))


def ablations(ledger: DataFrame, policy: str | tuple[str, ...], rules: Mapping[str, object] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (kept if it were left out), and kept documents.

    One aggregate over the masks, then bit operations over the at most 2^rules patterns that occur.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask(names, rules))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(mask((x,), rules)).cast("bigint").alias("bit")) for x in names)))
    pairs = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("bigint"))

    return pairs.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(F.col("bits") == 0).alias("n_kept"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
