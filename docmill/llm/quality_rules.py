"""Quality rules as a bitmask ledger, with DataFrame expressions only.

Every rule is evaluated once: a text gets its measurements and one long of failure bits. Policies
are versioned masks over those bits, so applying one, comparing versions and computing ablations
(what each rule alone rejects) are bitwise operations that never read the text again.

Edge cases: a null or blank text has no words and fails `few_words`; ratios have a denominator of
1 at least; repeated rows get equal ledgers; an empty table gives an empty ledger; input columns
that share a name with a measurement, `fail_bits` or `word_stats` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


# ---------------------------------------------------------------- measurements


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda s: without(s, BLANKS) != "")
    return bind(lines, lambda own: F.size(own) - F.size(F.array_distinct(own)))


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window found twice or more in the text; `words` must be bound.

    Windows are sorted by a 64-bit hash with their positions; equal neighbours are repeats. Texts
    without repeats stop at the first comparison of counts.
    """
    n = F.size(words) - (window - 1)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    keys = lambda h: F.transform(F.slice(h, 1, n), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)]))
    place = lambda k: F.array_sort(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))

    def covered(rows: Column) -> Column:
        found = F.filter(rows, lambda x, i: same(x, F.get(rows, i - 1)) | same(x, F.get(rows, i + 1)))
        return bind(F.array_sort(F.transform(found, lambda x: x["i"])), length)

    def length(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda s, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - s, F.lit(window)))), F.lit(0), lambda a, g: a + g)

    return F.when(n < 2, 0).otherwise(bind(bind(hashes, keys), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(bind(place(k), covered))))


def word_stats(text: Column) -> Column:
    """struct of n_words, n_repeat_words, n_dup_lines: what needs arrays, made in one go."""
    counts = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))
    return bind(words_of(text), counts)


def measurements(text: Column, stats: Column) -> dict[str, Column]:
    """Name -> integer measurement; `stats` is the text's word_stats."""
    size = lambda c: F.length(c).cast("long")
    return {
        "n_chars": size(text),
        "n_words": stats["n_words"],
        "word_chars": size(without(text, BLANKS)),
        "n_symbols": size(text) - size(without(text, SYMBOLS)),
        "n_dup_lines": dup_lines(text).cast("long"),
        "n_repeat_words": stats["n_repeat_words"],
        "n_lines": (F.size(F.split(text, "\n"))).cast("long"),
        "n_upper": size(text) - size(without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "n_shouts": size(text) - size(without(text, "!?")),
        "n_digits": size(text) - size(without(text, "0123456789")),
        "n_pipes": size(text) - size(without(text, "|")),
    }


# ---------------------------------------------------------------- rules and policies


@dataclass(frozen=True)
class Rule:
    """`fails` maps measurements (columns by name) to a boolean; `bit` never changes once given."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


RULES: tuple[Rule, ...] = (
    Rule(0, "few_words", lambda m: m("n_words") < 50),
    Rule(1, "repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule(2, "symbols", lambda m: 100 * m("n_symbols") > 10 * F.greatest(m("word_chars"), F.lit(1))),
    Rule(3, "shouting", lambda m: 100 * m("n_upper") > 40 * F.greatest(m("word_chars"), F.lit(1))),
    Rule(4, "exclamations", lambda m: 100 * m("n_shouts") > 30 * F.greatest(m("n_words"), F.lit(1))),
    Rule(5, "table_rows", lambda m: 100 * m("n_pipes") > 20 * F.greatest(m("n_words"), F.lit(1))),
    Rule(6, "duplicate_lines", lambda m: 100 * m("n_dup_lines") > 50 * F.greatest(m("n_lines"), F.lit(1))),
    Rule(7, "digits", lambda m: 100 * m("n_digits") > 50 * F.greatest(m("word_chars"), F.lit(1))),
    Rule(8, "word_length", lambda m: (m("word_chars") > 25 * F.greatest(m("n_words"), F.lit(1))) | (m("word_chars") < 2 * m("n_words"))),
    Rule(9, "many_words", lambda m: m("n_words") > 10_000_000),
)

#: Policy version -> names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "shouting", "exclamations", "table_rows", "duplicate_lines", "digits", "word_length"),
}


def mask_of(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def ledger(docs: DataFrame, *, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents without their text, with measurements and `fail_bits`. Narrow: no shuffle."""
    names = ["n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_digits", "n_pipes"]
    kept = [c for c in docs.columns if c not in {*names, "fail_bits", "word_stats", text_col}]
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = docs.select(*kept, text.alias(text_col), word_stats(text).alias("word_stats"))
    measured = worded.select(*kept, *[c.alias(n) for n, c in measurements(F.col(text_col), F.col("word_stats")).items()])
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits + F.when(r.fails(F.col), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: str | Sequence[str], *, rules: Sequence[Rule] = RULES, out: str = "kept") -> DataFrame:
    mask = mask_of(policy, rules)
    return entries.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(entries: DataFrame, policy: str | Sequence[str], *, rules: Sequence[Rule] = RULES) -> DataFrame:
    """rule, n_failing, n_only (rejected by this rule alone: what dropping it would give back), n_docs.

    One pass with partial sums over the bits; the text is not read.
    """
    mask = mask_of(policy, rules)
    own = [r for r in rules if mask >> r.bit & 1]
    failing = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.sum(F.when(failing.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0, 1).otherwise(0)).alias(f"f{r.bit}") for r in own]
    alone = [F.sum(F.when(failing == F.lit(1 << r.bit).cast("long"), 1).otherwise(0)).alias(f"o{r.bit}") for r in own]
    one = entries.agg(F.count(F.lit(1)).alias("n"), F.bit_or("fail_bits").alias("any_bits"), *sums, *alone)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.col(f"f{r.bit}"), F.lit(0)).alias("n_failing"), F.coalesce(F.col(f"o{r.bit}"), F.lit(0)).alias("n_only"), F.col("n").alias("n_docs")) for r in own])
    return one.select(F.explode(rows).alias("r")).select("r.*")
