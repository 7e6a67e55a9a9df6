"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each failed rule. A policy is
a versioned set of rules, so it is a mask: a document passes if none of the mask's bits is set. What a policy would
keep without one of its rules follows from the bits alone, by one aggregation over the ledger.

All is built-in functions. Words are told apart by their 64-bit hashes within a text, three at a time.

A null or empty text has no words, so all measurements are 0 and it fails `few_words`. Repeated rows are judged each for
itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import settled, whole_text

#: What separates words, what counts as a symbol, and the letters that shout.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words in a window that counts as repeated, as often as it occurs twice or more.
WINDOW_WORDS = 3


@dataclass(frozen=True)
class Rule:
    """fails is a condition over the measurements."""
    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines"),
    Rule("capitals", 4, "100 * n_capitals > 40 * word_chars"),
    Rule("exclamations", 5, "2 * n_exclamations > n_words"),
    Rule("short_words", 6, "word_chars < 2 * n_words"),
    Rule("long_words", 7, "word_chars > 40 * n_words"),
    Rule("many_digits", 8, "100 * n_digits > 50 * word_chars"),
)
BITS = {rule.name: 1 << rule.bit for rule in RULES}
#: Policies by version; each is the set of rules that a document must not fail.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(rule.name for rule in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals",
            "n_exclamations", "n_digits")


def mask(rules: tuple[str, ...]) -> int:
    return sum(BITS[name] for name in set(rules))


def without(column: str, characters: str) -> Column:
    """How many characters a text has besides these."""
    return F.char_length(F.translate(column, characters, ""))


def count_of(column: str, characters: str) -> Column:
    return (F.char_length(column) - without(column, characters)).cast("long")


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key and MEASURES. Each select makes the array that the next one goes through by position."""
    words = F.array_remove(F.split(F.col("text"), f"[{BLANKS}]+"), "")
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0)
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).select(
        "key", without("text", BLANKS).cast("long").alias("word_chars"),
        count_of("text", SYMBOLS).alias("n_symbols"), count_of("text", CAPITALS).alias("n_capitals"),
        count_of("text", "!").alias("n_exclamations"), count_of("text", "0123456789").alias("n_digits"),
        words.alias("words"), lines.alias("lines"))
    counted = rows.select(
        "*", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW_WORDS)
    hashed = counted.drop("lines").withColumn("windows", F.when(
        F.col("n_words") >= WINDOW_WORDS, F.transform(starts, lambda n: F.xxhash64(
            *(F.get(F.col("words"), n + k) for k in range(WINDOW_WORDS)))))).drop("words")
    # Only where two windows are alike are they sorted with their places.
    placed = hashed.withColumn("placed", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda x, n: F.struct(x.alias("window"), n.alias("place")))))).drop("windows")
    alike = lambda x, n, step: x["window"] == F.get(F.col("placed"), n + step)["window"]
    repeated = placed.withColumn("repeated", F.sort_array(F.array_compact(F.transform(
        "placed", lambda x, n: F.when(alike(x, n, -1) | alike(x, n, 1), x["place"]))))).drop("placed")
    covered = F.transform("repeated", lambda x, n: F.least(
        F.lit(WINDOW_WORDS), F.coalesce(F.get(F.col("repeated"), n + 1) - x, F.lit(WINDOW_WORDS))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda sum_, x: sum_ + x)
    return settled(repeated.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).select(
        F.col("key").alias(key), *MEASURES))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, MEASURES and failures (a bit for each rule that the document fails)."""
    bits = [F.when(F.expr(rule.fails), F.lit(BITS[rule.name])).otherwise(0).cast("long") for rule in RULES]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured(docs, text, key).withColumn("failures", failures)


def passes(policy: str) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many documents fail it, how many fail only it, and how many the policy would keep
    without it. One pass over the ledger, whose rows are first counted by their bits."""
    whole = mask(POLICIES[policy])
    counts = book.groupBy(F.col("failures").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(
        F.count("*").alias("documents"))
    per_rule = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit"))
                         for name in sorted(set(POLICIES[policy]))))
    each = counts.select("bits", "documents", F.explode(per_rule).alias("own"))
    some = lambda when: F.sum(F.when(when, F.col("documents")).otherwise(0))
    return each.groupBy(F.col("own.rule").alias("rule")).agg(
        some(F.col("bits").bitwiseAND(F.col("own.bit")) != 0).alias("n_failed"),
        some(F.col("bits") == F.col("own.bit")).alias("n_failed_alone"),
        some(F.col("bits").bitwiseAND(F.bitwise_not("own.bit")) == 0).alias("n_kept_without"))


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger's base measurements and the verdict of a policy."""
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), (passes("base") & passes(policy)).alias("kept"), "failures")
