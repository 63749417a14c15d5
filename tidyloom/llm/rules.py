"""Quality rules as a ledger of bits, in DataFrame functions only.

Every rule is evaluated once and leaves its bit and its measurement. Policies are
named masks over the bits, so a new policy, or the effect of leaving one rule out, needs
no second look at the texts.

Defined cases: a null or empty text has no words and fails the base rules; shares of
nothing are 0; measures count code points. Columns of the input with the names of the
results are replaced. An empty table gives an empty ledger and a report of zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import SPACE, SPACES, whole, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measures) is true; its bit is its place in RULES."""

    name: str
    fails: str


#: Order is part of the ledger's format: append, never reorder.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * word_chars"),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("symbol_per_word", "2 * n_symbols > n_words"),
)

#: A policy is the set of rules that reject a document.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "short_words", "long_words", "symbols"),
    "v2": ("too_few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines", "symbol_per_word"),
}


def mask(policy: str) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def _repeated(hashes: Column, n: Column) -> Column:
    """Words that lie in a window found twice or more, from the windows' hashes in order.

    Hashes and places are sorted together, so equal windows stand side by side; the
    places of repeated ones, again in order, cover up to a window's length each.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def found(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        twice = F.filter(F.sequence(F.lit(0), last), lambda k: (
            ((k > 0) & (F.get(sorted_, k - 1)["h"] == F.get(sorted_, k)["h"]))
            | ((k < last) & (F.get(sorted_, k + 1)["h"] == F.get(sorted_, k)["h"]))
        ))
        return F.sort_array(F.transform(twice, lambda k: F.get(sorted_, k)["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            (a["n"] + F.least(p + F.lit(WINDOW) - a["end"], F.lit(WINDOW))).alias("n"), (p + F.lit(WINDOW)).alias("end")
        ), lambda a: a["n"])

    # One-element arrays bind a value once, as a name would.
    once = F.transform(F.transform(F.array(placed), found), covered)
    distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(distinct, F.lit(0)).otherwise(F.get(once, 0)).cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures and ``fail_bits``; the text is read once and nothing is shuffled."""
    bare = F.translate(whole(text), SPACES, "")
    split = docs.withColumns({
        "__words": words(text),
        "__lines": F.filter(F.split(whole(text), "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")),
        "word_chars": F.char_length(bare).cast("long"),
        "n_symbols": (F.char_length(bare) - F.char_length(F.translate(bare, SYMBOLS, ""))).cast("long"),
    })
    hashed = split.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__hashes": F.when(F.size("__words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("__words") - WINDOW),
            lambda i: F.xxhash64(*(F.get("__words", i + k) for k in range(WINDOW))),
        )).otherwise(F.array().cast("array<bigint>")),
    }).drop("__lines")
    measured = hashed.withColumn("n_repeat_words", _repeated(F.col("__hashes"), F.col("n_words"))).drop("__words", "__hashes")
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    return measured.withColumn("fail_bits", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(judged: DataFrame, policy: str) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a policy."""
    failed = lambda name: F.col("fail_bits").bitwiseAND(F.lit(mask(name))) != 0
    return judged.withColumns({"base_failed": failed("base"), "kept": ~failed("base") & ~failed(policy)})


def ablation(judged: DataFrame, policy: str) -> DataFrame:
    """One row per rule of a policy: documents it fails, and those that only it rejects.

    Equal bit patterns are counted first, so at most 2**rules rows leave the map tasks.
    """
    own = mask(policy)
    patterns = judged.groupBy(F.col("fail_bits").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    counts = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == 1 << i, F.col("n"))), F.lit(0)).alias("only_by_it"),
        )
        for i, r in enumerate(RULES) if own >> i & 1
    ]
    return patterns.agg(F.array(*counts).alias("rules")).select(F.inline("rules")).withColumn("policy", F.lit(policy))
