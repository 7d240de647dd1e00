"""Quality rules as a bitmask ledger, DataFrame functions only.

``ledger`` evaluates every rule once per document and stores the failure bits
beside the measurements. Policies are versioned bit masks, so changing a policy
(``apply_policy``) or asking what each rule costs (``ablation``) never looks at
a text again: both are integer arithmetic on the ledger.

Defined results
* null or empty text: no words, all measurements 0, fails ``few_words``.
* null ids pass through; repeated rows each get their own ledger row.
* very long texts: one row each, work linear (sorting n log n) in their words.
* empty table: empty ledger; ``ablation`` then returns zero counts.
* extra columns are not read; only the two named columns are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space and symbol characters of the contract.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_SPACE_RE = r"[\x20\x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurement columns; ``bit`` is permanent."""
    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbol_ratio", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 3 * n_words"),
    Rule(4, "long_words", "word_chars > 10 * n_words"),
    Rule(5, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
)
BASE = 0b11
#: Policy versions: the rules (by bit) whose failure rejects a document.
POLICIES = {"base": BASE, "v1": 0b000111, "v2": 0b111111}
CURRENT = "v2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE_RE), lambda w: w != "")


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        again = F.filter(F.sequence(F.lit(0), last), lambda j: (
            F.when(j > 0, s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"]).otherwise(False)
            | F.when(j < last, s[F.least(j + 1, last)]["h"] == s[j]["h"]).otherwise(False)))
        return F.array_sort(F.transform(again, lambda j: s[j]["i"]))

    def total(p: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(p) - 1)
        return F.aggregate(steps, F.lit(WINDOW),
                           lambda acc, j: acc + F.least(F.lit(WINDOW), p[j] - p[j - 1]))

    return _let(ordered, lambda s: _let(starts(s), total))


def _repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows found twice or more (64-bit window hashes)."""
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                           lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h))

    return _let(words, lambda w: F.when(F.size(w) <= WINDOW, 0).otherwise(_let(windows(w), count)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and the measurements the rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line_has_word = lambda l: F.length(F.translate(l, SPACE, "")) > 0
    lines = F.filter(F.split(text, "\n"), line_has_word)
    base = docs.select(
        F.col(id_col).alias(id_col),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda l: F.struct(F.size(l).alias("n"), F.size(F.array_distinct(l)).alias("d"))).alias("_l"),
        _let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("_w"))
    return base.select(
        id_col, F.col("_w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("_l.n").cast("long").alias("n_lines"),
        (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"),
        F.col("_w.r").cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``fail_bits``: bit b is set where the rule of bit b fails."""
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Verdict of a policy version: ``base_failed`` and ``kept``."""
    mask = POLICIES[version] | BASE
    return (rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0)
            .withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0))


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents failing it, and those that only it rejects.

    One partial aggregation over the ledger; at most one row per rule.
    """
    mask = POLICIES[version] | BASE
    used = [r for r in RULES if mask >> r.bit & 1]
    masked = F.col("fail_bits").bitwiseAND(F.lit(mask))
    aggs = [F.count(F.when(masked != 0, 1)).alias("rejected")]
    for r in used:
        aggs += [F.count(F.when(masked.bitwiseAND(F.lit(1 << r.bit)) != 0, 1)).alias(f"f{r.bit}"),
                 F.count(F.when(masked == F.lit(1 << r.bit), 1)).alias(f"o{r.bit}")]
    one = rows.agg(*aggs)
    items = F.array(*[F.struct(F.lit(version).alias("policy"), F.lit(r.name).alias("rule"),
                               F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only"),
                               (F.col("rejected") - F.col(f"o{r.bit}")).alias("rejected_without"))
                      for r in used])
    return one.select(F.inline(items))


def keep(docs: DataFrame, version: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("body"))
    judged = apply_policy(ledger(packed, "row", "body"), version)
    return judged.where("kept").select(*[F.col("row").getField(c).alias(c) for c in names])
