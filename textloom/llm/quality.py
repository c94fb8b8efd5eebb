"""Quality rules as a bitmask ledger, in DataFrame functions alone.

`measure` takes each measurement once; `ledger` evaluates every rule once over them and stores one failure bit a
rule; `apply_policy` and `ablation` then only work on bits: changing a policy reads no text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planning import kept_apart
from .store import fresh

#: Characters that separate words, as a class of regular expressions.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, a SQL condition over the measurements, holds. Its bit never changes."""

    bit: int
    name: str
    fails: str


#: Ratios are compared as integers, so that no rounding decides.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "short_words", "2 * word_chars < 3 * n_words"),
    Rule(3, "long_words", "word_chars > 25 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(5, "repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
)
#: Each version of a policy names the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words", "long_words", "symbols"),
    "v2": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines"),
}


def mask(rules: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[x] for x in set(rules))


def measure(docs: DataFrame) -> DataFrame:
    """docs with its measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words
    (all long). Columns of docs with such names are replaced, any others stay as they are, whatever their names; a null or
    empty text measures 0 throughout. Rows are measured one by one, so null and repeated doc_ids are nothing special; an
    empty table gives no rows. A text of any length is measured whole, with some 100 bytes for each of its words in a task.

    A word is a run of characters other than 0x20 and 0x09-0x0D. Windows of five words are compared by 64-bit
    hashes within one document; each stage's input is named once or more than once in the next, so that Catalyst
    keeps them apart and nothing is computed twice.
    """
    keep = [f"`{c}`" for c in docs.columns if c.lower() not in MEASURES]
    t, lines, words, w, s, at = fresh([*docs.columns, *MEASURES], "t", "lines", "words", "w", "s", "at")
    base = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(t))
    base = base.select(*keep,
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
        F.filter(F.split(t, SPACE + "+"), lambda x: x != "").alias(words))
    base = base.select(*keep, F.length(F.array_join(words, "")).cast("long").alias("word_chars"), "n_symbols",
        F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda x: F.xxhash64(x)).alias(w))
    base = base.select(*keep, "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.size(w).cast("long").alias("n_words"),
        F.expr(f"""case when size({w}) <= {WINDOW} then cast(array() as array<bigint>) else
            transform(sequence(0, size({w}) - {WINDOW}), i -> xxhash64({', '.join(f'{w}[i + {j}]' for j in range(WINDOW))})) end""").alias(s))
    # Positions of windows found twice or more, ascending; then the words that they cover.
    base = base.withColumn(at, F.expr(f"""case when size({s}) = size(array_distinct({s})) then null else
        sort_array(flatten(transform(array(sort_array(transform({s}, (x, i) -> struct(x, i)))), o ->
            transform(filter(sequence(0, size(o) - 1), j -> (j > 0 and o[j].x = o[j - 1].x) or (j < size(o) - 1 and o[j].x = o[j + 1].x)), j -> o[j].i)))) end"""))
    covered = F.expr(f"""case when {at} is null then 0 else aggregate({at}, struct(cast(0 as bigint) as n, -{WINDOW} as last),
        (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last), a -> a.n) end""")
    return base.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`measure(docs)` and fail_bits (long): bit r.bit is set where the document fails rule r."""
    bits = sum((F.expr(f"case when {r.fails} then {1 << r.bit}L else 0L end") for r in rules), F.lit(0).cast("long"))
    return measure(docs).withColumn("fail_bits", kept_apart(bits))


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """base_failed and kept (booleans) by the bits of a ledger. Every document has bits, so neither is null."""
    return book.withColumn("base_failed", F.col("fail_bits").bitwiseAND(mask(POLICIES["base"])) != 0).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(mask(POLICIES["base"]) | mask(POLICIES[policy])) == 0)


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rule, failed (documents that fail it), only (those it alone rejects, so what dropping
    the rule brings back), kept_without. Documents are first summed by distinct bits: at most 2**rules rows."""
    m = mask(POLICIES[policy])
    sums = book.groupBy(F.col("fail_bits").bitwiseAND(m).alias("bits")).agg(F.count("*").alias("n"))
    names = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy])))
    return sums.select("n", "bits", names.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.expr("case when bits & r.bit != 0 then n else 0L end")).alias("failed"),
        F.sum(F.expr("case when bits = r.bit then n else 0L end")).alias("only"),
        F.sum(F.expr("case when bits & ~r.bit = 0 then n else 0L end")).alias("kept_without"))
