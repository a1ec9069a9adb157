"""Quality rules: a ledger of rule failures as a bit mask, with versioned policies and ablations on top.

Every rule is evaluated once per document. The ledger keeps its measurements and one bit per
failed rule; a policy is a named mask of the bits that reject a document, so changing policy, or
asking what one rule alone rejects, never reads a text again. DataFrame expressions only; one scan,
no shuffle.

Repeated 3-word windows are found within the row: 64-bit window hashes are packed with
their positions into longs and sorted; positions whose leading 33 bits have a neighbour are compared
again on the whole hash, so a document costs n log n and no shuffle.

Defined results: null text counts as empty (no words, so it fails ``few_words``); a null doc_id is kept as
it is; rows are judged one by one, repeated ones alike; an empty table gives an empty ledger; further columns pass through
``quality_ledger`` unless they have the name of a measurement or are called failed_rules, which then are replaced;
``passing_documents`` returns all columns as they came, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

#: The rules, in the order of their bits: (name, SQL that is true on failure).
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("duplicate_lines", "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_or_long_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the bits that reject a document.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_windows"],
    "v1": sum(BIT.values()),
}


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    trimmed = F.btrim(F.col("__text"), F.lit(" \t\n\x0b\f\r"))
    return docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE)))


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once and named. Inside a lambda a column's expression would be computed again
    for every element, once the optimizer has moved it there; a variable is not."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str = "__words") -> str:
    """SQL for the number of words in 3-word windows that occur more than once in ``words``."""
    low = (1 << 31) - 1
    window = lambda at: f"xxhash64(get(w, {at}), get(w, {at} + 1), get(w, {at} + 2))"
    packed = f"sort_array(transform(sequence(0, size(w) - 3), i -> ({window('i')} & {~low}L) | i))"
    near = "filter(s, (x, k) -> shiftright(x, 31) <=> shiftright(get(s, k - 1), 31) or shiftright(x, 31) <=> shiftright(get(s, k + 1), 31))"
    again = f"array_sort(transform(n, x -> struct({window(f'cast(x & {low}L as int)')} as h, cast(x & {low}L as int) as p)))"
    spots = "array_sort(transform(filter(r, (x, k) -> x.h <=> get(r, k - 1).h or x.h <=> get(r, k + 1).h), x -> x.p))"
    total = "aggregate(transform(t, (p, k) -> least(3, coalesce(get(t, k + 1) - p, 3))), 0L, (a, x) -> a + x)"
    exact = _let("r", again, _let("t", spots, total))
    found = _let("s", packed, _let("n", near, f"case when size(n) = 0 then 0L else {exact} end"))
    return _let("w", words, f"case when size(w) < 3 then 0L else {found} end")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements as columns."""
    df = _with_words(docs.drop(*MEASURES), text)
    df = df.withColumn("__lines", F.expr(rf"filter(split(__text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_capitals": F.char_length(F.regexp_replace("__text", r"[^\p{Lu}]+", "")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    )
    return df.withColumn("n_repeat_words", F.expr(_repeat_words())).drop("__text", "__words", "__lines")


def quality_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed_rules``, one bit per failed rule."""
    bits = F.lit(0).cast("long")
    for name, sql in RULES:
        bits = bits + F.when(F.expr(sql), F.lit(BIT[name])).otherwise(0).cast("long")
    return measures(docs, text).withColumn("failed_rules", bits)


def passes(policy: str, bits: Column | None = None) -> Column:
    return (F.col("failed_rules") if bits is None else bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def passing_documents(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy lets pass, with their columns as they are.

    The row number is there because it is not deterministic: the optimizer can't move the
    filter below the measurements, where each use would compute them again.
    """
    private = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    ledger = quality_ledger(docs.withColumnsRenamed(private), private[text]).withColumn("__row", F.monotonically_increasing_id())
    return ledger.filter(passes(policy) & (F.col("__row") >= 0)).select([F.col(own).alias(c) for c, own in private.items()])


def ablation(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that pass without it. Masks are counted first, so at most 2**rules rows are left."""
    mask = POLICIES[policy]
    counts = ledger.groupBy(F.col("failed_rules").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n, _ in RULES if BIT[n] & mask])).alias("r")
    rows = counts.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    only = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when((only == 0) & (F.col("bits") != 0), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(only == 0, F.col("n")).otherwise(0)).alias("n_passed_without"),
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    ledger = quality_ledger(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failed_rules")
