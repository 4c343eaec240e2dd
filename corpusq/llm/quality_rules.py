"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every document passes through a fixed chain of projections (no shuffle, no Python): words, lines and
hashed 3-word windows as arrays, counts from them, then one boolean for each row of the threshold table.

Defined cases: null or empty text has no words, all counts are 0 and base_failed is true; null doc_id and
repeated rows give one output row per input row; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import BLANKS, WORD

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "it", "a", "on",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "pour", "dans", "est", "sur",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "ein", "eine",
    "el", "los", "las", "y", "con", "por", "una", "para", "del", "se", "no", "es", "al",
]


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= ratio <= high; ratio is a key of RATIOS."""

    ratio: str
    low: float | None = None
    high: float | None = None


#: SQL over the counts; a denominator of 0 makes the ratio 0.
RATIOS = {
    "words": "n_words",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "distinct_stop_words": "n_stop",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "bullet_lines": "n_bullet_lines / greatest(n_lines, 1)",
    "ellipsis_lines": "n_ellipsis_lines / greatest(n_lines, 1)",
}

THRESHOLDS = [
    Rule("words", low=50),
    Rule("mean_word_length", low=2.0, high=15.0),
    Rule("symbols_per_word", high=0.2),
    Rule("distinct_stop_words", low=2),
    Rule("duplicate_lines", high=0.5),
    Rule("bullet_lines", high=0.9),
    Rule("ellipsis_lines", high=0.5),
]


def compiled(rules: list[Rule]) -> Column:
    """The whole threshold table as one boolean expression."""
    parts = []
    for r in rules:
        value = F.expr(f"cast({RATIOS[r.ratio]} as double)")
        parts += [value >= r.low] if r.low is not None else []
        parts += [value <= r.high] if r.high is not None else []
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules and contract need."""
    blank = BLANKS.replace("\\", "\\\\")
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    a = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t")).select(
        "doc_id",
        F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1)).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("l"),
        F.length(F.translate("t", blank, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    b = a.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.array_intersect(F.col("w"), stop)).cast("long").alias("n_stop"),
        F.expr("if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").alias("h"),
    )
    keep = [c for c in b.columns if c != "h"]
    c = b.select(*keep, "h", F.sort_array("h").alias("s"))
    d = c.select(*keep, "h", F.expr("array_distinct(filter(s, (x, i) -> i > 0 and x = s[i - 1]))").alias("twice"))
    # Starts of the windows that occur twice or more, ascending. With many of them, sorting beats looking each up.
    e = d.select(
        *keep,
        F.expr("""case when size(twice) = 0 then cast(array() as array<int>)
            when size(twice) <= 16 then filter(sequence(0, size(h) - 1), i -> array_contains(twice, h[i])) end""").alias("p"),
        F.expr("if(size(twice) <= 16, null, array_sort(transform(h, (x, i) -> struct(x, i))))").alias("q"),
    )
    f = e.select(*keep, F.expr("""coalesce(p, sort_array(transform(
            filter(transform(q, (x, i) -> struct(x.i as at, (i > 0 and q[greatest(i - 1, 0)].x = x.x) or (i < size(q) - 1 and q[least(i + 1, size(q) - 1)].x = x.x) as again)),
                   x -> x.again), x -> x.at)))""").alias("p"))
    covered = "aggregate(p, named_struct('n', 0L, 'last', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n)"
    return f.select(*keep, F.expr(covered).alias("n_repeat_words"))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    table = THRESHOLDS if rules is None else rules
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & compiled(table)).alias("kept"),
    )
