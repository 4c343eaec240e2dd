"""Column expressions over text; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query's terms leave out.
QUERY_STOPWORDS = """a an the and or but of to in on at for with from by as is are was were be been being do does did can could would should will shall
may might must it its this that these those there here what which who whom whose when where why how if then than so such not no my your our their me you""".split()


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores, 2 to 64 characters long (TXT4)."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)), lambda x: F.length(x).between(2, 64))


def token_count(text: Column) -> Column:
    """Runs of white space, so n words count n - 1 (TXT5)."""
    return F.regexp_count(text, F.lit(r"(?U)\s+"))


#: What counts as white space besides Unicode's own; lines that are page numbers only, and the marks of rules.
_SPACE = r"[\s\x1c-\x1f]"
_PAGE_LINE = r"(?U)(?i)^(page\s++)?+\d++\s*+(of\s++\d++)?+$"
_RULE_MARKS = "-*_="


def strip(text: Column) -> Column:
    """Without white space at both ends. A run of white space inside is looked at once, however long it is."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}++|(?<!{_SPACE}){_SPACE}++$", "")


def clean_text(text: Column) -> Column:
    """Canonical text (TXT2); callers bring non-ASCII text into composed form first. Each pattern takes time linear in a line."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\u00a0", " ")
    t = F.regexp_replace(F.regexp_replace(t, "\u200b", ""), r"(?m)(?<![ \t])[ \t]++$", "")

    def kept(line: Column) -> Column:
        """The line, an empty one for white space alone, null for a page number or a rule: three marks or more and white space."""
        s = strip(line)
        rule = s.rlike(rf"(?U)^[{re.escape(_RULE_MARKS)}\s]++$") & (F.length(s) - F.length(F.translate(s, _RULE_MARKS, "")) >= 3)
        return F.when(s == "", "").when(~s.rlike(_PAGE_LINE) & ~rule, line)

    lines = F.filter(F.transform(F.split(t, "\n", -1), kept), lambda x: x.isNotNull())
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def fingerprint(text: Column) -> Column:
    """First 400 characters, lower-case, other signs than letters and digits as one space (RNK2)."""
    return F.trim(F.regexp_replace(F.lower(F.substring(text, 1, 400)), "[^a-z0-9]+", " "))


def query_terms(text: Column, longest: int = 3) -> Column:
    """Distinct content words and their n-grams joined by underscores (KW3)."""
    words = F.filter(tokens(text), lambda x: ~x.isin(QUERY_STOPWORDS))
    none = F.expr("cast(array() as array<string>)")

    def grams(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), "_"))
        return F.when(F.size(words) >= n, joined).otherwise(none)

    return F.array_distinct(F.concat(words, *[grams(n) for n in range(2, longest + 1)]))


def markers(text: Column) -> Column:
    """Citation numbers in order; full-width brackets count (CIT1)."""
    return F.transform(F.regexp_extract_all(fold_markers(text), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def fold_markers(text: Column) -> Column:
    return F.regexp_replace(text, "[【［]\\s*(\\d+)\\s*[】］]", "[$1]")


def topic(text: Column) -> Column:
    """What a question is about: without its lead, determiner and closing signs (RW1)."""
    end = r"(?<![?.])[?.]+\s*$"
    # How questions begin.
    lead = r"(?i)^\s*(do|does|did|is|are|was|were|can|could|would|should|will|shall|may|might|tell\s+me\s+about|explain|describe|what\s+is|what\s+are|what'?s)\s+"
    t = F.trim(F.regexp_replace(F.trim(text), end, ""))
    t = F.trim(F.regexp_replace(t, lead, ""))
    t = F.trim(F.regexp_replace(t, r"(?i)^(the|a|an|my|our|your|their)\s+", ""))
    return F.trim(F.regexp_replace(t, end, ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero vector, an error for different widths (VEC1)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different widths")).cast("double"))
    return F.coalesce(same, F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))
