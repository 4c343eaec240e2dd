"""Headings, sections and paragraphs of texts, with exact places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.functions.text import strip
from corpusq.operators import asof
from corpusq.sources.streams import written

# What counts as a heading.
ATX = r"^(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$"
NUMBERED = r"^(\d+(?:\.\d+)*)[.)]?[ \t]+(\S.*)$"
ALL_CAPS = r"^[A-Z0-9][A-Z0-9 ,'&/()\-]{2,}$"
UNDERLINE_1, UNDERLINE_2 = r"^=+[ \t]*$", r"^-{2,}[ \t]*$"
SHORTEST, LONGEST, CAPS_WORDS = 2, 120, 10

PARAGRAPH_BREAK = r"\n[ \t]*\n"


def _sized(line: Column) -> Column:
    return F.length(line).between(SHORTEST, LONGEST)


def heading_of_line(line: Column) -> Column:
    """struct(level, text) of a line that is a heading by itself, else null (TXT7)."""
    s = strip(line)
    found = lambda level, text: F.struct(level.cast("int").alias("level"), strip(text).alias("text"))
    dots = F.length(F.regexp_extract(s, NUMBERED, 1)) - F.length(F.replace(F.regexp_extract(s, NUMBERED, 1), F.lit("."), F.lit("")))
    return (
        F.when(~_sized(s), None)
        .when(s.rlike(ATX), found(F.length(F.regexp_extract(s, ATX, 1)), F.regexp_extract(s, ATX, 2)))
        .when(s.rlike(NUMBERED) & ~s.rlike(r"[.!?]$"), found(dots + 1, F.regexp_extract(s, NUMBERED, 2)))
        .when(s.rlike(ALL_CAPS) & (T.token_count(s) < CAPS_WORDS), found(F.lit(1), s))
    )


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line, level, heading, char_start (TXT8). Lines are ordered by one shuffle; texts of long lines are not part of it."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    s = strip(F.col("raw"))
    lines = lines.select("doc_id", "line", (F.length("raw") + 1).alias("size"), F.when(F.length(s) <= LONGEST, s).alias("s"), heading_of_line(F.col("raw")).alias("own"))
    w = Window.partitionBy("doc_id").orderBy("line")
    at = lines.withColumn("start", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("before", F.lag(F.struct("s", "start")).over(w))
    title = _sized(F.col("before.s"))
    under = F.when(F.col("s").rlike(UNDERLINE_1), 1).when(F.col("s").rlike(UNDERLINE_2), 2)
    at = at.withColumn("under", under)
    found = F.when(F.col("under").isNotNull() & title, F.struct(F.col("under").alias("level"), F.col("before.s").alias("text"), F.col("before.start").alias("start")))
    found = found.when(F.col("under").isNull() & F.col("own").isNotNull(), F.struct(F.col("own.level").alias("level"), F.col("own.text").alias("text"), F.col("start")))
    at = at.select("doc_id", "line", found.alias("h")).where("h is not null").withColumn("last", F.lag("h.text").over(w))
    return at.where("last is null or last <> h.text").select("doc_id", "line", "h.level", F.col("h.text").alias("heading"), F.col("h.start").cast("int").alias("char_start"))


#: Characters of a document that share a bucket where places meet headings.
BUCKET = 1 << 16


def section_paths(places: DataFrame, found: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """places (doc_id, char_start, ...) with section_path: the headings open there (TXT9). A heading is open until the next one of its level or above.

    Each heading points to the one above it, the last before it of a higher rank; a place has the path of the last heading before it. Both are as-of joins by
    buckets (JN5), so a document with very many headings is spread."""
    h = written(found.select("doc_id", "char_start", "level", "heading"), "headings")
    levels = sorted(r[0] for r in h.select("level").distinct().collect())  # some sixty at most, as a numbered heading has 120 characters
    below = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]) if levels else F.expr("cast(array() as array<int>)"), lambda x: x > F.col("level"))).alias("of")
    above = asof.last_marks(h.select("doc_id", "char_start", "heading", F.col("level").alias("of"), (F.col("char_start") - 1).alias("at")), h.select("doc_id", F.col("char_start").alias("at"), below), ["doc_id", "of"], "at", bucket, name="above")
    paths = above.select("doc_id", "char_start", F.array("heading").alias("path"), F.col("above").cast("int").alias("above"))
    up = written(above.select("doc_id", F.col("char_start").alias("above"), F.array("heading").alias("upper"), F.col("above").cast("int").alias("next")), "above")
    for _ in range(len(levels).bit_length()):
        # Each round doubles the part of the path that is known.
        paths = paths.join(up, ["doc_id", "above"], "left").select("doc_id", "char_start", F.concat(F.coalesce("upper", F.expr("cast(array() as array<string>)")), "path").alias("path"), F.col("next").alias("above"))
        paths = written(paths, "paths")
        twice = up.select("doc_id", F.col("above").alias("at"), F.col("upper").alias("lower"), F.col("next").alias("above"))
        up = written(twice.join(up, ["doc_id", "above"], "left").select("doc_id", F.col("at").alias("above"), F.concat(F.coalesce("upper", F.expr("cast(array() as array<string>)")), "lower").alias("upper"), "next"), "above")
    marks = paths.select("doc_id", "char_start", "path")
    out = asof.last_marks(places, marks, ["doc_id"], "char_start", bucket, F.col("path"), "section_path")
    return out.withColumn("section_path", F.coalesce("section_path", F.expr("cast(array() as array<string>)")))


def breadcrumb(title: Column, path: Column, deepest: int = 3) -> Column:
    """Title and up to three sections, repeats of the part before left out, joined by ' > ' (TXT10)."""
    first = F.array(strip(title))
    parts = F.aggregate(F.slice(path, 1, deepest), first, lambda a, x: F.when((strip(x) == "") | (strip(x) == F.element_at(a, -1)), a).otherwise(F.concat(a, F.array(strip(x)))))
    return F.array_join(F.filter(parts, lambda x: x != ""), " > ")


def _trimmed(start: Column, part: Column) -> tuple[Column, Column]:
    lead = F.length(F.regexp_extract(part, r"(?U)^(\s*)", 1))
    return start + lead, start + lead + F.length(strip(part))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, char_start, char_end, token_count of paragraphs between blank lines, trimmed (TXT11)."""
    cut = docs.select("doc_id", F.posexplode(F.arrays_zip(F.split("text", PARAGRAPH_BREAK, -1).alias("part"), F.regexp_extract_all("text", F.lit(f"({PARAGRAPH_BREAK})"), F.lit(1)).alias("gap"))).alias("n", "x"))
    part = F.col("x.part")
    # Paragraphs are measured before they are put in order: their texts are not shuffled.
    start, end = _trimmed(F.lit(0), part)
    cut = cut.select("doc_id", "n", (F.length(part) + F.coalesce(F.length("x.gap"), F.lit(0))).alias("size"), start.alias("start"), end.alias("end"), T.token_count(strip(part)).alias("token_count"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = cut.withColumn("at", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("int"))
    return at.select("doc_id", (F.col("at") + F.col("start")).alias("char_start"), (F.col("at") + F.col("end")).alias("char_end"), "token_count").where("char_end > char_start")


def sections(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, char_start, char_end, token_count: from heading to heading; documents without headings by paragraphs (TXT12)."""
    starts = found.select("doc_id", "char_start")
    first = starts.select("doc_id").distinct().withColumn("char_start", F.lit(0))
    ends = starts.unionByName(first).distinct().withColumn("char_end", F.lead("char_start").over(Window.partitionBy("doc_id").orderBy("char_start")))
    cut = docs.select("doc_id", "text").join(ends, "doc_id").withColumn("char_end", F.coalesce("char_end", F.length("text")))
    cut = cut.withColumn("part", F.expr("substring(text, char_start + 1, char_end - char_start)")).where(strip(F.col("part")) != "")
    cut = cut.select("doc_id", "char_start", "char_end", T.token_count(F.col("part")).alias("token_count"))
    return cut.unionByName(paragraphs(docs.join(first, "doc_id", "left_anti")))


def windows(docs: DataFrame, target: int, overlap: int) -> DataFrame:
    """doc_id, char_start, char_end, token_count: fixed windows at 4 characters a token (TXT13)."""
    size, step = 4 * target, max(1, 4 * (target - overlap))
    w = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))).alias("char_start"))
    w = w.withColumn("char_end", F.least(F.col("char_start") + size, F.length("text"))).withColumn("part", F.expr(f"substring(text, char_start + 1, {size})"))
    return w.where(strip(F.col("part")) != "").select("doc_id", "char_start", "char_end", T.token_count(F.col("part")).alias("token_count"))
