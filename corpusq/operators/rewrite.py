"""Questions made independent of the conversation before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import structure as S
from corpusq.functions import text as T

WINDOW, LEAST_TOKENS, MOST_TOKENS, MOST_SYNONYMS = 10, 2, 6, 4

# Fixed values.
PRONOUNS = "it its they them their theirs this that these those".split()
OPENER = r"(?i)^\s*(?:and\s+)?(?:what\s+about|how\s+about|what'?s|whats)\s+(.+?)\s*\??$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([A-Za-z0-9_]+)"), F.lit(1))


def _refers(text: Column) -> Column:
    return F.arrays_overlap(words(text), F.array(*map(F.lit, PRONOUNS)))


def with_antecedent(turns: DataFrame) -> DataFrame:
    """User turns with antecedent: the topic of the newest usable one of the ten before (RW2). turns: conv_id, turn, role, text."""
    topic = words(T.topic(F.col("text")))
    usable = F.when(F.size(topic) >= LEAST_TOKENS, F.array_join(F.slice(topic, 1, MOST_TOKENS), " "))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-WINDOW, -1)
    # Blank turns hold no place in the window.
    return turns.where((F.col("role") == "user") & (S.strip(F.col("text")) != "")).withColumn("usable", usable).withColumn("antecedent", F.last("usable", ignorenulls=True).over(w)).drop("usable")


def resolved(query: Column, antecedent: Column) -> Column:
    """The query with its antecedent, or null if it refers to nothing before (RW3)."""
    topic = S.strip(F.rtrim(F.regexp_replace(S.strip(F.regexp_extract(query, OPENER, 1)), "[?.]+$", "")))
    left = F.array_join(F.filter(words(query), lambda x: ~x.isin(PRONOUNS)), " ")
    asked = F.when(left == "", antecedent).otherwise(F.concat(left, F.lit("?")))
    return F.when(antecedent.isNull(), None).when((topic != "") & ~_refers(topic), F.concat_ws(" ", antecedent, topic)).when(_refers(query), F.concat_ws(" ", antecedent, asked))


def expansions(queries: DataFrame, glossary: DataFrame, most: int = MOST_SYNONYMS) -> DataFrame:
    """query_id, added: synonyms of terms that occur, in the glossary's order, none that occurs or repeats, at most four (RW4).
    queries: query_id, query; glossary: term, position, synonym."""
    q = queries.select("query_id", words(F.col("query")).alias("present"))
    hit = q.select("query_id", F.explode(F.array_distinct("present")).alias("term")).join(glossary.withColumn("term", F.lower("term")), "term")
    new = hit.join(q, "query_id").where(~F.array_contains("present", F.lower("synonym")))
    new = new.groupBy("query_id", F.lower("synonym").alias("k")).agg(F.min(F.struct("position", "synonym")).alias("s"))
    w = Window.partitionBy("query_id").orderBy("s.position", "s.synonym")
    some = new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return some.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s.synonym"))), lambda x: x["synonym"]), " ").alias("added"))


def rewritten(asked: DataFrame, glossary: DataFrame) -> DataFrame:
    """query_id, original, query, stage, changed: the first stage that changes a query wins (RW5). asked: query_id, query, antecedent."""
    a = asked.join(expansions(asked, glossary), "query_id", "left").withColumn("r", resolved(F.col("query"), F.col("antecedent")))
    wide = F.when(F.col("added").isNotNull(), F.concat_ws(" ", "query", "added"))
    stage = F.when(F.col("r").isNotNull(), "anaphora").when(F.col("added").isNotNull(), "expansion").otherwise("none")
    out = a.select("query_id", F.col("query").alias("original"), F.coalesce("r", wide, "query").alias("query"), stage.alias("stage"))
    return out.withColumn("changed", F.col("query") != F.col("original"))
