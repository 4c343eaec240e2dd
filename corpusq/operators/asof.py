"""As-of joins by buckets: for each row the last mark at or before it, or the first at or after it.

Rows and marks of a key are cut into buckets of places, and each bucket carries the last mark of those before it. So a
key with very many rows is many small windows instead of one; only a row for each bucket is ordered by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.sources.streams import written


def last_marks(rows: DataFrame, marks: DataFrame, by: list[str], at: str, width: int, value: Column | None = None, name: str = "mark") -> DataFrame:
    """rows with `name`: the place (or `value`, a column over marks) of the last mark whose `at` is at or before the row's, null where there is none. at: a long in both; width: places that share a bucket."""
    key = [F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)]
    keys, bucket = [f"_by{i}" for i in range(len(by))], F.floor(F.col("_at") / width).alias("_bucket")
    mark = F.struct(F.col("_at").alias("at"), F.col("_value").alias("value"))
    m = marks.select(*key, F.col(f"`{at}`").cast("long").alias("_at"), (F.col(at) if value is None else value).alias("_value")).where(F.col("_at").isNotNull())
    m = m.select(*keys, "_at", bucket, mark.alias("_mark"), F.lit(None).cast(rows.schema).alias("_row"))
    r = rows.select(*key, F.col(f"`{at}`").cast("long").alias("_at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    r = r.select(*keys, "_at", bucket, F.lit(None).cast(m.schema["_mark"].dataType).alias("_mark"), "_row")
    both = m.unionByName(r)
    # What a bucket inherits: the last mark of all before it.
    ends = both.groupBy(*keys, "_bucket").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"{k}e") for k in keys], F.col("_bucket").alias("_of"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_mark", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}e"))
    return own.join(ends, same, "left").select("_row.*", F.coalesce("_own", "_carried")["value"].alias(name))


def next_marks(rows: DataFrame, marks: DataFrame, by: list[str], at: str, width: int, name: str = "mark") -> DataFrame:
    """rows with `name`: the place of the first mark at or after the row's."""
    turned = lambda df: df.withColumn("_turned", -F.col(f"`{at}`").cast("long"))
    return last_marks(turned(rows), turned(marks), by, "_turned", width, F.col(f"`{at}`"), name).drop("_turned")


def reached(starts: DataFrame, jumps: DataFrame, by: list[str]) -> DataFrame:
    """by, at: all places that are met from starts (by, at) along jumps (by, at, to), by pointer doubling: in as many rounds as the longest chain has binary digits. Every place has at most one jump, to a later place."""
    on = [*by, "at"]
    met, jumps = written(starts.select(*on).distinct(), "reached"), written(jumps.where(F.col("to").isNotNull()).select(*on, "to"), "jumps")
    n = met.count()
    while True:
        further = met.join(jumps, on).select(*by, F.col("to").alias("at"))
        met = written(met.unionByName(further).distinct(), "reached")
        now = met.count()
        if now == n:
            return met
        n = now
        second = jumps.select(*by, F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = written(jumps.join(second, [*by, "to"]).select(*on, F.col("beyond").alias("to")), "jumps")
