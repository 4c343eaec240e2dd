"""Mixing sources to target weights along a curriculum.

Targets: the sources' weights share a total, and no source gives more than `most` times its size; what is over
goes to the others by weight (a few rounds over one row for each source).

Inside a source, documents stand in the order of a hash. The running sum of their sizes, counted in whole
passes over the source, is its cumulative demand; a document is taken in each pass whose part lies below the
target, so documents are taken 0, 1, 2, ... times and a source ends within one document of its target.

Curriculum: each source's weight changes linearly with training time t in [0, 1] from `1 + slope` to
`1 - slope` times its mean. The integral of that schedule is the demand by time t; inverting it at a document's
place in its source's running sum gives its position. Documents are range-sorted by position.

Running sums take two steps, so that no source is one task: sums of hash buckets, then sums inside a bucket.

Defined cases: null or empty text has size 0 and is never counted against a target; a null source is a source of
its own, after all others; null doc_id and repeated rows give one output row per input row; sources of size 0 have target 0;
other columns of the input, however they are named, are kept by mixed() and ignored by mix().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import WORD, row_hash, stage, unused

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Rows of one source that share a bucket, on average.
BUCKET_ROWS = 250
#: How much the weights of the first, second and third kind of source change along the curriculum.
SLOPES = (0.5, 0.0, -0.5)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the row's hashes row1 and row2."""
    h1, h2 = row_hash(docs)
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h1.alias("row1"), h2.alias("row2"))


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size to source, source_size, weight, slope, target. Works on one row for each source, as windows and sums."""
    # Code-point order, null last. Without a partition column this is one task, over one row for each source.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(order) - 1) % len(weights)
    t = by_source.withColumn("kind", kind)
    t = t.withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("kind") + 1).cast("int")),
        "slope": F.element_at(F.array(*[F.lit(float(x)) for x in SLOPES]), (F.col("kind") % len(SLOPES) + 1).cast("int")),
        "cap": F.col("source_size") * F.lit(most),
    })
    # Water level: sources fill up in order of cap / weight; the level is where the first k full ones leave the rest its share.
    w = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = t.withColumns({
        "total": F.lit(share) * F.sum("source_size").over(everything),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    t = t.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    t = t.withColumn("stays", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    t = t.withColumn("water", F.first("stays", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water")))
    return t.select("source", "source_size", "weight", "slope", target.cast("double").alias("target"))


def position(at: F.Column, slope: F.Column):
    """Inverts demand(t) = (1 + slope) t - slope t^2 at a share of the demand."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + slope) * (1 + slope) - 4 * slope * at))
    return F.when(slope == 0, at).otherwise((1 + slope - root) / (2 * slope))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken and position of the first pass (null where it is not taken); row1, row2, middle and slope serve mixed()."""
    base = stage(sizes(docs).withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.hex("row1"))))))
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stage(targets(by_source, weights, share, most))
    buckets = max(1, min(1 << 24, base.count() // BUCKET_ROWS))
    rows = base.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("double") / float(1 << 28) * buckets).cast("int"))
    # First step: one row for each source and bucket. Second: inside a bucket.
    one = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    one = one.select(F.col("source").alias("of"), F.col("bucket").alias("number"), F.coalesce(F.sum("s").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "row1", "row2")
    rows = rows.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(one, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("number")), "left").drop("of", "number")
    g = goal.select(F.col("source").alias("of"), "source_size", "target", "slope")
    rows = rows.join(g, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    start = F.col("before") + F.col("within") - F.col("size")
    # In pass p the document starts at start + p * source_size; it is taken if its middle lies below the target.
    middle = start + F.col("size") / 2
    times = F.when((F.col("size") == 0) | (F.col("source_size") == 0), 0).otherwise(
        F.least(F.lit(int(most)), F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size")))).cast("int")
    )
    rows = rows.withColumns({"times": times, "middle": middle})
    at = F.least(F.lit(1.0), F.col("middle") / F.col("target"))
    rows = rows.withColumns({"taken": F.col("times") * F.col("size"), "position": F.when(F.col("times") > 0, position(at, F.col("slope")))})
    return rows.select("doc_id", "source", "size", "source_size", "target", "times", "taken", "position", "row1", "row2", "middle", "slope")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as training reads it: docs' columns, each row once for each time it is taken, at the position of that pass, range-sorted.

    Sums and positions are made from ids and sizes. Whole rows are shuffled twice: once to meet their positions, once to their places.
    """
    plan = mix(docs, **options).where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    at = F.least(F.lit(1.0), (F.col("middle") + F.col("pass") * F.col("source_size")) / F.col("target"))
    one, two, to1, to2, place = unused(docs, "row1", "row2", "to1", "to2", "place")
    plan = plan.select(F.col("row1").alias(to1), F.col("row2").alias(to2), position(at, F.col("slope")).alias(place))
    # Equal rows stand once on this side and once for each of them in the plan. The join's keys are those of the sorting out, so both take one shuffle.
    h1, h2 = row_hash(docs)
    once = docs.withColumns({one: h1, two: h2}).dropDuplicates([one, two])
    out = once.join(plan, (F.col(one) == F.col(to1)) & (F.col(two) == F.col(to2)))
    return out.orderBy(place, one, two).select(*[f"`{c}`" for c in docs.columns])
