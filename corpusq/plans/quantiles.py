"""Exact percentiles by distributed selection: no buffer holds a group's values, however large the group.

Groups of at most LEAF rows are sorted by a window. In larger ones each percentile has a bracket, at first all rows: a
sketch of bounded size over the bracket's rows proposes values on either side of the wanted rank, rows below and between
them are counted exactly, and the bracket shrinks to what lies between, some hundredths of a percent of the rows before.
After few rounds it holds one value, or few enough rows to be sorted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.sources.streams import written

#: Rows that one task sorts; steps and accuracy of the sketch.
LEAF, STEPS, ACCURACY = 100_000, 500, 10_000


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Equal groups; null is a group."""
    return reduce(lambda x, y: x & y, [a[f"`{c}`"].eqNullSafe(b[f"`_{c}`"]) for c in by], F.lit(True))


def _renamed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"_{c}") if c in by else F.col(f"`{c}`") for c in df.columns])


def _meet(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Each row beside its group's targets: the columns of rows, and those of targets but for the group's."""
    t = _renamed(targets, by)
    return rows.join(t, _same(rows, t, by)).drop(*[f"_{c}" for c in by])


def quantiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float], leaf: int = LEAF, steps: int = STEPS, seen: list | None = None) -> DataFrame:
    """by, and for each name in shares the linearly interpolated percentile of the non-null values; groups without values have no row. seen: takes the rows of the brackets of each round."""
    # Keys have names of their own here; without any, all rows share one.
    keys = [f"key{i}" for i in range(max(1, len(by)))]
    of = [F.col(f"`{c}`") for c in by] or [F.lit(0)]
    rows = written(df.select(*[c.alias(k) for c, k in zip(of, keys, strict=True)], value.cast("double").alias("x")).where(F.col("x").isNotNull()), "values")
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(s)).alias("share")) for name, s in shares.items()])).alias("w")
    t = n.select(*keys, "n", wanted).select(*keys, "w.name", "n", (F.col("w.share") * (F.col("n") - 1)).alias("at"))
    t = t.select(*keys, "name", F.col("n").alias("rows"), "at", F.floor("at").alias("lo"), F.ceil("at").alias("hi"), F.lit(0).cast("long").alias("before"))
    t = written(t, "targets")
    small = t.where(F.col("rows") <= leaf)
    found = _sorted(rows, small, keys)
    large = t.where(F.col("rows") > leaf)
    if not large.isEmpty():
        found = found.unionByName(_large(rows, large, keys, leaf, steps, seen))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=False)], *shares)


def with_quantiles(groups: DataFrame, df: DataFrame, by: list[str], value: Column, shares: dict[str, float], digits: int = 6) -> DataFrame:
    """groups (a row for each group of df, by its columns `by`) with rounded percentiles; null where a group has no values."""
    q = _renamed(quantiles(df, by, value, shares), by)
    out = groups.join(q, _same(groups, q, by), "left") if by else groups.join(q, F.lit(True), "left")  # one row each
    return out.select(*[groups[f"`{c}`"] for c in groups.columns], *[F.round(n, digits).alias(n) for n in shares])


def _sorted(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """by, name, value of targets whose bracket (all rows given of their group and name) is sorted."""
    per = [*by, "name"] if "name" in rows.columns else by
    met = rows if "name" in rows.columns else _meet(rows, targets.select(*by).distinct(), by)
    at = met.withColumn("i", F.row_number().over(Window.partitionBy(*per).orderBy("x")) - 1)
    t = _renamed(targets, per)
    hit = at.join(t, _same(at, t, per) & ((at["i"] + t["before"] == t["lo"]) | (at["i"] + t["before"] == t["hi"])))
    low, high = F.min("x"), F.max("x")
    name = F.col("_name") if "name" in rows.columns else F.col("name")
    got = hit.select(*[F.col(f"`_{c}`").alias(c) for c in by], name.alias("name"), "x", (F.col("at") - F.col("lo")).alias("part"))
    return got.groupBy(*by, "name").agg((low + (high - low) * F.first("part")).alias("value"))


def _large(rows: DataFrame, targets: DataFrame, by: list[str], leaf: int, steps: int, seen: list | None) -> DataFrame:
    """by, name, value of targets of large groups."""
    per = [*by, "name"]
    grid = [i / steps for i in range(steps + 1)]
    held = _meet(rows, targets.select(*per), by)
    done = None
    while True:
        sketch = held.groupBy(*per).agg(F.percentile_approx("x", grid, ACCURACY).alias("g"), F.min("x").alias("least"), F.max("x").alias("most"), F.count("*").alias("m"))
        s = _meet(targets, _named(sketch), by).where(F.col("name") == F.col("sketched")).drop("sketched")
        place = lambda rank: (F.col(rank) - F.col("before")) / F.greatest(F.col("m") - 1, F.lit(1)) * steps
        # A step more on either side than the sketch's error needs.
        low = F.when(place("lo") < 2, F.col("least")).otherwise(F.get("g", F.floor(place("lo")).cast("int") - 1))
        high = F.when(place("hi") > steps - 2, F.col("most")).otherwise(F.get("g", F.ceil(place("hi")).cast("int") + 1))
        s = written(s.select(*per, "at", "lo", "hi", "before", low.alias("a"), high.alias("b")), "brackets")
        both = _meet(held, _named(s.select(*per, "a", "b")), by).where(F.col("name") == F.col("sketched")).drop("sketched")
        count = both.groupBy(*per).agg(F.count_if(F.col("x") < F.col("a")).alias("under"), F.count_if(F.col("x").between(F.col("a"), F.col("b"))).alias("inside"))
        s = _meet(s, _named(count), by).where(F.col("name") == F.col("sketched")).drop("sketched")
        s = written(s.select(*per, "at", "lo", "hi", (F.col("before") + F.col("under")).alias("before"), "a", "b", "inside"), "counted")
        # Where the sketch was off, which its bound rules out, the ranks would lie outside.
        if s.where((F.col("lo") < F.col("before")) | (F.col("hi") >= F.col("before") + F.col("inside"))).count():
            raise ValueError("a bracket lost its rank")
        if seen is not None:
            seen.append(s.agg(F.sum("inside")).first()[0])
        one = s.where(F.col("a") == F.col("b")).select(*per, F.col("a").alias("value"))
        few = s.where((F.col("a") < F.col("b")) & (F.col("inside") <= leaf))
        got = one.unionByName(_sorted(_inside(held, few, per, by), few.select(*per, "at", "lo", "hi", "before"), by))
        done = got if done is None else done.unionByName(got)
        targets = s.where((F.col("a") < F.col("b")) & (F.col("inside") > leaf))
        if targets.isEmpty():
            return done
        held = written(_inside(held, targets, per, by), "bracket")
        targets = targets.select(*per, "at", "lo", "hi", "before")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("name", "sketched")


def _inside(held: DataFrame, brackets: DataFrame, per: list[str], by: list[str]) -> DataFrame:
    """by, name, x of held's rows that lie in their bracket."""
    met = _meet(held, _named(brackets.select(*per, "a", "b")), by)
    return met.where((F.col("name") == F.col("sketched")) & F.col("x").between(F.col("a"), F.col("b"))).select(*per, "x")
