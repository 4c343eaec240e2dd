"""Connected components of a table of links, by large-star and small-star rounds.

A round joins each node to the smallest node around it with two joins and sums; it never collects the
neighbours of a node. Rounds end when the links no longer change; their number grows with the logarithm of
the longest chain. Each round is written to the shared folder, so lost executors cost no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import discard, stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u > v. Large: larger neighbours go to the smallest of a node's neighbours and itself. Small: smaller ones and itself."""
    # Sums are written before they are joined. As a written table they don't share the links' partitioning, so Spark
    # may broadcast them or split the one partition of a node that a third of all links meet.
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = stage(links.groupBy("u").agg(F.min("v").alias("m")))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = stage(out.where("u <> v").distinct())
    discard(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """links (u, v) to (node, root): root is the smallest node that node reaches. Nodes without links are absent."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = stage(links)
    mark = _mark(now)
    while True:
        half = _star(now, large=True)
        new = _star(half, large=False)
        discard(half)
        discard(now)
        now, before = new, mark
        mark = _mark(now)
        if mark == before:
            break
    # Now every node but the roots has one link, to its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)
