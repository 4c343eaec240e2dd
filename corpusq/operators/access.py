"""Who may see what: live documents and access tags, applied before any ranking is cut to its best k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks of documents that are live (FLT1). registry: doc_id, state."""
    return chunks.join(registry.where("state = 'live'").select("doc_id"), "doc_id", "left_semi")


def permits(grants: Column, tags: Column) -> Column:
    """Whether grants open a row with these tags: none at all open everything, else one must be among the tags (FLT2)."""
    some = F.coalesce(F.size(grants), F.lit(0)) > 0
    return ~some | F.coalesce(F.arrays_overlap(F.coalesce(tags, F.expr("cast(array() as array<string>)")), grants), F.lit(False))


def permitted(pairs: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """pairs (query_id, chunk_id, ...) whose query's grants permit the chunk's acl_tags. Where queries have no grants column, all of them."""
    if "grants" not in queries.columns:
        return pairs
    tags = chunks.select("chunk_id", "acl_tags")
    return pairs.join(queries.select("query_id", "grants"), "query_id").join(tags, "chunk_id").where(permits(F.col("grants"), F.col("acl_tags"))).drop("grants", "acl_tags")
