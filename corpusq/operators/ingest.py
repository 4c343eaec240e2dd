"""A batch of uploads, from files' texts to chunks, vectors and index terms, with an outcome for each document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.operators import chunking, intake, keyword, lifecycle, vectors
from corpusq.sources.streams import written


@dataclass(frozen=True)
class Ingested:
    """outcomes: doc_id, state, chunks, duplicate_of, detail; chunks with chunk_id and vector; terms: chunk_id, term, term_count; hashes: doc_id, content_hash of documents with chunks."""

    outcomes: DataFrame
    chunks: DataFrame
    terms: DataFrame
    hashes: DataFrame


#: What is said of documents that the registry holds in one of these states; they are left as they are.
LEFT_ALONE = {"live": "already indexed", "disabled": "disabled, not ingested", "deleted": "tombstoned, not ingested", "superseded": "tombstoned, not ingested"}


def ingest(uploads: DataFrame, registry: DataFrame | Callable[[str, DataFrame], DataFrame], strategy: str = "heading", width: int = 64, **sizes: int) -> Ingested:
    """Extraction, chunks, duplicates, vectors and terms of a batch (LIF6). A document that cannot be read fails with its reason and stops no other.

    uploads: doc_id (once each), filename, text, uploaded_at; registry: doc_id, content_hash, state, uploaded_at, or a function that looks its rows up by a column (doc_id or content_hash) of a table. A copy of a live document, or
    of an earlier one in the batch, is a duplicate without index rows. sizes: target, overlap and least of the chunks."""
    of = registry if callable(registry) else lambda column, values: registry
    u = uploads.select("doc_id", "filename", "text", "uploaded_at").join(of("doc_id", uploads).select("doc_id", F.col("state").alias("was")), "doc_id", "left")
    said = F.create_map(*[F.lit(x) for kv in LEFT_ALONE.items() for x in kv])
    kind = dict(uploads.dtypes)["doc_id"]
    nothing = F.lit(None).cast(kind).alias("duplicate_of")
    left = u.where(F.col("was").isin(*LEFT_ALONE)).select("doc_id", F.col("was").alias("state"), F.lit(0).cast("long").alias("chunks"), nothing, said[F.col("was")].alias("detail"))
    # Texts and chunks are written once; hashes, vectors and terms all read them.
    read = written(intake.extracted(u.where(F.col("was").isNull() | ~F.col("was").isin(*LEFT_ALONE)).drop("was")), "texts")
    drafts = written(chunking.chunk_documents(read.where("error_reason is null").select("doc_id", "filename", "text"), strategy, **sizes), "drafts")
    hashes = written(lifecycle.content_hash(drafts), "hashes")
    known = written(hashes.join(lifecycle.verdicts(hashes, of("content_hash", hashes)), "doc_id").join(read.select("doc_id", "uploaded_at"), "doc_id"), "verdicts")
    copies = known.where("verdict = 'duplicate'").select("doc_id", F.col("existing").alias("duplicate_of"))
    judged = lifecycle.batch_duplicates(known.where("verdict <> 'duplicate'")).unionByName(copies)
    judged = judged.join(drafts.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    r = read.select("doc_id", "error_reason").join(judged, "doc_id", "left")
    copy, failed = F.col("duplicate_of").isNotNull(), F.coalesce("error_reason", F.when(F.col("n").isNull(), "no chunks"))
    done = r.select(
        "doc_id", F.when(failed.isNotNull(), "failed").when(copy, "duplicate").otherwise("live").alias("state"),
        F.when(copy, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("chunks"), "duplicate_of",
        F.coalesce(failed, F.when(copy, F.format_string("duplicate of %s; not indexed", F.col("duplicate_of").cast("string")))).alias("detail"),
    )
    kept = drafts.join(judged.where(~copy).select("doc_id"), "doc_id", "left_semi").withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index"))
    chunks = kept.join(vectors.hash_embedding(kept.select("chunk_id", "text"), "chunk_id", width), "chunk_id")
    return Ingested(done.unionByName(left), chunks, keyword.postings(kept), known.select("doc_id", "content_hash"))
