"""Queries of sources and sinks: tables are written to new paths in the shared folder, read back, and compared with what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq import fixtures as X
from corpusq.queries import SQL, _bm25, query
from corpusq.queries_answers import _SNAP, snapshots
from corpusq.sources import files, streams


def _id():
    """The id that names a file."""
    return F.regexp_extract("path", r"doc_id=(-?\d+)", 1).cast("long").alias("doc_id")


def _folder(spark, sf_dir) -> str:
    """Every document as a text file of its own, named by its id."""
    path = streams.shared_path(spark, "corpus")
    files.write_each(X.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text")), "doc_id", path)
    return path


@query("select doc_id, '.txt' as extension, octet_length(encode(coalesce(text, ''))) + 1 as size from documents")
def src1_corpus(spark, sf_dir):
    return files.corpus(spark, _folder(spark, sf_dir)).select(_id(), "extension", "size")


@query("select doc_id, coalesce(text, '') || chr(10) as text from documents")
def src2_plain_texts(spark, sf_dir):
    return files.plain_texts(spark, _folder(spark, sf_dir)).select(_id(), "text")


def _lines(spark, sf_dir) -> str:
    """The documents as JSON lines, with blank and broken lines between them."""
    path = streams.shared_path(spark, "lines")
    line = F.to_json(F.struct("doc_id", "text", "lang"), {"ignoreNullFields": "false"})
    d = X.table(spark, sf_dir, "documents").withColumn("line", line)
    cut = F.when(F.col("doc_id") % 3 == 0, F.array("line", F.lit(""))).when(F.col("doc_id") % 3 == 1, F.array("line", F.expr("substring(line, 1, 12)"))).otherwise(F.array("line"))
    d.select(F.explode(cut).alias("value")).write.text(path)
    return path


@query("select doc_id, text, lang from documents")
def src4_src5_json_rows(spark, sf_dir):
    return files.json_rows(spark, _lines(spark, sf_dir), "doc_id long, text string, lang string")


def _replaced(chunks: DataFrame, changed: str, buckets: int = 16) -> DataFrame:
    """The chunks of changed documents with new texts, with all others of the buckets that they fall in."""
    b = chunks.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    touched = F.broadcast(b.where(changed).select("b").distinct())  # at most `buckets` rows
    return b.join(touched, "b", "left_semi").drop("b").withColumn("text", F.when(F.expr(changed), F.concat(F.lit("new "), "text")).otherwise(F.col("text")))


@query("select doc_id as chunk_id, doc_id, case when doc_id % 97 = 5 then 'new ' || text else text end as text from documents")
def snk1_replaced_chunks(spark, sf_dir):
    path = streams.shared_path(spark, "chunks")
    c = X.whole(spark, sf_dir).select("chunk_id", "doc_id", "text")
    files.replace_chunks(c, path, 16)
    files.replace_chunks(_replaced(c, "doc_id % 97 = 5"), path, 16)
    return spark.read.parquet(path).drop("doc_bucket")


@query(SQL["kw5_bm25"])
def snk2_dumped_scores(spark, sf_dir):
    path = streams.shared_path(spark, "scores")
    files.dump_scores(_bm25(spark, sf_dir, 10), path)
    return files.json_rows(spark, path, "query_id long, chunk_id long, score double, rank int")


@query(f"with {_SNAP} select cast(seq as bigint) as seq, cast(n as bigint) as n, dataset, cast(threshold as double) as threshold, joint from snap")
def snk4_snapshots(spark, sf_dir):
    """Two sweeps one after the other, read as one history."""
    path = streams.shared_path(spark, "history")
    s = snapshots(spark, sf_dir).select("seq", "n", "dataset", "threshold", "joint")
    for sweep in ("seq % 2 = 0", "seq % 2 = 1"):
        files.append_snapshot(s.where(sweep), path)
    return files.json_rows(spark, path, "seq long, n long, dataset string, threshold double, joint boolean")
