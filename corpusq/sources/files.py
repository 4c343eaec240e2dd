"""Files in and out: corpora, evaluation sets, chunk tables, dumps, snapshots, logs."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.intake import extension

#: Folders that hold no documents.
LEFT_OUT = [".git", ".venv", "node_modules", "__pycache__"]


#: Files that a task puts into one folder.
IN_FOLDER = 1_000


def write_each(texts: DataFrame, key: str, folder: str) -> None:
    """Each row of texts (key: a number, text: not null) as a text file of its own below `folder`; its path holds key=value.

    Where all executors share the folder as a file system, tasks write the files themselves: Hadoop's writer starts processes for a file's rights and takes some 30 ms
    a file. A file gets its name when it is whole, and the same one if its task runs again. In other stores Spark writes a folder for each key."""
    spark = texts.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    if at.getScheme() != "file":
        # Tasks move their files into place: the driver would move them one by one.
        texts.withColumn("text", F.expr("substring(text, 1, length(text) - 1)")).write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(folder)
        return
    base = at.getPath()
    os.makedirs(base, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, n = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        for b in batches:
            # Bytes go out as they are; no text is decoded.
            for value, text in zip(b.column(0).to_pylist(), b.column(1).cast("large_binary")):
                if n % IN_FOLDER == 0:
                    os.makedirs(into := f"{base}/{part:05d}-{n // IN_FOLDER:05d}", exist_ok=True)
                draft = f"{into}/.{n}-{attempt}"  # Spark's readers leave out names that begin so
                with open(draft, "wb", buffering=0) as f:
                    f.write(memoryview(text.as_buffer()))
                os.replace(draft, f"{into}/{key}={value}-{n}.txt")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    texts.select(key, "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one row


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, extension, size of files of known types in a folder and those below it (SRC1); contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
    f = f.withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("extension", extension(F.col("filename")))
    return f.where(F.col("extension").isNotNull() & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, LEFT_OUT)))).orderBy("path")


def plain_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, text of text and Markdown files; bytes that are no UTF-8 become the replacement sign (SRC2)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    f = f.withColumn("filename", F.element_at(F.split("path", "/"), -1)).where(extension(F.col("filename")).isin(".txt", ".md", ".markdown"))
    return f.select("path", "filename", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def live_chunks(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Embedded chunks of live documents (SRC3)."""
    return chunks.where("embedding is not null").join(registry.where("state = 'live'").select("doc_id"), "doc_id", "left_semi")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank and broken lines are left out (SRC4, SRC5)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def replace_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes documents' whole chunk sets (SNK1). chunks holds all documents of the buckets it touches; other buckets stay as they are."""
    out = chunks.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)


def dump_scores(ranked: DataFrame, path: str) -> None:
    """One JSON line for each candidate, keys in order (SNK2)."""
    ranked.select(F.to_json(F.struct(*sorted(ranked.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def chunk_dump(chunks: DataFrame, docs: DataFrame, name_part: str = "", limit: int | None = None, shown: int = 8) -> DataFrame:
    """filename, chunk_index, text, first components and length of the vector, in order (SNK3)."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = docs.where(F.contains("filename", F.lit(name_part))).select("doc_id", "filename")
    out = chunks.join(d, "doc_id").select("filename", "chunk_index", "text", F.slice("embedding", 1, shown).alias("preview"), F.round(size, 6).alias("norm")).orderBy("filename", "chunk_index")
    return out if limit is None else out.limit(limit)


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    """Adds a sweep's snapshot (SNK4)."""
    snapshot.write.mode("append").json(path)


def log_rows(found: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, abstained, top_score, scores: the scores of each candidate by stage, without nulls (SNK5)."""
    stages = ["keyword", "vector", "fused", "reranked"]
    m = F.map_filter(F.create_map(*[x for s in stages for x in (F.lit(s), F.col(s))]), lambda k, v: v.isNotNull())
    s = found.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("chunk_id").cast("string"), F.to_json(m))))).alias("scores"))
    return results.select("query_id", "abstained", "top_score").join(s, "query_id", "left")
