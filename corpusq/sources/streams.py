"""Streams over folders of files, run to their present end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, or on this machine where Spark runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc = spark.sparkContext
        if not hasattr(sc, "_corpusq_shared"):
            sc._corpusq_shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = sc._corpusq_shared
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written once to the shared folder and read again: what follows does not compute them anew, and lost executors lose nothing. The table is deleted when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusq_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._corpusq_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_stream(spark: SparkSession, path: str, batch_bytes: int = 256 << 20) -> DataFrame:
    """A stream over a folder's parquet files, oldest first; micro-batches of about batch_bytes bound what a key's state sees at once."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)


def run_to_end(result: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming result over all files that are there and returns what it wrote."""
    spark = result.sparkSession
    out = shared_path(spark, "stream")
    query = result.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", shared_path(spark, "state")).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)
