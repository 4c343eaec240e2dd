"""Derived views of the given tables, shaped like the logs, chunks and registries that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.operators import access
from corpusq.operators import index as I


#: Characters of a chunk, from one chunk's start to the next one's, and numbers kept for the chunks of one document.
WINDOW, STEP, MOST_CHUNKS = 4000, 3200, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of WINDOW characters, each STEP after the one before, so that any passage of 800 characters lies whole in one. Chunks stay well below the caps on terms and tokens."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    start = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(STEP))
    d = d.select("doc_id", "lang", "source", F.posexplode(F.transform(start, lambda s: F.substr("text", s + 1, F.lit(WINDOW)))).alias("chunk_index", "text"))
    return d.select(
        (F.col("doc_id") * MOST_CHUNKS + F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "text", "lang", "source", T.token_count(F.col("text")).alias("token_count"),
        F.array("lang", "source").alias("acl_tags"),
    )


def index(spark: SparkSession, sf_dir: str, live: bool = False) -> I.Index:
    """The session's index over the chunks, or over those of live documents: built where the documents' file is met for the first time or has changed since."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    s = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return I.kept(spark, (sf_dir, live, s.getLen(), s.getModificationTime()), lambda: access.live(chunks(spark, sf_dir), registry(spark, sf_dir)) if live else chunks(spark, sf_dir))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one chunk each, for operators that count chunks or look them up."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_index"), "text", "lang", "source", T.token_count(F.col("text")).alias("token_count"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("evidence"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    state = "case when doc_id % 10 <= 5 then 'live' when doc_id % 10 = 6 then 'disabled' when doc_id % 10 = 7 then 'failed' when doc_id % 10 = 8 then 'duplicate' else 'deleted' end"
    r = d.withColumn("state", F.expr(state)).withColumn("uploaded_at", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, cast(doc_id as int), 0)"))
    return r.withColumn("indexed_at", F.expr("case when state in ('live', 'disabled') then uploaded_at + make_dt_interval(0, 0, 0, doc_id % 97) end"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("ttft_ms", F.expr("case when event_type <> 'signup' then cast(floor(value * 20) as int) end"))
    return e.select(
        F.col("event_id").alias("query_id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("client"),
        F.concat(F.lit("q"), F.col("event_id") % 60).alias("original_query"), (F.col("event_type") == "error").alias("abstained"),
        F.expr("case event_type when 'purchase' then 'up' when 'view' then 'down' end").alias("feedback"), "ttft_ms", (F.col("ttft_ms") + F.col("k")).alias("total_ms"),
        F.col("k").alias("tokens_in"), (F.col("k") % 17).alias("tokens_out"),
        F.expr("case when day(ts) = 15 then 0 when day(ts) = 20 then 1 when k % 5 = 0 then 1 else 0 end").alias("citations_stripped"),
    )
