"""A corpus pipeline: documents are filtered, thinned, mixed and packed, stage by stage; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import classifier, line_dedup, mixing, packing, simhash
from corpusq.llm.common import read, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.5 or more)."""
    weights = classifier.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return classifier.accepted(docs, weights)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; n_chars follows."""
    return line_dedup.line_dedup(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the curriculum, each as often as its source's target takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed_pieces(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing to target weights", mix), ("best-fit packing", pack)]

#: The classifier and the tokenizer are no SQL; tests/llm/test_pipeline.py holds run() against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "documents")
    for _, f in STAGES:
        out = stage(f(spark, out, sf_dir))
    return out
