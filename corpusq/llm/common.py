"""What several operators share: reading tables, cutting lineage, batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that one Arrow batch may carry to a Python worker.
BATCH_ROWS = 2_000
BATCH_BYTES = "16m"

#: Words are separated by these six characters only: space, \t, \n, \v, \f, \r.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once; long texts would otherwise fill it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a folder of this machine if Spark runs on it alone."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(sc, "_corpusq_dir"):
        sc._corpusq_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return sc._corpusq_dir


def stage(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: later jobs start from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusq-{uuid.uuid4().hex}"
    # Deleted when the driver ends: results may be read until then.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusq_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of stage() that nothing reads any more."""
    path = getattr(df, "_corpusq_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _told_apart(c: Column, kind: T.DataType, seed: int) -> Column:
    """c in a form whose hash tells nulls inside it from nothing, and that maps and variants have as well."""
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x: _told_apart(x, kind.elementType, seed))
        return F.struct(c.isNull(), F.size(c), inner)
    if isinstance(kind, T.StructType):
        return F.struct(c.isNull(), *[_told_apart(c.getField(f.name), f.dataType, seed) for f in kind.fields])
    if isinstance(kind, T.MapType):
        # Maps are equal whatever the order of their entries.
        entry = lambda e: F.xxhash64(F.lit(seed), _told_apart(e["key"], kind.keyType, seed), _told_apart(e["value"], kind.valueType, seed))
        return F.struct(c.isNull(), F.sort_array(F.transform(F.map_entries(c), entry)))
    if isinstance(kind, T.VariantType):
        return F.struct(c.isNull(), F.schema_of_variant(c), F.to_json(c))
    return F.struct(c.isNull(), c)


def row_hash(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row: equal rows have equal ones, and rows that differ anywhere, inside arrays, structs, maps and variants too, have others."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    cols = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c, _ in cols.values()])
    return [F.xxhash64(F.lit(seed), nulls, *[_told_apart(c, t, seed) if isinstance(t, nested) else c for c, t in cols.values()]) for seed in (1, 2)]


def lower_ascii(col):
    """A-Z lower-cased, other letters left as they are."""
    return F.translate(col, UPPER, LOWER)


def _letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable bytes of Latin-1 as themselves, the others from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _letters()


def byte_letters(text: str) -> str:
    """text's UTF-8 bytes as a byte-level vocabulary writes them."""
    return text if text.isascii() and text.isalpha() else text.encode("utf-8").decode("latin-1").translate(_LETTERS)
