"""Line deduplication with two Bloom filters.

1. Each task sets the bits of its lines' hashes in two bit maps: seen once, seen twice. The maps of all tasks
   are merged (a bit that two tasks set becomes twice-seen), in two steps so that no task reads more than a
   fixed number of maps at once. The merged twice-seen map has a fixed size, whatever the input, and only it
   is sent to the tasks.
2. Only lines whose bits are all set in the twice-seen map are shuffled, as digests with their document, and
   counted exactly. A filter that is too full lets more lines through; it never loses one.
3. Lines that occur in enough documents are dropped everywhere except in the document that keeps them.

Defined cases: null or empty text is one empty line and its kept text is empty; rows with equal doc_id count
as one document when documents are counted, and each gives an output row; a null doc_id counts as one more
document, smaller than all others; other columns of the input, however they are named, are kept by line_dedup()
(but its own n_lines and n_dropped take the place of columns of these names) and ignored by digest().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import small_batches, stage, unused

MIN_CHARS, MIN_DOCS = 20, 3
#: Bits of either filter: 8 MB each when packed. SEGMENT bits travel in one row.
BITS, SEGMENT = 1 << 26, 1 << 20
#: Partial maps that are merged in the first of the two steps.
FAN = 64
#: Drop lists of so many lines at most are broadcast; longer ones are joined by shuffling both sides.
BROADCAST_LINES = 2_000_000

_BLANK = b" \t\n\x0b\x0c\r"


def keys(text: bytes | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines that are long enough."""
    out = []
    for i, line in enumerate((text or b"").split(b"\n")):
        k = line.strip(_BLANK).lower()
        # As bytes are at least as many as code points, few lines need the exact count.
        if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars):
            out.append((i, k))
    return out


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask


def _marks(bits: int, min_chars: int):
    """Batches of (doc_id, text) to (segment, part, once, twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for b in batches:
            seen: list[int] = []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                # A key counts once for each row, so that lines repeated inside one text don't raise suspicion.
                seen += {xxhash.xxh64_intdigest(k) for _, k in keys(t, min_chars)}
            h = np.array(seen, np.uint64)
            for p in positions(h, bits):
                p = p.astype(np.int64)
                at, n = np.unique(p, return_counts=True)
                twice[at[(n > 1) | once[at]]] = True
                once[at] = True
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(1).compress
        size = min(SEGMENT, bits)
        for s in range(bits // size):
            piece = slice(s * size, (s + 1) * size)
            if once[piece].any():
                yield _row(s, part, pack(np.packbits(once[piece]).tobytes()), pack(np.packbits(twice[piece]).tobytes()))

    return run


def _row(segment: int, part: int, once: bytes, twice: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([segment], pa.int32()), pa.array([part], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())],
        ["segment", "part", "once", "twice"],
    )


_MARKS = "segment int, part int, once binary, twice binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment and part to one row for each; one pair of maps is held at a time."""
    pack, unpack = zstandard.ZstdCompressor(1).compress, zstandard.ZstdDecompressor().decompress
    now, once, twice = None, None, None
    for b in batches:
        for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            o, t = (np.frombuffer(unpack(x), np.uint8) for x in key[2:])
            if now == key[:2]:
                twice = twice | t | (once & o)
                once = once | o
                continue
            if now:
                yield _row(*now, pack(once.tobytes()), pack(twice.tobytes()))
            now, once, twice = key[:2], o, t
    if now:
        yield _row(*now, pack(once.tobytes()), pack(twice.tobytes()))


def twice_seen(docs: DataFrame, bits: int = BITS, min_chars: int = MIN_CHARS) -> bytes:
    """The merged twice-seen filter: bits / 8 bytes, whatever the input."""
    marks = docs.select("text").mapInArrow(_marks(bits, min_chars), _MARKS)
    for part in (F.col("part") % FAN, F.lit(0)):
        marks = marks.withColumn("part", part.cast("int")).repartition("segment", "part").sortWithinPartitions("segment", "part").mapInArrow(_merged, _MARKS)
    size = min(SEGMENT, bits)
    out = bytearray(bits // 8)
    for r in marks.select("segment", "twice").collect():  # bits / SEGMENT rows
        out[r.segment * size // 8 : (r.segment + 1) * size // 8] = zstandard.ZstdDecompressor().decompress(bytes(r.twice))
    return bytes(out)


def _row_key() -> list[Column]:
    return [F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")]


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int = BITS, keep: str = "max") -> DataFrame:
    """d (doc_id), h (hash of the text), lines: the numbers of the lines that go; only documents that lose lines."""
    spark = docs.sparkSession
    small_batches(spark)
    once = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(zstandard.ZstdCompressor(1).compress(twice_seen(once, bits, min_chars)))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), np.uint8)
        for b in batches:
            where, digests, hashes, lines = [], [], [], []
            for i, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                at: dict[bytes, list[int]] = {}
                for n, k in keys(t, min_chars):
                    at.setdefault(k, []).append(n)
                for k, ns in at.items():
                    where.append(i)
                    hashes.append(xxhash.xxh64_intdigest(k))
                    digests.append(k)
                    lines.append(ns)
            h = np.array(hashes, np.uint64)
            hit = np.ones(len(h), bool)
            for p in positions(h, bits):
                hit &= (twice[p >> np.uint64(3)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            found = np.flatnonzero(hit).tolist()
            if found:
                rows = pa.array([where[i] for i in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array([xxhash.xxh3_128_digest(digests[i]) for i in found], pa.binary()), pa.array([lines[i] for i in found], pa.list_(pa.int32()))],
                    ["d", "h", "digest", "lines"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    seen = stage(once.select(*_row_key(), "text").mapInArrow(suspects, f"d {kind}, h long, digest binary, lines array<int>"))
    # Exact: documents of each line, summed before the shuffle.
    by_doc = seen.groupBy("digest", "d").agg(F.lit(1).alias("one"))
    by_line = by_doc.groupBy("digest").agg(F.count("one").alias("n"), (F.max if keep == "max" else F.min)("d").alias("keeper")).where(F.col("n") >= min_docs)
    # A line that a third of all documents share is one key here. Spark splits such partitions of a join
    # if both sides are shuffled for it; as a written table, the sums' own partitioning can't be taken over.
    by_line = stage(by_line)
    gone = seen.join(by_line, "digest").where(~F.col("d").eqNullSafe(F.col("keeper")))
    return gone.groupBy("d", "h").agg(F.flatten(F.collect_set("lines")).alias("lines"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int = BITS, keep: str = "max", counts: bool = True) -> DataFrame:
    """docs with text replaced by the kept lines; with counts, n_lines and n_dropped are added."""
    gone = stage(dropped_lines(docs, min_chars, min_docs, bits, keep))
    n = gone.select(F.sum(F.size("lines"))).first()[0] or 0
    doc, text_hash, lines, own, all_lines = unused(docs, "d", "h", "lines", "own", "all_lines")
    gone = gone.select(F.col("d").alias(doc), F.col("h").alias(text_hash), F.col("lines").alias(lines))
    gone = F.broadcast(gone) if n <= BROADCAST_LINES else gone
    out = docs.withColumn(own, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(text_hash)), "left")
    text = F.coalesce("text", F.lit(""))
    # Exploded from an array of one, so that Spark splits a text once and not again in each place that uses its lines.
    out = out.withColumn(all_lines, F.explode(F.array(F.split(text, "\n", -1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(lines))
    kept = F.when(F.col(lines).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(all_lines), i)), "\n"))
    new = {"text": kept}
    if counts:
        new |= {"n_lines": F.size(all_lines).cast("long"), "n_dropped": F.coalesce(F.size(lines), F.lit(0)).cast("long")}
    names = docs.columns + [c for c in new if c.lower() not in {x.lower() for x in docs.columns}]
    return out.withColumns(new).select(*[f"`{c}`" for c in names])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
