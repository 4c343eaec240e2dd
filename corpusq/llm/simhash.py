"""SimHash near-duplicates by anchor-point covering.

Two fingerprints within 4 of 64 bits differ in at most 2 bits of one of their halves. For the halves, the
anchors are a perfect covering code: the Hamming code of 31 bits (every word lies within 1 bit of exactly one
anchor) times the free 32nd bit. Two halves that differ in 2 bits have a word between them, 1 bit from each, and
that word's anchor lies within 1 + 1 bits of both. So each distinct fingerprint goes to all anchors within
covering radius plus half the threshold, 2 bits, for both halves (about 32 rows), and is compared with the
fingerprints that meet it there.

Only distinct fingerprints are compared: copies meet in their fingerprint. An anchor with two fingerprints is
settled by a sum (least and greatest); those with more are cut into blocks of BLOCK, and pairs of blocks are
compared in tasks of their own, so a crowded anchor is spread. A task gives at most one link for each of its
fingerprints (to the least one it is connected with there), not all pairs. Links meet in components.components.

Defined cases: null, empty or blank text has fingerprint 0 and links like any other; a null doc_id is
ignored as a component's name unless no other is there; repeated rows give one output row per input row;
other columns of the input, however they are named, are kept by one_of_each() and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import row_hash, small_batches, stage, unused
from corpusq.llm.components import components

WORDS, SEED, BITS, DISTANCE = 4, 42, 64, 4
#: Fingerprints of one anchor that one task compares with each other, or with those of another block.
BLOCK = 512


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    if len(ws) <= words:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)], np.uint64)
    else:
        joined, at, ends = b" ".join(ws), 0, []
        for w in ws:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *ends]
        h = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs' doc_id, row1 and row2 (hashes of the row), and fp: the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(3).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp, pa.int64())], ["doc_id", "row1", "row2", "fp"])

    h1, h2 = row_hash(docs)
    return docs.select("doc_id", h1.alias("row1"), h2.alias("row2"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row1 long, row2 long, fp long")


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Of the Hamming code on bits 0 to 30 (bit i stands for number i + 1): 0 for a code word, else the number of the bit that is off."""
    out = np.zeros(len(x), np.uint64)
    for j in range(5):
        mask = np.uint64(sum(1 << i for i in range(31) if (i + 1) >> j & 1))
        out |= (np.bitwise_count(x & mask) & np.uint8(1)).astype(np.uint64) << np.uint64(j)
    return out


def anchors(half: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """All (index, anchor) with an anchor within 2 bits of half[index]; the free bit 31 may be one of the bits that differ."""
    half = half.astype(np.uint64)
    top, low = half & np.uint64(1 << 31), half & np.uint64((1 << 31) - 1)
    s = _syndromes(low)
    index = np.arange(len(half))
    flip = np.where(s > 0, np.uint64(1) << (np.maximum(s, 1) - np.uint64(1)), np.uint64(0))
    nearest = low ^ flip
    out = [(index, nearest | top), (index, nearest | (top ^ np.uint64(1 << 31)))]
    # Two bits a, b with a xor b equal to the syndrome lead to the other anchors at distance 2.
    for a in range(1, 32):
        b = s ^ np.uint64(a)
        ok = (s > 0) & (b > np.uint64(a))
        out.append((index[ok], (low[ok] ^ np.uint64(1 << (a - 1)) ^ (np.uint64(1) << (b[ok] - np.uint64(1)))) | top[ok]))
    return out


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp to (anchor, fp); the anchors of the two halves have different numbers."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for which, half in enumerate((fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))):
            got = anchors(half)
            index, anchor = np.concatenate([i for i, _ in got]), np.concatenate([a for _, a in got])
            name = (anchor | np.uint64(which << 32)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(fp[index].view(np.int64))], ["anchor", "fp"])


def _linked(key: np.ndarray, fp: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: (fp, least fp that it is connected with inside its key). side: 0 meets all, 1 and 2 meet each other only."""
    n, label = len(fp), np.arange(len(fp))
    us, vs = [], []
    _, start, count = np.unique(key, return_index=True, return_counts=True)
    end = np.repeat(start + count, count)
    rows = np.arange(n)
    for step in range(1, int(count.max(initial=1))):
        rows = rows[rows + step < end[rows]]
        near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= distance
        near &= (side[rows] == 0) | (side[rows] != side[rows + step])
        us.append(rows[near])
        vs.append(rows[near] + step)
    if not us or not (u := np.concatenate(us)).size:
        return fp[:0], fp[:0]
    v = np.concatenate(vs)
    while True:  # labels spread along the links until they are settled
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(n)
    return fp[moved], fp[label[moved]]


def _compare(distance: int):
    """Batches sorted by (anchor, a, b) to links; a group of rows is at most two blocks."""

    def links(table: pa.Table) -> pa.RecordBatch:
        col = [c.combine_chunks().to_numpy(zero_copy_only=False) for c in table.columns]
        key = np.cumsum(np.r_[True, (col[0][1:] != col[0][:-1]) | (col[1][1:] != col[1][:-1]) | (col[2][1:] != col[2][:-1])])
        u, v = _linked(key, col[3].view(np.uint64), np.where(col[1] == col[2], 0, col[4]), distance)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            # The last group may go on in the next batch.
            col = [held.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(3)]
            same = (col[0] == col[0][-1]) & (col[1] == col[1][-1]) & (col[2] == col[2][-1])
            cut = int(np.argmax(same))
            if cut:
                yield links(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield links(held)

    return run


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """fps: distinct fp, a table of stage(). Links (u, v) that connect all fingerprints within distance."""
    at = fps.select("fp").mapInArrow(_replicas, "anchor long, fp long")
    met = at.groupBy("anchor").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    met = stage(met)
    pairs = met.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")
    more = met.where("n > 2").select("anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # Spark sizes the replicas as their few fingerprints, so it would broadcast them.
    rows = at.join(more.hint("shuffle_merge"), "anchor").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int"))
    # Each block meets itself and every other block of its anchor: one group for each pair of blocks.
    with_blocks = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    with_blocks = with_blocks.select("anchor", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", F.when(F.col("own") <= F.col("other"), 1).otherwise(2).alias("side"))
    groups = with_blocks.repartition("anchor", "a", "b").sortWithinPartitions("anchor", "a", "b", "fp")
    return pairs.unionByName(groups.mapInArrow(_compare(distance), "u long, v long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, row1 and row2 (hashes of the row), fp, root (least fp reachable), component_id (smallest doc_id reachable)."""
    if distance > DISTANCE:
        raise ValueError("the anchors cover distances up to 4")
    fps = stage(fingerprints(docs, words))
    each = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(stage(links(each, distance).distinct())).select(F.col("node").alias("fp"), "root")
    # Smallest doc_id of each component, then of each fingerprint.
    named = each.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written first, so that Spark can split a component of very many fingerprints.
    least = stage(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = stage(named.join(least, "root").select("fp", "root", "component_id"))
    return fps.join(named, "fp").select("doc_id", "row1", "row2", "fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id, null last; of rows with one doc_id, that of the least hash. Equal rows are one."""
    of = F.struct(F.col("doc_id").isNull(), "doc_id", "row1", "row2")
    kept = near_duplicates(docs, words, distance).groupBy("root").agg(F.min(of).alias("row")).select("row.row1", "row.row2")
    one, two, at, to = unused(docs, "row1", "row2", "at", "to")
    h1, h2 = row_hash(docs)
    # One shuffle of the texts serves the join and the sorting out of equal rows.
    out = docs.withColumns({one: h1, two: h2}).join(kept.select(F.col("row1").alias(at), F.col("row2").alias(to)), (F.col(one) == F.col(at)) & (F.col(two) == F.col(to)))
    return out.dropDuplicates([one, two]).select(*[f"`{c}`" for c in docs.columns])
