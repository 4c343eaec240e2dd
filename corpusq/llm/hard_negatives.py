"""Hard negatives by Four-Russians scoring.

Vectors become integers, and candidates become bit planes: for each bit and each group of eight dimensions, one
byte holds that bit of the eight components. For an anchor, a table of 256 sums for each group of eight of its
components tells what any such byte adds. A score is then looked up, not multiplied: planes are taken from the
highest (the sign's, which counts negative) to the lowest, the sum so far is doubled, and the groups' entries are
added. Scores are exact 64-bit integers.

Candidates lie in blocks of at most BLOCK rows, sorted by label and vec_id, anchors in blocks of at most ANCHORS
rows. Each block of anchors meets each block of candidates once in either of two passes: the first scores rows of
the anchors' labels only and gives the positives, the second all other rows and gives the negatives of every
positive. Pairs of blocks are dealt out by the anchors' block and by a hash of the candidates', so no block is a
hot key and neither side is broadcast; a task keeps its best rows over all candidates of an anchors' block and
passes on no more. The work is that of all pairs of an anchor and a row, as exact scores need; it has no groups, so
a label that holds a third of the rows costs what any other label costs.

Defined cases: rows with a null label or vec_id, a null or empty vector, null or non-finite components, or a squared
length in integers over 2^62 (their products may be no longs) take no part; shorter vectors count as filled with 0;
repeated rows count once for each row, as anchors, positives and negatives, but rows with the anchor's vec_id are
none of its positives or negatives; ties go to the smaller vec_id; an anchor without positives, or a positive without
negatives in its band, gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import small_batches, stage
from corpusq.llm.topk import LONGEST, SCALE, _floor, _matrix

#: Rows of a block of candidates and of anchors, and bytes that the anchors of a block may have.
BLOCK, ANCHORS, ANCHOR_BYTES = 2048, 4096, 2 << 20
#: Positives of an anchor, negatives of a positive, and the least share (in percent) of the positive's score.
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
#: Tasks that share the candidates for one block of anchors.
TASKS = 64


def usable(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label and x (integers) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    v = v.where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    v = v.select("vec_id", "label", F.transform("embedding", lambda c: _floor(scale * c.cast("double"))).alias("x"))
    v = v.where(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c) <= float(LONGEST))
    return v.select("vec_id", "label", F.transform("x", lambda c: c.cast("long")).alias("x"))


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of shape (bits, groups of eight dimensions, rows), the lowest bit first; the highest is the sign's."""
    n, width = x.shape
    full = np.zeros((n, -(-width // 8) * 8), np.int64)
    full[:, :width] = x
    out = np.empty((bits, full.shape[1] // 8, n), np.uint8)
    for b in range(bits):
        out[b] = np.packbits((full >> b & 1).astype(np.uint8), axis=1, bitorder="little").T
    return out


def bits_of(x: np.ndarray) -> int:
    """Bits of the largest component, its sign included."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1, 0)
    return most.bit_length() + 1


def subset_sums(a: np.ndarray) -> np.ndarray:
    """For each group of eight components of an anchor, the sums of all 256 subsets."""
    groups = np.zeros(-(-len(a) // 8) * 8, np.int64)
    groups[: len(a)] = a
    groups = groups.reshape(-1, 8)
    out = np.zeros((len(groups), 256), np.int64)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + groups[:, j : j + 1]
    return out


class Candidates:
    """A block of candidates, sorted by label and id; places[b, g, i] is where row i's byte stands in the tables of an anchor."""

    def __init__(self, r: dict):
        self.ids, self.labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
        got = np.frombuffer(r["planes"], np.uint8).reshape(r["bits"], -1, len(self.ids))
        self.places = got.astype(np.intp) + 256 * np.arange(got.shape[1])[None, :, None]

    def scores(self, sums: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Exact scores of the rows lo..hi with the anchor whose sums these are."""
        flat = sums.reshape(-1)
        top = len(self.places) - 1
        total = np.zeros(hi - lo, np.int64)
        for b in range(top, -1, -1):
            part = flat[self.places[b, :, lo:hi]].sum(axis=0)
            total = total + total - part if b == top else total + total + part
        return total


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, best first."""
    at = np.arange(len(ids))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _blocks(rows: DataFrame, size: int, planar: bool) -> DataFrame:
    """rows, in their order within a partition, as blocks: block, n, ids, labels, keys, width, and bit planes or plain components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            width = max(np.diff(np.asarray(batch.column(3).offsets)).max(initial=0), 1)
            x = _matrix(batch.column(3), int(width))
            bits = bits_of(x) if planar else 0
            body = planes(x, bits).tobytes() if planar else x.astype("<i8").tobytes()
            ints = [np.asarray(batch.column(i)).astype("<i8").tobytes() for i in range(3)]
            cols = [(part << 33) + count, len(x), *ints, int(width), bits, body]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cols], ["block", "n", "ids", "labels", "keys", "width", "bits", "planes"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= size:
                whole = pa.concat_batches(held)
                yield out(whole.slice(0, size))
                count, held, n = count + 1, [whole.slice(size)], n - size
        if n:
            yield out(pa.concat_batches(held))

    return rows.select("vec_id", "label", "key", "x").mapInArrow(pack, "block long, n long, ids binary, labels binary, keys binary, width long, bits long, planes binary")


def _paired(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of candidates, sorted by the former."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(TASKS - 1))).alias("slot")
    a = anchors.select(F.col("block").alias("a"), F.struct("ids", "labels", "keys", "width", *[c for c in ("planes", "positives") if c in anchors.columns]).alias("anchors"), slots)
    # All blocks of anchors are one row each of a table of numbers: a millionth of the rows.
    numbers = anchors.agg(F.collect_list("block").alias("all"))
    c = candidates.select("n", "ids", "labels", "bits", "planes", F.pmod(F.xxhash64("block"), F.lit(TASKS)).cast("int").alias("slot"))
    c = c.join(F.broadcast(numbers)).select(F.explode("all").alias("a"), "slot", F.struct("ids", "labels", "bits", "planes").alias("candidates"))
    return c.join(a, ["a", "slot"]).sortWithinPartitions("a", "slot")


def _anchors(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, keys = (np.frombuffer(r[c], "<i8") for c in ("ids", "labels", "keys"))
    return ids, labels, keys, np.frombuffer(r["planes"], "<i8").reshape(len(ids), r["width"])


def _fit(a: np.ndarray, groups: int) -> np.ndarray:
    """The sums of an anchor for so many groups: components that the candidates lack count as 0, as do those that it lacks."""
    out = np.zeros(groups * 8, np.int64)
    out[: min(len(a), groups * 8)] = a[: groups * 8]
    return subset_sums(out)


class _Best:
    """The best rows so far of each (anchor, positive) of one block of anchors."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def add(self, key: tuple, ids: np.ndarray, scores: np.ndarray) -> None:
        old = self.kept.get(key)
        if old is not None:
            if len(old[1]) == self.k:
                good = scores >= old[1][-1]
                ids, scores = ids[good], scores[good]
            if not len(ids):
                return
            ids, scores = np.r_[old[0], ids], np.r_[old[1], scores]
        if len(ids):
            at = best(ids, scores, self.k)
            self.kept[key] = ids[at], scores[at]

    def rows(self) -> list[tuple]:
        return [(*key, int(i), int(s)) for key, (ids, scores) in self.kept.items() for i, s in zip(ids, scores, strict=True)]


def _search(score, names: list[str], k: int):
    """score(kept, anchors' row, block of candidates) for each pair of blocks; rows go out when another block of anchors begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, _Best(k)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        for b in batches:
            for i in range(b.num_rows):
                if (a := b.column(0)[i].as_py()) != now:
                    if rows := kept.rows():
                        yield batch(rows)
                    now, kept, block = a, _Best(k), b.column(1)[i].as_py()
                score(kept, block, Candidates(b.column(2)[i].as_py()))
        if rows := kept.rows():
            yield batch(rows)

    return run


def _positives(kept: _Best, block: dict, c: Candidates) -> None:
    """Rows of the anchors' own labels."""
    ids, labels, keys, x = _anchors(block)
    for i in np.flatnonzero((labels >= c.labels[0]) & (labels <= c.labels[-1])).tolist():
        lo, hi = np.searchsorted(c.labels, labels[i]), np.searchsorted(c.labels, labels[i], "right")
        if lo == hi:
            continue
        scores, other = c.scores(_fit(x[i], c.places.shape[1]), lo, hi), c.ids[lo:hi] != ids[i]
        kept.add((int(ids[i]), int(keys[i])), c.ids[lo:hi][other], scores[other])


def _negatives(least: int):
    def score(kept: _Best, block: dict, c: Candidates) -> None:
        """Rows of other labels in the band of each positive: at least `least` percent of its score, at most all of it."""
        ids, labels, keys, x = _anchors(block)
        for i, positives in enumerate(block["positives"]):
            bands = [(p["rank"], p["id"], p["score"], -(-least * p["score"] // 100)) for p in positives or [] if -(-least * p["score"] // 100) <= p["score"]]
            if not bands:
                continue
            sums = _fit(x[i], c.places.shape[1])
            lo, hi = np.searchsorted(c.labels, labels[i]), np.searchsorted(c.labels, labels[i], "right")
            for start, end in ((0, lo), (hi, len(c.ids))):
                if start == end:
                    continue
                got, own = c.scores(sums, start, end), c.ids[start:end]
                # What no band holds goes first.
                near = np.flatnonzero((got >= min(b[3] for b in bands)) & (got <= max(b[2] for b in bands)) & (own != ids[i]))
                got, own = got[near], own[near]
                for rank, pid, most, floor in bands:
                    inside = (got >= floor) & (got <= most)
                    kept.add((int(ids[i]), int(keys[i]), rank, pid, most), own[inside], got[inside])

    return score


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: a condition on vec_id; label: what takes the place of the column label."""
    small_batches(vectors.sparkSession)
    rows = usable(vectors, F.col("label") if label is None else label).withColumn("key", F.monotonically_increasing_id())
    # Written before it is dealt out: a key stands for one row, whoever reads it again.
    rows = stage(rows)
    ordered = rows.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id", "key")
    candidates = stage(_blocks(ordered, block, planar=True))
    width = max(1, candidates.agg(F.max("width")).first()[0] or 1)
    chosen = rows.where(is_anchor).repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id", "key")
    asked = stage(_blocks(chosen, max(1, min(anchors, ANCHOR_BYTES // (8 * width))), planar=False))

    found = _paired(asked, candidates).select("a", "anchors", "candidates").mapInArrow(_search(_positives, ["anchor_id", "key", "positive_id", "score"], positives), "anchor_id long, key long, positive_id long, score long")
    w = Window.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "positive_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= positives)
    # At most `positives` for each anchor.
    of_anchor = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), F.col("positive_id").alias("id"), "score"))).alias("positives"))
    place = asked.select("block", F.explode(_longs("keys")).alias("k")).select("block", F.col("k.at").alias("at"), F.col("k.key").alias("key"))
    lists = place.join(of_anchor, "key", "left").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "positives"))), lambda r: r["positives"]).alias("positives"))
    asked = stage(asked.join(lists, "block"))

    names = ["anchor_id", "key", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"]
    out = _paired(asked, candidates).select("a", "anchors", "candidates").mapInArrow(_search(_negatives(least), names, negatives), ", ".join(f"{n} long" for n in names))
    w = Window.partitionBy("anchor_id", "key", "positive_rank").orderBy(F.col("negative_score").desc(), "negative_id")
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _longs(column: str) -> Column:
    """Little-endian 64-bit integers in binary to an array of (at, key)."""

    @F.arrow_udf("array<struct<at: int, key: long>>")
    def unpack(binary: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("key", pa.int64())]))
        return pa.array([[{"at": i, "key": k} for i, k in enumerate(np.frombuffer(v, "<i8").tolist())] for v in binary.to_pylist()], kind)

    return unpack(F.col(column))
