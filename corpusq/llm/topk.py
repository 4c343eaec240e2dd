"""Exact top-k inner products by M-tree best-first search.

Inner products become distances: with one more component, sqrt(M - |x|^2), all vectors lie on a sphere (M is
the largest |x|^2), and d(q, x)^2 = |q|^2 + M - 2 <q, x> for a query with 0 there. So the largest inner product
is the nearest neighbour, and triangle inequalities hold.

The tree has pages: vectors go to the nearest of some pivots (a hashed sample of at most PIVOTS rows), and the
vectors of a pivot are dealt into pages of about PAGE. A page has a routing vector and a covering radius and
holds leaves with routing vectors, covering radii and distances to the page's routing vector; each leaf entry
has its distance to the leaf's.

The search goes best first. A query starts in the page that it lies in itself, which bounds its k-th score. The
directory (routing vector and radius of each page; broadcast in slices of DIRECTORY bytes) orders all pages by the
least distance that an entry of theirs can have. First a query is sent to its NEAREST pages, which raises the
bound; then to the others that the bound lets through, and to no more. A page, leaf or entry is skipped without computing
a distance when the stored distances show that it is too far; leaves are taken nearest first.

Defined cases: vectors null, empty, or with null or non-finite components take no part, nor do rows without vec_id,
nor vectors whose squared length in integers is over 2^62 (their products may be no longs); shorter vectors count as
filled with 0; repeated rows count once for each row, but rows with the query's vec_id never count; fewer than k
candidates give fewer rows; ties go to the smaller vec_id; other columns of the input are ignored. Sums are exact:
in doubles up to a squared length of 2^52, in 64-bit integers beyond.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import small_batches, stage

SCALE, K = 256, 5
PIVOTS, PAGE, LEAF = 1024, 2048, 64
#: Bytes of the directory that are broadcast at once; pages that each query meets first; queries that travel together.
DIRECTORY, NEAREST, BLOCK = 16 << 20, 2, 256
#: Largest squared length of a vector that takes part, and up to which doubles are exact.
LONGEST, EXACT = 1 << 62, 1 << 52
#: Rounding that distances may carry, as a share of the sphere's radius.
SLACK = 1e-6


def _floor(x: Column) -> Column:
    """Floor as a double: floor() itself gives a long and fails beyond its range."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(F.least(F.greatest(x, F.lit(-float(1 << 53))), F.lit(float(1 << 53)))).cast("double")).otherwise(x)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x: the usable vectors in integers, all of one width."""
    v = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    v = v.where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # In doubles first: what is too long for the bound may be too long for an integer.
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: _floor(scale * c.cast("double"))).alias("x"))
    v = v.where(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c) <= float(LONGEST))
    return stage(v.select("vec_id", F.transform("x", lambda c: c.cast("long")).alias("x")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.flatten())
    n = np.diff(offsets)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    for i, (lo, size) in enumerate(zip(offsets[:-1] - offsets[0], n, strict=True)):
        out[i, :size] = flat[lo : lo + size]
    return out


def exact(x: np.ndarray, m: float) -> np.ndarray:
    """x in a type whose sums of products are exact."""
    return x.astype(np.float64 if m <= EXACT else np.int64)


def kind(m: float) -> str:
    """The narrowest integers that hold components of vectors whose squared length is m at most."""
    return "<i2" if m < 1 << 30 else "<i4" if m < 1 << 62 else "<i8"


def _lifted(x: np.ndarray, m: float) -> np.ndarray:
    """x as doubles with one more component that puts all on a sphere."""
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(0.0, m - (x * x).sum(axis=1)))]


class Page:
    """A page of the tree: leaves one after another, each with its entries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: float, leaf: int = LEAF):
        self.m = m
        full = _lifted(x, m)
        n = len(ids)
        rng = np.random.default_rng(n)
        seeds = rng.choice(n, max(1, -(-n // leaf)), replace=False)
        # Data lie on a sphere, so the nearest routing vector has the largest inner product.
        of = (full @ full[seeds].T).argmax(axis=1)
        order = np.lexsort((ids, of))
        self.ids, self.x = ids[order], exact(x[order], m)
        used, self.start = np.unique(of[order], return_index=True)
        self.end = np.r_[self.start[1:], n]
        routing = full[seeds[used]]
        self.routing = routing
        size = self.end - self.start
        self.entry = np.sqrt(((full[order] - np.repeat(routing, size, axis=0)) ** 2).sum(axis=1))
        self.radius = np.maximum.reduceat(self.entry, self.start)
        center = routing[np.argmin(((routing[:, None, :] - routing[None, :, :]) ** 2).sum(axis=2).max(axis=1))]
        self.center = center
        self.to_center = np.sqrt(((routing - center) ** 2).sum(axis=1))
        self.far = float((self.to_center + self.radius).max())

    _FIELDS = ("ids", "x", "start", "end", "routing", "entry", "radius", "center", "to_center")

    def pack(self) -> dict:
        kinds = {"ids": "<i8", "x": kind(self.m), "start": "<i4", "end": "<i4"}
        return {f: getattr(self, f).astype(kinds.get(f, "<f8")).tobytes() for f in self._FIELDS} | {"m": self.m, "far": self.far, "n": len(self.ids)}

    @classmethod
    def unpack(cls, r: dict) -> Page:
        self = cls.__new__(cls)
        for f, of in (("ids", "<i8"), ("start", "<i4"), ("end", "<i4"), ("entry", "<f8"), ("radius", "<f8"), ("to_center", "<f8"), ("center", "<f8"), ("routing", "<f8"), ("x", kind(r["m"]))):
            setattr(self, f, np.frombuffer(r[f], of))
        self.m, self.far = r["m"], r["far"]
        self.x = exact(self.x.reshape(len(self.ids), -1), self.m)
        self.routing = self.routing.reshape(len(self.start), -1)
        return self

    def search(self, qid: int, q: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """(score, id) of at most k entries with a score of at least `least`, best first."""
        real = np.append(q.astype(np.float64), 0.0)
        q2 = float(real @ real) + self.m
        slack = SLACK * (q2**0.5 + 1)
        reach = lambda score: (max(0.0, q2 - 2 * score)) ** 0.5 + slack if score > -np.inf else np.inf
        far = reach(least)
        to_center = max(0.0, q2 - 2 * float(self.center @ real)) ** 0.5
        if to_center - self.far > far:
            return []
        leaves = np.flatnonzero(np.abs(to_center - self.to_center) - self.radius <= far)
        d = np.sqrt(np.maximum(0.0, q2 - 2 * (self.routing[leaves] @ real)))
        bound = d - self.radius[leaves]
        best: list[tuple[int, int]] = []  # a heap with the worst of the best first: (score, -id)
        for i in np.argsort(bound).tolist():
            if bound[i] > far:
                break
            lo, hi = self.start[leaves[i]], self.end[leaves[i]]
            near = np.flatnonzero(np.abs(self.entry[lo:hi] - d[i]) <= far) + lo
            scores = self.x[near] @ q
            ok = scores >= (least if len(best) < k else max(least, best[0][0]))
            for s, e in zip(scores[ok].tolist(), self.ids[near[ok]].tolist(), strict=True):
                if e == qid:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (int(s), -e))
                else:
                    heapq.heappushpop(best, (int(s), -e))
            if len(best) == k:
                far = reach(max(least, best[0][0]))
        return sorted(((s, -e) for s, e in best), key=lambda x: (-x[0], x[1]))


def _bytes(x: np.ndarray, of: str) -> bytes:
    return x.astype(of).tobytes()


def met(tree: DataFrame, sent: DataFrame, pages: int) -> DataFrame:
    """Each page's row, and after it the blocks of queries that were sent to it. Both are dealt by page: Spark sizes the blocks, a row for each page and some queries, as the few queries that they come from, and would broadcast them."""
    spark = tree.sparkSession
    # A number of partitions that is not made smaller: a page's work is large for its bytes.
    parts = max(1, min(pages, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)))
    both = tree.withColumn("block", F.lit(False)).unionByName(sent.withColumn("block", F.lit(True)), allowMissingColumns=True)
    return both.repartition(parts, "page").sortWithinPartitions("page", "block")


def route(queries: DataFrame, tree: DataFrame, pages: int, width: int, m: float, wave: int, nearest: int = NEAREST) -> DataFrame:
    """queries (query_id, x, least, home) to blocks of them for each page: page, n, q_ids, q_x, q_least. Wave 1: each query's home page and its nearest ones of each slice; wave 2: all others that its bound lets through."""
    spark = queries.sparkSession
    out, at_once = None, max(1, DIRECTORY // (8 * (width + 2)))
    for first in range(0, pages, at_once):  # one slice for each 60 million vectors of 64 components
        rows = tree.where(F.col("page").between(first, first + at_once - 1)).select("page", "center", "far").toPandas()
        shared = spark.sparkContext.broadcast((rows["page"].to_numpy(np.int64), np.frombuffer(b"".join(rows["center"]), "<f8").reshape(len(rows), -1), rows["far"].to_numpy(float)))

        def send(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            page, center, far = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK):
                    b = batch.slice(lo, BLOCK)
                    ids, least, home = (np.asarray(b.column(i)) for i in (0, 2, 3))
                    x = _matrix(b.column(1), width)
                    real = np.c_[x.astype(np.float64), np.zeros(len(x))]
                    q2 = (real * real).sum(axis=1) + m
                    slack = SLACK * (np.sqrt(q2) + 1)
                    # The least distance that an entry of the page can have; the farthest that still matters.
                    bound = np.sqrt(np.maximum(0.0, q2[:, None] - 2 * (real @ center.T))) - far
                    reach = np.where(np.isfinite(least), np.sqrt(np.maximum(0.0, q2 - 2 * np.where(np.isfinite(least), least, 0.0))) + slack, np.inf)
                    close = np.zeros(bound.shape, bool)
                    np.put_along_axis(close, np.argsort(bound, axis=1, kind="stable")[:, :nearest], True, axis=1)
                    close |= home[:, None] == page
                    go = (bound <= reach[:, None]) & (close if wave == 1 else ~close)
                    for i in np.flatnonzero(go.any(axis=0)).tolist():
                        at = np.flatnonzero(go[:, i])
                        cols = [[int(page[i])], [len(at)], [_bytes(ids[at], "<i8")], [_bytes(x[at], kind(m))], [_bytes(least[at], "<f8")]]
                        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page", "n", "q_ids", "q_x", "q_least"])

        sent = queries.mapInArrow(send, "page int, n long, q_ids binary, q_x binary, q_least binary")
        out = sent if out is None else out.unionByName(sent)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, seen: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id. seen: takes the number of pages, of queries, and of pairs of a query and a page that were searched in either wave."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = integers(vectors, scale)
    facts = v.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.expr("aggregate(x, 0L, (a, c) -> a + c * c)")).alias("m")).first()
    if not facts.n:
        return v.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    n, width, m = facts.n, facts.width, float(facts.m)
    # A bounded sample gives the pivots; a third of all rows near one pivot only means more pages for it.
    wanted = min(PIVOTS, max(1, n // PAGE))
    order = F.xxhash64("vec_id", F.lit("pivot"))
    pivots = [r.x + [0] * (width - len(r.x)) for r in v.orderBy(order, "vec_id").limit(wanted).collect()]
    shared = spark.sparkContext.broadcast(_lifted(np.array(pivots, np.int64), m))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = _lifted(_matrix(b.column(1), width), m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((full @ shared.value.T).argmax(axis=1), pa.int32())], ["vec_id", "x", "query", "pivot"])

    near = stage(v.select("vec_id", "x", is_query.alias("query")).mapInArrow(assign, "vec_id long, x array<long>, query boolean, pivot int"))
    # At most PIVOTS rows: how many pages each pivot has, and the number of its first page.
    sizes = near.groupBy("pivot").count().collect()
    first, parts, pages = {}, {}, 0
    for r in sorted(sizes, key=lambda r: r.pivot):
        first[r.pivot], parts[r.pivot] = pages, -(-r["count"] // PAGE)
        pages += parts[r.pivot]
    lookup = spark.createDataFrame([(a, first[a], parts[a]) for a in first], "pivot int, first int, parts int")
    row = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts").cast("long")).cast("int")
    dealt = near.join(F.broadcast(lookup), "pivot").select("vec_id", "x", "query", (F.col("first") + row).alias("page"))

    def build(df: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pa.array(df["x"].tolist(), pa.list_(pa.int64())), width)
        ids = df["vec_id"].to_numpy(np.int64)
        page = Page(ids, x, m)
        at = np.flatnonzero(df["query"].to_numpy(bool))
        least = []
        for i in at:
            got = page.search(int(ids[i]), exact(x[i], m), k, -np.inf)
            least.append(float(got[-1][0]) if len(got) == k else -np.inf)
        return pd.DataFrame([page.pack() | {"page": int(df["page"].iloc[0]), "q_ids": ids[at].tolist(), "q_x": x[at].tolist(), "q_least": least}])

    binary = ", ".join(f"`{f}` binary" for f in Page._FIELDS)
    tree = stage(dealt.groupBy("page").applyInPandas(build, f"page int, {binary}, m double, far double, n int, q_ids array<long>, q_x array<array<long>>, q_least array<double>"))
    each = F.explode(F.arrays_zip("q_ids", "q_x", "q_least")).alias("q")
    queries = tree.select(F.col("page").alias("home"), each).select(F.col("q.q_ids").alias("query_id"), F.col("q.q_x").alias("x"), F.col("q.q_least").alias("least"), "home")
    kept = tree.drop("q_ids", "q_x", "q_least", "n")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict | Page | None = None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if not r["block"]:
                    last = r
                    continue
                if not isinstance(last, Page):
                    last = Page.unpack(last)
                ids = np.frombuffer(r["q_ids"], "<i8")
                x = exact(np.frombuffer(r["q_x"], kind(m)).reshape(len(ids), width), m)
                for qid, q, least in zip(ids.tolist(), x, np.frombuffer(r["q_least"], "<f8").tolist(), strict=True):
                    rows += [(qid, e, s) for s, e in last.search(qid, q, k, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    def searched(queries: DataFrame, wave: int) -> DataFrame:
        sent = route(queries, tree, pages, width, m, wave)
        if seen is not None:
            sent = stage(sent)
            seen.update({"pages": pages, "queries": queries.count(), f"pairs{wave}": sent.agg(F.sum("n")).first()[0] or 0})
        return met(kept, sent.drop("n"), pages).mapInArrow(search, "query_id long, vec_id long, score long")

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    found = stage(ranked(searched(queries, 1)))
    bounds = found.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("better"))
    queries = stage(queries.join(bounds, "query_id", "left").select("query_id", "x", F.greatest("least", F.coalesce("better", F.lit(float("-inf")))).alias("least"), "home"))
    rest = searched(queries, 2)
    return ranked(found.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", "rank", "vec_id", "score")
