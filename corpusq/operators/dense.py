"""Vector search over blocks: exact, and approximate with quantised codes.

Rows of either side are packed into blocks of bounded size, and each block of queries meets each block of the corpus
once. The pairs are dealt out by the queries' block and by a hash of the corpus block, so neither side is collected or
broadcast by hand, a task holds one product of two blocks at a time, and it passes on only its best rows.

The approximate search looks at one byte for each few dimensions instead of the vector: code books are fitted on a
bounded sample, each part of a vector becomes the number of its nearest code word, and a table of a
query's distances to all code words turns codes into scores by lookup. More rows than are asked for are taken over
(min(k + 50, 4 k)), and only these are compared exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.sources.streams import written

#: Rows of a block of queries and of the corpus; bytes that a block's vectors may have. A product of two blocks has at most QUERIES x ROWS numbers, 16 MB.
QUERIES, ROWS, BYTES = 1024, 2048, 8 << 20
#: Tasks that share the corpus for one block of queries.
TASKS = 64
#: Rows that code books are fitted on at most, about; words of a code book; dimensions that share a byte; rounds of fitting.
FITTED, CODE_WORDS, PART, ROUNDS = 20_000, 256, 2, 12


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; an error for different widths."""
    n = np.diff(np.asarray(column.offsets))
    if len(set(n.tolist())) > 1 or column.null_count or column.flatten().null_count:
        raise ValueError("vectors of different widths")
    return np.asarray(column.flatten(), float).reshape(len(n), int(n[0]) if len(n) else 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of length 0 stay."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def blocks(rows: DataFrame, most: int, encode: Callable[[np.ndarray], np.ndarray], others: tuple[str, ...] = ()) -> DataFrame:
    """rows (id, vector, others) as blocks: block, n, width, ids, body (what encode() makes of the unit vectors, as bytes), and the others as arrays."""
    kinds = dict(rows.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            size = max(1, min(most, BYTES // (8 * max(1, b.column(1).flatten().__len__() // max(1, b.num_rows)))))
            for lo in range(0, b.num_rows, size):
                some = b.slice(lo, size)
                x = matrix(some.column(1))
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(i)) for i in (0, *range(2, 2 + len(others)))]
                head = [pa.array([number]), pa.array([some.num_rows], pa.int64()), pa.array([x.shape[1]], pa.int64()), lists[0], pa.array([np.ascontiguousarray(encode(unit(x))).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*head, *lists[1:]], ["block", "n", "width", "ids", "body", *others])
                number += 1

    schema = f"block long, n long, width long, ids array<{kinds['id']}>, body binary" + "".join(f", {c} array<{kinds[c]}>" for c in others)
    return rows.select("id", "vector", *others).mapInArrow(pack, schema)


def pairs(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """(q, queries, rows): each block of queries beside each block of the corpus, sorted by the former. asked: a written table."""
    q = asked.select(F.col("block").alias("q"), F.struct(*[c for c in asked.columns if c != "block"]).alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(TASKS - 1))).alias("slot"))
    numbers = asked.agg(F.collect_list("block").alias("all"))  # 8 bytes for each block of queries
    c = corpus.select(F.pmod(F.xxhash64("block"), F.lit(TASKS)).cast("int").alias("slot"), F.struct(*[c for c in corpus.columns if c != "block"]).alias("rows"))
    c = c.crossJoin(F.broadcast(numbers)).select(F.explode("all").alias("q"), "slot", "rows")
    return c.join(q, ["q", "slot"]).sortWithinPartitions("q", "slot").select("q", "queries", "rows")


def _seen(queries: dict, rows: dict, others: bool) -> np.ndarray | None:
    """Which pairs count: the query's grants open the row (none at all open everything), and a row is none of its own neighbours."""
    out = None
    if "grants" in queries:
        tags = [set(t or ()) for t in rows["acl_tags"]]
        of = {g: np.array([not g or not t.isdisjoint(g) for t in tags]) for g in {tuple(g or ()) for g in queries["grants"]}}
        out = np.array([of[tuple(g or ())] for g in queries["grants"]])
    if others:
        differ = np.array(queries["ids"], object)[:, None] != np.array(rows["ids"], object)[None, :]
        out = differ if out is None else out & differ
    return out


class _Best:
    """For each query of a block its k best rows so far, and those within `level` of the k-th."""

    def __init__(self, queries: int, k: int, level: float):
        self.k, self.level = k, level
        self.least = np.full(queries, -np.inf)
        self._keep(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))

    def _keep(self, of: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.parts, self.n = [(of, scores, ids)], len(of)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each query; -inf does not count."""
        low = self.least - self.level
        if scores.shape[1] > self.k:
            low = np.maximum(low, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k] - self.level)
        of, at = np.nonzero((scores >= low[:, None]) & (scores > -np.inf))
        self.parts.append((of, scores[of, at], ids[at]))
        self.n += len(of)
        if self.n > 8 * self.k * len(self.least) + 100_000:
            self._cut()

    def _cut(self) -> None:
        of, scores, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((-scores, of))
        of, scores, ids = of[order], scores[order], ids[order]
        start = np.searchsorted(of, np.arange(len(self.least)))
        full = np.flatnonzero(np.diff(np.append(start, len(of))) >= self.k)
        self.least[full] = scores[start[full] + self.k - 1]
        good = scores >= self.least[of] - self.level
        self._keep(of[good], scores[good], ids[good])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        return self.parts[0]


def search(asked: DataFrame, corpus: DataFrame, score: Callable[[dict, dict], np.ndarray], k: int, level: float = 0.0, others: bool = False) -> DataFrame:
    """query_id, chunk_id, score: at least the k best rows of each task for each query. asked, corpus: of blocks(); score(queries, rows): a row for each query."""
    kinds = [dict(df.dtypes)["ids"][6:-1] for df in (asked, corpus)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, best, schema = None, None, None, [None, None]

        def out() -> Iterator[pa.RecordBatch]:
            of, scores, ids = best.rows()
            names = np.empty(len(queries["ids"]), object)
            names[:] = queries["ids"]
            for lo in range(0, len(of), 50_000):
                some = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[of[some]].tolist(), schema[0]), pa.array(ids[some].tolist(), schema[1]), pa.array(scores[some])], ["query_id", "chunk_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                if (q := b.column(0)[i].as_py()) != now:
                    if best:
                        yield from out()
                    schema[0] = b.column(1).type.field("ids").type.value_type
                    now, queries = q, b.column(1)[i].as_py()
                    best = _Best(len(queries["ids"]), k, level)
                rows = b.column(2)[i].as_py()
                schema[1] = b.column(2).type.field("ids").type.value_type
                if rows["width"] != queries["width"]:
                    raise ValueError("vectors of different widths")
                scores, seen = score(queries, rows), _seen(queries, rows, others)
                ids = np.empty(len(rows["ids"]), object)
                ids[:] = rows["ids"]
                best.add(scores if seen is None else np.where(seen, scores, -np.inf), ids)
        if best:
            yield from out()

    return pairs(asked, corpus).mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def _floats(row: dict) -> np.ndarray:
    return np.frombuffer(row["body"], "<f8").reshape(row["n"], row["width"])


def _cosines(queries: dict, rows: dict) -> np.ndarray:
    return _floats(queries) @ _floats(rows).T


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(queries: DataFrame, others: tuple[str, ...]) -> DataFrame:
    return written(blocks(queries.withColumnRenamed("query_id", "id"), QUERIES, lambda x: x, others), "queries")


def cosine_top(queries: DataFrame, corpus: DataFrame, k: int = 10, digits: int = 9, others: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank (VEC2): exact, over any number of queries.

    queries: query_id, vector, and grants if access is limited; corpus: chunk_id, vector, and then acl_tags. others: ids are of one table, and a query does not meet its own row.
    Rows that a query may not see are left out before its best k are taken; rows that rounding might put level with the k-th are looked at."""
    limited = "grants" in queries.columns
    asked = _asked(queries, ("grants",) if limited else ())
    rows = blocks(corpus.withColumnRenamed("chunk_id", "id"), ROWS, lambda x: x, ("acl_tags",) if limited else ())
    found = search(asked, rows, _cosines, k, 10.0**-digits, others)
    return ranked(found.withColumn("score", F.round("score", digits)), k)


@dataclass(frozen=True)
class Codes:
    """An index of codes. books: (parts, code words, dimensions of a part), 8 bytes a number and so a fixed size for a width; table: blocks of codes."""

    books: np.ndarray
    width: int
    table: DataFrame


def fit_books(corpus: DataFrame, part: int = PART, seed: int = 7) -> tuple[np.ndarray, int]:
    """Code books of the corpus' unit vectors and their width, by k-means in each part of the dimensions, over a sample of at most about FITTED rows, drawn by a hash. corpus: chunk_id, vector."""
    n = corpus.count()
    some = corpus.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 20)) <= int(min(1.0, FITTED / max(1, n)) * (1 << 20)))
    unit_ = blocks(some.withColumnRenamed("chunk_id", "id"), ROWS, lambda x: x)
    kinds = "part int, dims int, body binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = _floats(r)
                for i, lo in enumerate(range(0, r["width"], part)):
                    p = np.ascontiguousarray(x[:, lo : lo + part])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([p.shape[1]], pa.int32()), pa.array([p.tobytes()])], ["part", "dims", "body"])

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        dims = int(df["dims"].iloc[0])
        x = np.concatenate([np.frombuffer(v, "<f8") for v in sorted(df["body"])]).reshape(-1, dims)
        return pd.DataFrame({"part": [int(df["part"].iloc[0])], "dims": [dims], "body": [_code_book(x, seed).tobytes()]})

    got = sorted(unit_.mapInArrow(split, kinds).groupBy("part").applyInPandas(fit, kinds).collect(), key=lambda r: r.part)
    books = np.zeros((len(got), CODE_WORDS, part))
    for r in got:
        words = np.frombuffer(r.body, "<f8").reshape(CODE_WORDS, r.dims)
        books[r.part, :, : r.dims] = words
    return books, sum(r.dims for r in got)


def _code_book(x: np.ndarray, seed: int) -> np.ndarray:
    """CODE_WORDS points that stand for the rows of x: k-means from rows drawn at random; words that nobody chooses are drawn anew from the rows that are farthest from theirs."""
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), CODE_WORDS, replace=len(x) < CODE_WORDS)].copy()
    for _ in range(ROUNDS):
        of, far = _nearest(x, words)
        count = np.bincount(of, minlength=CODE_WORDS)
        sums = np.stack([np.bincount(of, x[:, d], CODE_WORDS) for d in range(x.shape[1])], axis=1)
        words = np.divide(sums, count[:, None], out=words, where=count[:, None] > 0)
        empty = np.flatnonzero(count == 0)[: len(x)]
        words[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return words


def _nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest word of each row, and its squared distance."""
    of, far = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), 4096):
        d = (words * words).sum(axis=1)[None, :] - 2 * x[lo : lo + 4096] @ words.T
        of[lo : lo + 4096] = d.argmin(axis=1)
        far[lo : lo + 4096] = d.min(axis=1) + (x[lo : lo + 4096] ** 2).sum(axis=1)
    return of, far


def encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes of shape (parts, rows), one byte each."""
    parts, _, part = books.shape
    full = np.zeros((len(x), parts * part))
    full[:, : x.shape[1]] = x
    return np.stack([_nearest(full[:, i * part : (i + 1) * part], books[i])[0] for i in range(parts)]).astype(np.uint8)


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, parts, code words): their entries add up to (1 - squared distance) / 2 of a unit query and a coded vector, but for a half. Distances, unlike products, don't suffer from what coding loses along the query."""
    parts, _, part = books.shape
    full = np.zeros((len(q), parts * part))
    full[:, : q.shape[1]] = q
    out = np.einsum("qpd,pwd->qpw", full.reshape(len(q), parts, part), books) - (books * books).sum(axis=2)[None] / 2
    return out.astype(np.float32)


def index(corpus: DataFrame, part: int = PART, path: str | None = None) -> Codes:
    """Codes of the whole corpus (chunk_id, vector, and acl_tags if access is to be limited), written to `path` or to the shared folder."""
    books, width = fit_books(corpus, part)
    others = ("acl_tags",) if "acl_tags" in corpus.columns else ()
    coded = blocks(corpus.withColumnRenamed("chunk_id", "id"), ROWS, lambda x: encode(x, books), others)
    if path:
        coded.write.parquet(path)
        return Codes(books, width, coded.sparkSession.read.schema(coded.schema).parquet(path))
    return Codes(books, width, written(coded, "codes"))


def over_fetch(k: int) -> int:
    return min(k + 50, 4 * k)


def candidates(codes: Codes, queries: DataFrame, k: int, others: bool = False) -> DataFrame:
    """query_id, chunk_id: the over_fetch(k) rows of each query that look best by their codes."""
    books = codes.books

    def score(asked: dict, rows: dict) -> np.ndarray:
        lookup = tables(_floats(asked), books)
        of = np.frombuffer(rows["body"], np.uint8).reshape(books.shape[0], rows["n"])
        out = np.zeros((len(lookup), rows["n"]), np.float32)
        for p in range(books.shape[0]):
            out += lookup[:, p, of[p]]
        return out

    limited = "grants" in queries.columns
    found = search(_asked(queries, ("grants",) if limited else ()), codes.table, score, over_fetch(k), others=others)
    return ranked(found, over_fetch(k)).select("query_id", "chunk_id")


def approximate_top(queries: DataFrame, corpus: DataFrame, k: int = 10, codes: Codes | None = None, digits: int = 6, others: bool = False, checked: dict | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank (VEC3): candidates by codes, then exact cosines of these alone. checked: takes the number of pairs that were compared exactly."""
    codes = index(corpus) if codes is None else codes
    near = written(candidates(codes, queries, k, others), "candidates")
    if checked is not None:
        checked["pairs"] = near.count()
    # Both joins are by id: a row for each candidate.
    both = near.join(queries.select("query_id", F.col("vector").alias("one")), "query_id").join(corpus.select("chunk_id", F.col("vector").alias("two")), "chunk_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = unit(matrix(b.column(2))), unit(matrix(b.column(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * y).sum(axis=1))], ["query_id", "chunk_id", "score"])

    kinds = dict(near.dtypes)
    scored = both.select("query_id", "chunk_id", "one", "two").mapInArrow(exact, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
    return ranked(scored.withColumn("score", F.round("score", digits)), k)


def recall(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """recall of approximate_top() against exact search, and the share of all pairs that it compared exactly: one row. queries and corpus are of one table."""
    checked: dict = {}
    exact, near = cosine_top(queries, corpus, k, 6, True), approximate_top(queries, corpus, k, others=True, checked=checked)
    hit = exact.join(near.select("query_id", "chunk_id", F.lit(1).alias("found")), ["query_id", "chunk_id"], "left").agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
    share = corpus.agg((F.lit(float(checked["pairs"])) / (F.count("*") * queries.count())).alias("share"))
    return hit.crossJoin(share)  # one row each
