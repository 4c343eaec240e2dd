"""Streams with state for each key: rate limits, lifecycles, answers, redelivery, joined feedback."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusq.operators import asof
from corpusq.operators import ingest as batches
from corpusq.operators.answers import LONGEST_HELD, REFUSALS
from corpusq.operators.chunking import split_sentences
from corpusq.operators.lifecycle import TRANSITIONS
from corpusq.sources import segments, streams

LIMIT, SECONDS = 30, 60
#: Windows' lengths that share a stretch of a client's time in batch.
STRETCH = 256
_MARK, _WIDE = re.compile(r"\[(\d+)\]", re.ASCII), re.compile(r"[【［]\s*(\d+)\s*[】］]", re.ASCII)


class _Limiter(StatefulProcessor):
    """State: where the key's window began and how many requests it let pass."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.micros = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, n int")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        at, n = self.window.get() if self.window.exists() else (None, 0)
        b = pd.concat(list(rows)).sort_values(["created_at", "request_id"])
        out = []
        for r, t in zip(b["request_id"], b["created_at"].astype("datetime64[us]").astype("int64")):
            if at is None or t - at >= self.micros:
                at, n = t, 0
            ok = self.limit == 0 or n < self.limit
            n += ok
            out.append((r, key[0], bool(ok), 0.0 if ok else (at + self.micros - t) / 1e6))
        self.window.update((int(at), int(n)))
        yield pd.DataFrame(out, columns=["request_id", "client", "allowed", "retry_after"])

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """request_id, client, allowed, retry_after (STR6): windows begin at a client's first request after the last one ended; limit 0: none.
    requests: a stream of request_id (long), client (string), created_at."""
    return requests.select("request_id", "client", "created_at").groupBy("client").transformWithStateInPandas(
        _Limiter(limit, seconds), "request_id long, client string, allowed boolean, retry_after double", "append", "none")


def rate_limit(requests: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """The same for a table. Each request points to the client's first one a window later; where windows begin is what these pointers reach from requests after
    a pause, found by pointer doubling. Clients are cut into stretches of time, so a busy one is many small windows."""
    size = seconds * 1_000_000
    stretch = max(1, size * STRETCH)
    r = requests.select("client", "request_id", F.unix_micros("created_at").alias("at")).where("at is not null")
    times = streams.written(r.select("client", "at").distinct(), "times")
    after = asof.next_marks(times.withColumn("from", F.col("at")).withColumn("at", F.col("at") + size), times, ["client"], "at", stretch, "to")
    before = asof.last_marks(times.withColumn("from", F.col("at")).withColumn("at", F.col("at") - 1), times, ["client"], "at", stretch, name="last")
    # A pause as long as a window surely ends it.
    fresh = before.where(F.col("last").isNull() | (F.col("from") - F.col("last") >= size)).select("client", F.col("from").alias("at"))
    starts = asof.reached(fresh, after.select("client", F.col("from").alias("at"), "to"), ["client"])
    x = asof.last_marks(r, starts, ["client"], "at", stretch, name="began")
    nth = F.row_number().over(Window.partitionBy("client", "began").orderBy("at", "request_id"))
    x = x.withColumn("allowed", (F.lit(limit) == 0) | (nth <= limit))
    return x.select("request_id", "client", "allowed", F.when(F.col("allowed"), 0.0).otherwise((F.col("began") + size - F.col("at")) / 1e6).alias("retry_after"))


class _Lifecycle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            ok = r.state == "pending" if now is None else r.state in TRANSITIONS.get(now, [])
            ok = ok and (r.state != "failed" or bool(r.reason))
            out.append((key[0], r.seq, now, r.state, ok))
            now = r.state if ok else now
        if now is not None:
            self.state.update((now,))
        yield pd.DataFrame(out, columns=["doc_id", "seq", "before", "state", "accepted"])

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """doc_id, seq, before, state, accepted (LIF3): events that may not follow a document's state leave it as it is."""
    return events.select("doc_id", "seq", "state", "reason").groupBy("doc_id").transformWithStateInPandas(
        _Lifecycle(), "doc_id long, seq long, before string, state string, accepted boolean", "append", "none")


def _cut(text: str, done: bool) -> tuple[list[str], str]:
    """The sentences that are whole, and what goes on with the next delta."""
    whole, rest = split_sentences(text)
    if done:
        return whole + ([rest] if rest else []), ""
    if not whole:
        return whole, text.lstrip()
    # Without a rest the last sentence may go on, or its citation may still come.
    return (whole, text[text.rindex(rest) :]) if rest else (whole[:-1], text[text.rindex(whole[-1]) :])


class _Sentences(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "text string, next int")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        text, i = self.rest.get() if self.rest.exists() else ("", 0)
        b = pd.concat(list(rows)).sort_values("seq")
        done = b["done"].any()
        whole, rest = _cut(text + "".join(x for x in b["delta"] if x), done)
        if done:
            self.rest.clear()
        else:
            self.rest.update((rest, i + len(whole)))
        yield pd.DataFrame([(key[0], i + n, s) for n, s in enumerate(whole)], columns=["query_id", "sent_idx", "sentence"])

    def close(self) -> None:
        pass


def answer_sentences(deltas: DataFrame) -> DataFrame:
    """query_id, sent_idx, sentence (CIT9) of streamed answers, each once it is whole. deltas: query_id (long), seq, delta, done (last of its answer)."""
    return deltas.select("query_id", "seq", "delta", "done").groupBy("query_id").transformWithStateInPandas(
        _Sentences(), "query_id long, sent_idx int, sentence string", "append", "none")


def _checked(sentence: str, passages: int) -> tuple[str, int, int]:
    """A sentence without citations of passages that are not there, with the number of its good and bad ones; as `answers.validated` does for tables."""
    folded = _WIDE.sub(r"[\1]", sentence)
    cited = [1 <= int(n) <= passages for n in _MARK.findall(folded)]
    text = _MARK.sub(lambda m: m[0] if 1 <= int(m[1]) <= passages else "", folded)
    return re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"[ \t]{2,}", " ", text)).strip(), sum(cited), len(cited) - sum(cited)


class _Answers(StatefulProcessor):
    """State: the unfinished sentence, what is held back until a citation grounds the answer, and counts."""

    COLUMNS = ["query_id", "part", "kind", "text", "stripped"]

    def __init__(self, longest: int) -> None:
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("answer", "text string, held string, n_held int, grounded boolean, part int, stripped int")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        text, held, n_held, grounded, part, stripped = self.state.get() if self.state.exists() else ("", "", 0, False, 0, 0)
        b = pd.concat(list(rows)).sort_values("seq")
        done = bool(b["done"].any())
        whole, rest = _cut(text + "".join(x for x in b["delta"] if x), done)
        out = []
        for sentence in whole:
            said, good, bad = _checked(sentence, int(b["passages"].iloc[0]))
            stripped += bad
            if not grounded and not good:
                n_held += len(said)
                held = " ".join(x for x in (held, said) if x)
                if n_held > self.longest:
                    held, n_held = "", 0
                continue
            grounded = True
            for t in (held, said):
                if t:
                    out.append((key[0], part, "token", " " + t if part else t, 0))
                    part += 1
            held, n_held = "", 0
        if done:
            self.state.clear()
            if not grounded:
                out.append((key[0], part, "refusal", REFUSALS["ungrounded_answer"], stripped))
            elif stripped:
                out.append((key[0], part, "citation_warning", "", stripped))
        else:
            self.state.update((rest, held, n_held, grounded, part, stripped))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def answer_parts(deltas: DataFrame, longest: int = LONGEST_HELD) -> DataFrame:
    """query_id, part, kind, text, stripped (CIT9): what may be shown of streamed answers. Citations of absent passages are cut out; sentences before the
    first good citation are held back, over `longest` held characters are discarded; an answer's tokens, one after the other, are its text. At its end an
    answer without any good citation gives a refusal, one with bad citations a warning with their number.

    deltas: a stream of query_id (long), seq, delta, done (last of its answer), passages (how many there are)."""
    return deltas.select("query_id", "seq", "delta", "done", "passages").groupBy("query_id").transformWithStateInPandas(
        _Answers(longest), "query_id long, part int, kind string, text string, stripped int", "append", "none")


class _Silence(StatefulProcessor):
    """State: a key's latest event, and whether the silence after it has been told."""

    def __init__(self, minutes: int) -> None:
        self.millis = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long, told boolean")

    def _rows(self, key, begins: list[int]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], t) for t in begins], columns=["source", "at"])

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        # Of each block only its distinct milliseconds are kept.
        times = reduce(np.union1d, (b["created_at"].dropna().astype("datetime64[ms]").astype("int64").to_numpy() for b in rows), np.empty(0, "int64")).tolist()
        if not times:
            return
        at, told = self.last.get() if self.last.exists() else (None, False)
        if at is not None:
            self.handle.deleteTimer(at + self.millis)
        begins = []
        for t in times:
            if at is not None and t - at >= self.millis and not told:
                begins.append(at)
            if at is None or t > at:
                at, told = t, False
        self.last.update((int(at), bool(told)))
        if not told:
            self.handle.registerTimer(at + self.millis)
        if begins:
            yield self._rows(key, begins)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, told = self.last.get()
        self.last.update((at, True))
        if not told:
            yield self._rows(key, [at])

    def close(self) -> None:
        pass


def silence_stream(log: DataFrame, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """source, silent_from: the last event before each pause of that many minutes, told by an event-time timer when the watermark passes its end,
    or by the next event (STR2). A source's state is one row. log: a stream of source (string), created_at."""
    told = log.select("source", "created_at").withWatermark("created_at", late).groupBy("source").transformWithStateInPandas(
        _Silence(minutes), "source string, at long", "append", "eventTime")
    return told.select("source", F.timestamp_millis("at").alias("silent_from"))


def deliveries(uploads: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of uploads without redelivered ones (DUP4): keys are kept until the watermark passes. uploads: doc_id, created_at, ..."""
    return uploads.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["doc_id"])


def with_feedback(log: DataFrame, feedback: DataFrame, late: str = "1 day", span: str = "interval 1 hour") -> DataFrame:
    """The log's stream joined with votes that come within an hour of the query, either side first (STR8)."""
    a = log.withWatermark("created_at", late)
    b = feedback.withWatermark("voted_at", late).withColumnRenamed("query_id", "voted_id")
    return a.join(b, F.expr(f"query_id = voted_id and voted_at >= created_at and voted_at <= created_at + {span}"), "leftOuter").drop("voted_id")


def _each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(uploads: DataFrame, batch: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Runs a batch function over each micro-batch and writes it under the batch's own folder, so a repeated batch overwrites itself (SRC6)."""
    _each_batch(uploads, lambda df, n: batch(df).write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint)


def ingest_log(log: DataFrame, path: str, checkpoint: str, late: str = "10 minutes") -> None:
    """Appends log rows to a table partitioned by `late` (STR7): rows whose created_at lies more than `late` before the latest of all earlier micro-batches
    go to its side late=true, others, and those without a time, to late=false. Each batch writes its rows once and one row with the latest time so far;
    a repeated batch overwrites its own folders and sees the same earlier ones."""

    def write(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        before = spark.read.parquet(f"{path}/latest/batch={n - 1}").first()[0] if n else None
        horizon = F.lit(before).cast("timestamp") - F.expr(f"interval {late}")
        df.withColumn("late", F.coalesce(F.col("created_at") < horizon, F.lit(False))).write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={n}")
        latest = F.greatest(F.max("created_at"), F.lit(before).cast("timestamp")).alias("latest")
        spark.read.schema(df.schema).parquet(f"{path}/rows/batch={n}").agg(latest).write.mode("overwrite").parquet(f"{path}/latest/batch={n}")

    _each_batch(log, write, checkpoint)


def upload_store(spark: SparkSession, path: str) -> segments.Store:
    """Where ingest_uploads() writes: outcomes (a log of all deliveries), chunks, terms and registry, by doc_id."""
    return segments.Store(spark, path, "doc_id", indexed={"registry": ["doc_id", "content_hash"]}, logs=("outcomes",))


def ingest_uploads(uploads: DataFrame, path: str, checkpoint: str, before_publish: Callable[[], None] | None = None, **sizes: int) -> None:
    """Runs the batch pipeline over each micro-batch of uploads and commits its outcomes, chunks, terms and registry rows together as a segment (STR9). Registry
    rows of the batch's documents and of equal contents are looked up by bucket; redelivered uploads leave theirs as it is. A batch that is repeated after
    its commit adds nothing, one that failed before leaves nothing that readers see. Full levels of segments are merged after each batch.

    uploads: a stream of doc_id, filename, text, uploaded_at; of a document that comes twice in one batch the latest upload counts."""

    def write(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        store = upload_store(spark, path)
        if n <= store.manifest().last:
            return
        kind = dict(df.dtypes)["doc_id"]
        nothing = f"doc_id {kind}, state string, content_hash string, uploaded_at timestamp"

        def known(column: str, values: DataFrame) -> DataFrame:
            found = store.lookup("registry", column, values)
            return spark.createDataFrame([], nothing) if found is None else found

        last = F.max_by(F.struct("filename", "text", "uploaded_at"), F.struct("uploaded_at", "text", "filename")).alias("u")
        u = streams.written(df.groupBy("doc_id").agg(last).select("doc_id", "u.*"), "uploads")
        got = batches.ingest(u, known, **sizes)
        outcomes = streams.written(got.outcomes.withColumn("batch", F.lit(n)), "outcomes")
        was = known("doc_id", u).select("doc_id", F.col("content_hash").alias("had"), F.col("uploaded_at").alias("first"))
        new = outcomes.join(got.hashes.select("doc_id", "content_hash"), "doc_id", "left").join(u.select("doc_id", "uploaded_at"), "doc_id").join(was, "doc_id", "left")
        # A document keeps its first upload's time, and its content's hash where this delivery gives none.
        registry = new.select("doc_id", "state", F.coalesce("content_hash", "had").alias("content_hash"), F.least("uploaded_at", "first").alias("uploaded_at"))
        left_alone = F.coalesce(F.col("detail").isin(*batches.LEFT_ALONE.values()), F.lit(False))
        replaced = outcomes.where(~left_alone).select("doc_id")
        of = lambda rows: rows.join(replaced, "doc_id", "left_semi")
        terms = got.terms.join(got.chunks.select("chunk_id", "doc_id"), "chunk_id")
        store.commit(n, replaced, {"outcomes": outcomes, "chunks": got.chunks, "terms": terms, "registry": of(registry)}, before_publish)
        store.compact()

    _each_batch(uploads, write, checkpoint)
