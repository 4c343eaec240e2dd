"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut at boundaries that no token crosses, so each piece can be encoded alone and the counts add up.
Pieces repeat a lot; a worker encodes those that it has not met yet, in batches of equal size in bytes, and
remembers their counts in a table of bounded size. Whole texts are counted, however long they are.

Defined cases: null or empty text has 0 bytes and 0 tokens; null doc_id and repeated rows give one output row
per input row; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import byte_letters, small_batches

VOCABULARY = "byte_bpe_50k.json"
OVER = 512

#: Pieces that a worker remembers, and bytes that go to the tokenizer at once.
REMEMBER, AT_ONCE = 600_000, 1 << 18

#: A text in which white space stands alone everywhere can be cut before each space; others take SAFE.
ADJACENT = re.compile(r"\s\s|^\s|\s$")
SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: A piece is cut further at lone line ends and between a letter and the punctuation that follows.
INNER = re.compile(r"(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=[A-Za-z])(?=[.,;:!?])")


class Counter:
    """Counts tokens as the tokenizers library does, without added special tokens; special strings in a text keep their default meaning."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def _encode(self, pieces: list[str]) -> None:
        at, size, batch = 0, 0, []
        for at, p in enumerate(pieces):
            batch.append(p)
            size += len(p) + 8
            if size >= AT_ONCE or at == len(pieces) - 1:
                for piece, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                    self.known[piece] = len(e)
                size, batch = 0, []

    def learn(self, pieces: set[str]) -> None:
        inner = {p: INNER.split(p) for p in pieces}
        known, tokenize, others = self.known, self.tokenizer.model.tokenize, []
        for p in {x for parts in inner.values() for x in parts} - known.keys():
            # Letters, after a space or not, are one unit of the model: the splitter would leave them alone.
            if (p[1:] if p[:1] == " " else p).isalpha():
                known[p] = len(tokenize(byte_letters(p)))
            else:
                others.append(p)
        self._encode(others)
        for p, parts in inner.items():
            if len(parts) > 1:
                known[p] = sum(known[x] for x in parts)

    def count(self, texts: list[str | None]) -> list[int]:
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif "\0" in t or ADJACENT.search(t):
                cut.append(SAFE.split(t))
            else:
                cut.append(t.replace(" ", "\0 ").split("\0"))
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = set().union(*cut) - self.known.keys() if cut else set()
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [sum(map(get, pieces)) for pieces in cut]


@functools.lru_cache(maxsize=1)
def counter_of(path: str) -> Counter:
    """One counter for each Python worker: what it remembers serves all tasks that the worker runs."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str | None = None, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; vocabulary: path of a tokenizers file."""
    small_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in batches:
            n = counter.count(b.column(1).to_pylist())
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = out.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > over)
