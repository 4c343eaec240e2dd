"""Best-fit packing with certified bin counts.

1. Texts become token ids; a document longer than a sequence is cut into whole sequences and a last piece.
2. Pieces are dealt by length into groups of bounded size and like mixture, and each group is packed best-fit decreasing.
   Dual-feasible functions give a lower bound on any packing of the group; a group whose bin count meets
   it is certified and keeps its bins, all but its emptiest. A group with a gap keeps only its full bins.
3. The documents of the bins that were given up meet in new, fewer groups and are packed again. This goes
   on until they fit one group or don't get fewer; the last round keeps all bins.

Defined cases: null or empty text is the end id alone; a text of only white space likewise; null doc_id and
repeated rows are packed like others, one set of pieces for each input row; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusq.llm.common import byte_letters, small_batches, stage

VOCABULARY, CAPACITY, END = "word_bpe_49k.json", 2048, 0
#: Pieces of a group on average, rounds at most, and words that a worker remembers.
GROUP, ROUNDS, REMEMBER = 2_000, 6, 700_000

_TAIL = b".,;:!?"
_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Words(dict):
    """Ids of words as bytes; a word that is not known yet is encoded when it is looked up."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, w: bytes) -> bytes:
        stem = w.rstrip(_TAIL)
        if len(stem) < len(w) and stem and stem[-1] in _LETTERS:
            # Punctuation after an ASCII letter is a token of its own: stem and tail are encoded apart.
            out = self[stem] + self[w[len(stem) :]]
        else:
            t = w.decode("utf-8", "replace")
            if t.isalpha() and t.islower() and t == t.lower() and (t.isascii() or unicodedata.is_normalized("NFC", t)):
                # A lower-case word of letters, in composed form, is one unit of the model: normalizer and splitter would leave it alone.
                ids = [x.id for x in self.model(byte_letters(t))]
            else:
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
            out = b"".join([self.id_bytes[i] for i in ids])
        self[w] = out
        return out


class Encoder:
    """Ids of whole texts as bytes. The vocabulary drops white space and no token crosses it, so words are encoded one by one, each once."""

    def __init__(self, path: str):
        self.known = Words(path)

    def encode(self, text: bytes | None) -> bytes:
        if len(self.known) > REMEMBER:
            self.known.clear()
        t = text or b""
        # The vocabulary is lower-case; doing A-Z first leaves fewer words to know. Not beside combining marks or special strings.
        return b"".join(map(self.known.__getitem__, (t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split()))


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker: what it remembers serves all tasks that the worker runs."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path), np.array([END], "<u4").tobytes()
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), 200):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(texts[lo : lo + 200], lo):
                    ids = encoder.encode(text) + end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((i, p, at // 4, len(part) // 4, zlib.crc32(part)))
                where, p, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(where)), pa.array(p, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r is open
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - n
        if left[b]:
            by_room[left[b]].append(b)
            rooms |= 1 << left[b]
    return bins, offsets, capacity - np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds that two families of dual-feasible functions give."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // capacity)
    # Items over capacity - e count as whole bins, items under e as nothing, the others as they are.
    count, size = np.cumsum(n), np.cumsum(n * x)
    e = np.arange(1, capacity // 2 + 1)
    whole = count[-1] - count[capacity - e]
    between = size[capacity - e] - size[e - 1]
    best = max(best, int((whole - (-between // capacity)).max()))
    # (k + 1) x rounded down, over k; multiples of 1 / (k + 1) stay as they are.
    for k in range(1, 40):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, scaled * k, (scaled // capacity) * capacity * (k + 1))  # times capacity * k * (k + 1)
        best = max(best, -(-int((n * value).sum()) // (capacity * k * (k + 1))))
    return best


def _round(r: int, last: bool, capacity: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        lengths = df["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit(lengths, capacity)
        if last:
            stays = np.ones(len(fill), bool)
        elif len(fill) == lower_bound(lengths, capacity):
            stays = np.arange(len(fill)) != fill.argmin()
        else:
            stays = fill == capacity
        out = df.drop(columns="_g")
        base = (np.int64(r) << 56) + (df["_g"].to_numpy(np.int64) << 20)
        out["sequence_id"], out["offset"], out["_done"] = base + bins, offsets, stays[bins]
        return out

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """items (with length, at most capacity) with sequence_id and offset."""
    # A number for each row, drawn before the rows are written, deals equal rows to different groups.
    items = stage(items.withColumn("_u", F.monotonically_increasing_id()))
    schema = StructType([*items.schema.fields]).add("sequence_id", "long").add("offset", "long")
    done = [items.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})]
    rest, before = items.where(F.col("length") < capacity), None
    for r in range(rounds):
        n = rest.count()
        groups = -(-n // group)
        if not n:
            break
        last = groups == 1 or r == rounds - 1 or (before is not None and n > 0.9 * before)
        before = n
        names = rest.columns
        # Pieces are dealt out in order of length, so each group gets its share of long and short ones. _u makes the order the same in a task's second run.
        dealt = rest.sortWithinPartitions("length", "_u")
        keyed = dealt.withColumn("_g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("long"))
        packed = stage(keyed.groupBy("_g").applyInPandas(_round(r, last, capacity), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _done boolean"))
        done.append(packed.where("_done").drop("_done"))
        if last:
            break
        rest = packed.where("not _done").select(*names)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("_u")


def packed_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, vocabulary, capacity), capacity)
