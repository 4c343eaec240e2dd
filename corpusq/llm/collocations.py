"""Phrase collocations, counted in HAT-tries.

Phrases are counted length by length. Each task walks over its whole texts and counts phrases of n words in a HAT-trie:
a trie over word ids, two levels deep at most, whose leaves are hash containers; a container that outgrows its size
bursts into one for each next word. A trie that holds too many phrases spills its largest subtrees whole, as runs sorted
by phrase: one compressed run for each prefix partition. A prefix (the first two words; with more words spread over
SPREAD neighbours, so that a hot prefix is no single group) names the partition where its runs are merged; there the
phrases that are frequent enough over all runs stay.

In runs a word is its 64-bit hash, seeded by its language, so that no task needs the words of the whole corpus. Hashes of
the frequent words are checked: if two were equal, all would be made anew with another salt.

The next length needs no other phrases than those whose shorter phrases are frequent (of two words for three, of three
for four and five, which are counted in one pass). Tasks learn which are from a Bloom filter over the frequent phrases: it has 16 bits for each, up to a fixed size, and a filter that is
too full lets more phrases be counted but loses none. So what tasks hold is bounded whatever the corpus holds: the
filter, a trie, and a vocabulary that is forgotten (after a spill) when it has too many words or bytes.

Scores are exact: products of counts are decimals of 38 digits, and the quotient is a whole number.

Defined cases: null or empty text has no words; a null language is `und`, together with rows that say so; null doc_id
and repeated rows count like any other; other columns of the input are ignored; no frequent phrase: no rows.
Bytes that are no UTF-8 become replacement characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import LOWER, UPPER, small_batches, stage

LEAST, WORDS, TOP = 100, 5, 2000
#: Bytes that are split into words at once; entries of a container before it bursts; entries of a trie before it spills.
SLICE, BURST, ENTRIES = 2 << 20, 4096, 1 << 20
#: Words and bytes of a vocabulary before it is forgotten. An id has ID bits, so three fit into 64.
VOCABULARY, VOCABULARY_BYTES, ID = 1 << 19, 32 << 20, 21
#: Bits of the filter for each phrase, of one of its blocks, and of the largest filter.
BITS, BLOCK_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Rows of words that travel at once; words of the corpus for each prefix partition, and partitions at most; partitions that phrases of one prefix may lie in.
ROWS, PARTITION_WORDS, MOST_PARTITIONS, SPREAD = 100_000, 1 << 22, 1 << 22, 16
#: Rows that are merged at once.
MERGE = 1 << 21

_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Lower case, one kind of blank, one kind of break. A break is a word of its own, which no word of a text can be.
_PLAIN = bytes.maketrans(UPPER.encode() + b"\t" + _BREAKS, LOWER.encode() + b" " + b"." * len(_BREAKS))

_MASK = (1 << ID) - 1
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def slices(texts: list[bytes], size: int = SLICE) -> Iterator[list[bytes]]:
    """The words and breaks of texts, some at a time; after each text there is a break."""
    held, n = [], 0

    def cut(blob: bytes) -> Iterator[list[bytes]]:
        at = 0
        while at < len(blob):
            end = blob.find(b" ", at + size)
            end = len(blob) if end < 0 else end
            yield blob[at:end].split()
            at = end

    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield from cut(b".".join([*held, b""]).translate(_PLAIN).replace(b".", b" . "))
            held, n = [], 0
    if held:
        yield from cut(b".".join([*held, b""]).translate(_PLAIN).replace(b".", b" . "))


def seed_of(lang: bytes, salt: str) -> int:
    return xxhash.xxh64_intdigest(lang, xxhash.xxh64_intdigest(salt.encode(), 42))


def word_hash(lang: str, word: str, salt: str):
    """The hash that tasks give a word, as a column."""
    return F.xxhash64(F.lit(salt), lang, word)


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each phrase, from those of its first, second ... words."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint64(29))) * _C1 + h
    return (out ^ (out >> np.uint64(32))) * _C2


class Filter:
    """A Bloom filter in blocks: a hash's upper bits choose a block, its lower ones three bits there."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @staticmethod
    def size(phrases: int) -> int:
        """Blocks for so many phrases."""
        return int(min(MOST_BITS // BLOCK_BITS, max(1, 1 << (max(1, -(-phrases * BITS // BLOCK_BITS)) - 1).bit_length())))

    @staticmethod
    def block(h: np.ndarray, n: int) -> np.ndarray:
        return (h >> np.uint64(44)).astype(np.int64) % n

    @staticmethod
    def places(h: np.ndarray, i: int) -> np.ndarray:
        return ((h >> np.uint64(13 * i)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) if i < 2 else (((h * _C1) >> np.uint64(40)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        block = self.block(h, len(self.blocks))
        for i in range(3):
            at = np.flatnonzero(out)
            p = self.places(h[at], i)
            out[at] = (self.blocks[block[at], p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def filter_of(phrases: DataFrame, words: int) -> Filter:
    """The filter of a written table of phrases (h: hashes of their words). Its blocks, of a fixed number at most, pass through the driver."""
    blocks = Filter.size(phrases.count())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = np.asarray(b.column(0).flatten()).view(np.uint64).reshape(b.num_rows, words)
                f = fold([h[:, i] for i in range(words)])
                yield pa.RecordBatch.from_arrays([pa.array(Filter.block(f, blocks)), pa.array(f.view(np.int64))], ["block", "h"])

    def marked(df: pd.DataFrame) -> pd.DataFrame:
        h, bits = df["h"].to_numpy(np.int64).view(np.uint64), np.zeros(BLOCK_BITS, bool)
        for i in range(3):
            bits[Filter.places(h, i)] = True
        return pd.DataFrame({"block": [int(df["block"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for r in phrases.select("h").mapInArrow(hashed, "block long, h long").groupBy("block").applyInPandas(marked, "block long, bits binary").collect():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return Filter(out)


class _Words(dict):
    """Words of one language to ids, which a vocabulary gives out as words come up."""

    def __init__(self, lang: bytes, to: Vocabulary):
        super().__init__()
        self.seed, self.to = seed_of(lang, to.salt), to

    def __missing__(self, word: bytes) -> int:
        self[word] = i = self.to.next
        self.to.next += 1
        self.to.new.append(word)
        return i


class Vocabulary:
    """(language, word) to ids; a break is -1, as is a word that the filter does not have."""

    def __init__(self, known: Filter | None, salt: str):
        self.known, self.salt, self.next, self.bytes, self.of, self.new = known, salt, 0, 0, {}, []
        self.hashes, self.use = np.zeros(1 << 12, np.uint64), np.full(1 << 12, -1, np.int64)

    def ids(self, lang: bytes, words: list[bytes]) -> np.ndarray:
        own = self.of.get(lang)
        if own is None:
            own = self.of[lang] = _Words(lang, self)
        first = self.next
        out = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
        while self.next > len(self.use):
            self.hashes, self.use = np.r_[self.hashes, np.zeros_like(self.hashes)], np.r_[self.use, np.full_like(self.use, -1)]
        if self.new:
            digest, seed, n = xxhash.xxh64_intdigest, own.seed, self.next
            h = np.array([digest(w, seed) for w in self.new], np.uint64)
            ok = self.known.has(fold([h])) if self.known else np.ones(len(h), bool)
            ok &= h != np.uint64(digest(b".", seed))
            self.hashes[first:n], self.use[first:n] = h, np.where(ok, np.arange(first, n), -1)
            self.bytes += sum(map(len, self.new))
            self.new.clear()
        return self.use[out]

    def full(self) -> bool:
        return self.next > VOCABULARY or self.bytes > VOCABULARY_BYTES


class HatTrie:
    """Counts of phrases of n word ids. A node is a dict: a hash container (packed remaining ids to count), or a Node of containers."""

    class Node(dict):
        pass

    def __init__(self, n: int, burst: int = BURST):
        self.n, self.burst, self.entries = n, burst, 0
        self.root: dict[int, dict] = {}

    def add(self, first: np.ndarray, rest: list[int], counts: np.ndarray) -> None:
        """Distinct phrases, sorted: first ids, the other n-1 ids packed, counts."""
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        ends, counts = [*starts[1:], len(first)], counts.tolist()
        for lo, hi in zip(starts, ends, strict=True):
            w = int(first[lo])
            node = self.root.get(w)
            if node is None:
                node = self.root[w] = {}
            if type(node) is self.Node:
                shift = ID * (self.n - 2)
                mask = (1 << shift) - 1
                for key, c in zip(rest[lo:hi], counts[lo:hi], strict=True):
                    leaf = node.setdefault(key >> shift, {})
                    key &= mask
                    self.entries += key not in leaf
                    leaf[key] = leaf.get(key, 0) + c
                continue
            before = len(node)
            get = node.get
            for key, c in zip(rest[lo:hi], counts[lo:hi], strict=True):
                node[key] = get(key, 0) + c
            self.entries += len(node) - before
            if len(node) > self.burst and self.n > 2:
                self.root[w] = self._burst(node)

    def _burst(self, leaf: dict) -> HatTrie.Node:
        out, shift = self.Node(), ID * (self.n - 2)
        for key, c in leaf.items():
            out.setdefault(key >> shift, {})[key & ((1 << shift) - 1)] = c
        return out

    def spill(self, keep: int) -> Iterator[tuple[int, dict]]:
        """Takes the largest subtrees out, whole, until at most `keep` entries stay: (first id, {packed other ids: count})."""
        size = lambda x: sum(map(len, x.values())) if type(x) is self.Node else len(x)
        for n, w in sorted(((size(x), w) for w, x in self.root.items()), reverse=True):
            if self.entries <= keep:
                return
            node = self.root.pop(w)
            self.entries -= n
            if type(node) is self.Node:
                shift = ID * (self.n - 2)
                node = {a << shift | b: c for a, leaf in node.items() for b, c in leaf.items()}
            yield w, node


def _pack(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Id columns, three to an integer."""
    out = []
    for i in range(0, len(columns), 3):
        x = columns[i]
        for c in columns[i + 1 : i + 3]:
            x = x << ID | c
        out.append(x)
    return out


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Phrases (their first, second ... ids) to the distinct ones, sorted: first ids, the others packed, counts."""
    packed = _pack(columns)
    order = np.argsort(packed[0]) if len(packed) == 1 else np.lexsort(packed[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for p in packed:
        s = p[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    rows = order[at]
    counts = np.diff(np.r_[at, len(order)])
    tail = _pack([c[rows] for c in columns[1:]])
    rest = tail[0].tolist() if len(tail) == 1 else [a << ID * (len(columns) - 4) | b for a, b in zip(tail[0].tolist(), tail[1].tolist(), strict=True)]
    return columns[0][rows], rest, counts


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def packed_run(h: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Phrases (hashes of their first, second ... words), sorted by the first two, and their counts: the run's own words, then their places in it, all by byte planes and compressed."""
    words, places = np.unique(np.concatenate(h), return_inverse=True)
    places = places.astype(np.uint32).reshape(len(h), -1)
    first = np.diff(places[0], prepend=np.uint32(0))
    parts = [_planes(np.diff(words, prepend=np.uint64(0))), _planes(first), *[_planes(c) for c in places[1:]], _planes(counts.astype(np.uint64))]
    return len(words).to_bytes(8, "little") + zstandard.ZstdCompressor(1).compress(b"".join(parts))


def unpacked_run(body: bytes, n: int) -> np.ndarray:
    """Columns of phrases and, last, of counts."""
    k, raw = int.from_bytes(body[:8], "little"), zstandard.ZstdDecompressor().decompress(body[8:])
    words = np.cumsum(_from_planes(raw[: 8 * k], np.uint64), dtype=np.uint64)
    rows = (len(raw) - 8 * k) // (4 * n + 8)
    places = [_from_planes(raw[8 * k + 4 * rows * i : 8 * k + 4 * rows * (i + 1)], np.uint32) for i in range(n)]
    places[0] = np.cumsum(places[0], dtype=np.uint32)
    return np.stack([*[words[p] for p in places], _from_planes(raw[8 * k + 4 * rows * n :], np.uint64)])


def summed(columns: np.ndarray) -> np.ndarray:
    """Columns of phrases and counts to those of distinct phrases and sums."""
    words = list(columns[:-1])
    key = fold(words)
    order = np.argsort(key)
    key = key[order]
    sorted_ = columns[:, order]
    same = key[1:] == key[:-1]
    if not (sorted_[:-1, 1:] == sorted_[:-1, :-1])[:, same].all():  # two phrases of one key
        sorted_ = columns[:, np.lexsort(words)]
        same = (sorted_[:-1, 1:] == sorted_[:-1, :-1]).all(axis=0)
    at = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), ~same])
    out = sorted_[:, at]
    if len(at):
        out[-1] = np.add.reduceat(sorted_[-1], at)
    return out


class PhraseCounter:
    """Counts phrases of several lengths of one task's texts and yields runs: (words, partition, sorted phrases). shorter: the filter of phrases of `known` words, all of which a phrase needs."""

    def __init__(self, lengths: tuple[int, ...], partitions: int, words: Filter | None, shorter: Filter | None, known: int = 1, salt: str = "0", entries: int = ENTRIES):
        self.lengths, self.partitions, self.words, self.shorter, self.known, self.salt, self.limit = lengths, partitions, words, shorter, known, salt, entries
        self._forget()

    def _forget(self) -> None:
        self.tries, self.vocabulary = {n: HatTrie(n) for n in self.lengths}, Vocabulary(self.words, self.salt)

    def add(self, lang: bytes, texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        tail: list[bytes] = []
        longest = max(self.lengths)
        for words in slices(texts):
            # The last words of the slice before come first; phrases that lie in them alone are counted already.
            old = len(tail)
            words = tail + words
            ids = self.vocabulary.ids(lang, words)
            tail = words[len(words) - min(len(words), longest - 1) :]
            self._count(ids, self.vocabulary, old)
            if sum(t.entries for t in self.tries.values()) > self.limit:
                yield from self._runs(self.limit // 2 // len(self.lengths))
            if self.vocabulary.full():
                yield from self.end()
                self._forget()

    def _count(self, ids: np.ndarray, v: Vocabulary, old: int) -> None:
        """ids: the first `old` of them were there before."""
        good = ids >= 0
        if self.known > 1:
            m = self.known
            whole = np.zeros(max(0, len(ids) - m + 1), bool)
            whole[:] = good[: len(whole)]
            for i in range(1, m):
                whole &= good[i : len(whole) + i]
            at = np.flatnonzero(whole)
            whole[at] = self.shorter.has(fold([v.hashes[ids[at + i]] for i in range(m)]))
            good = whole
        for n, trie in self.tries.items():
            size = len(ids) - n + 1
            if size <= 0:
                continue
            ok = good[:size].copy()
            for i in range(1, n - self.known + 1):
                ok &= good[i : size + i]
            ok[: max(0, old - n + 1)] = False
            at = np.flatnonzero(ok)
            if len(at):
                trie.add(*distinct([ids[at + i] for i in range(n)]))

    def _runs(self, keep: int) -> Iterator[tuple[int, int, bytes]]:
        for n, trie in self.tries.items():
            first, keys, counts = [], [], []
            for w, leaf in trie.spill(keep):
                first += [w] * len(leaf)
                keys += leaf
                counts += leaf.values()
            if not first:
                continue
            if n <= 4:
                packed = np.array(keys, np.int64)
                rest = [packed >> ID * i & _MASK for i in range(n - 2, -1, -1)]
            else:  # four ids don't fit into 64 bits
                high, low = (np.array([f(k) for k in keys], np.int64) for f in (lambda k: k >> 2 * ID, lambda k: k & (1 << 2 * ID) - 1))
                rest = [high >> ID, high & _MASK, low >> ID, low & _MASK]
            columns = [self.vocabulary.hashes[c] for c in (np.array(first), *rest)]
            part, counts = partition_of(columns, self.partitions), np.array(counts, np.uint64)
            order = np.lexsort((columns[1], columns[0], part))
            part, counts, columns = part[order], counts[order], [c[order] for c in columns]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for lo, hi in zip(starts, [*starts[1:], len(part)], strict=True):
                yield n, int(part[lo]), packed_run([c[lo:hi] for c in columns], counts[lo:hi])

    def end(self) -> Iterator[tuple[int, int, bytes]]:
        yield from self._runs(0)


def partition_of(columns: list[np.ndarray], partitions: int) -> np.ndarray:
    """The prefix partition of phrases."""
    part = fold(columns[:2])
    if len(columns) > 2:
        part = part + fold(columns) % np.uint64(SPREAD)
    return (part % np.uint64(partitions)).astype(np.int64)


class WordCounter:
    """The first length: a hash container of words for each language. The count of all words goes with an empty word."""

    def __init__(self, entries: int = ENTRIES):
        self.limit, self.counts = entries, {}

    def add(self, lang: bytes, texts: list[bytes]) -> Iterator[tuple[bytes, list[bytes], list[int]]]:
        for words in slices(texts):
            counts = self.counts.setdefault(lang, Counter())
            counts.update(words)
            counts[b""] += len(words) - counts.pop(b".", 0)
            if sum(map(len, self.counts.values())) > self.limit:
                yield from self.end()

    def end(self) -> Iterator[tuple[bytes, list[bytes], list[int]]]:
        for lang, counts in self.counts.items():
            run = sorted(counts)
            for lo in range(0, len(run), ROWS):
                some = run[lo : lo + ROWS]
                yield lang, some, [counts[w] for w in some]
        self.counts = {}


def _by_lang(b: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
        if t:
            out.setdefault(lang, []).append(t)
    return out


def _strings(words: list[bytes]) -> pa.Array:
    try:
        return pa.array(words, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([w.decode("utf-8", "replace") for w in words], pa.string())


def frequent_words(texts: DataFrame, least: int, entries: int = ENTRIES) -> DataFrame:
    """lang, word, n of the words that are frequent enough, and for each language a row with an empty word and the count of all words. texts: lang, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(entries)
        out = lambda r: pa.RecordBatch.from_arrays([pa.array([r[0].decode()] * len(r[1])), _strings(r[1]), pa.array(r[2], pa.int64())], ["lang", "word", "n"])
        for b in batches:
            for lang, own in _by_lang(b).items():
                yield from map(out, counter.add(lang.encode(), own))
        yield from map(out, counter.end())

    found = texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return stage(found.where((F.col("n") >= least) | (F.col("word") == "")))


def frequent_phrases(texts: DataFrame, lengths: tuple[int, ...], least: int, partitions: int, words: Filter, shorter: Filter, known: int, salt: str, entries: int = ENTRIES) -> DataFrame:
    """h (hashes of the words) and n of the phrases of these lengths that are frequent enough; shorter: the filter of the frequent phrases of `known` words."""
    shared = texts.sparkSession.sparkContext.broadcast((words, None if shorter is words else shorter))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PhraseCounter(lengths, partitions, *shared.value, known, salt, entries)

        def out(runs: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, int, bytes]] = []
            for r in runs:
                held.append(r)
                if len(held) >= 1000:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)

        batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["words", "part", "body"])
        for b in batches:
            for lang, own in _by_lang(b).items():
                yield from out(counter.add(lang.encode(), own))
        yield from out(counter.end())

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        held, rows, n = [], 0, int(df["words"].iloc[0])
        for body in df["body"]:
            held.append(unpacked_run(body, n))
            rows += held[-1].shape[1]
            if rows > MERGE:
                held = [summed(np.concatenate(held, axis=1))]
                rows = held[0].shape[1]
        got = summed(np.concatenate(held, axis=1))
        got = got[:, got[-1] >= least]
        return pd.DataFrame({"h": list(np.ascontiguousarray(got[:-1].T).view(np.int64)), "n": got[-1].astype(np.int64)})

    return stage(texts.mapInArrow(count, "words long, part long, body binary").groupBy("words", "part").applyInPandas(merge, "h array<long>, n long"))


def counted(docs: DataFrame, least: int = LEAST, longest: int = WORDS, entries: int = ENTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals (lang, total), frequent words (lang, word, code, n) and all frequent phrases of 1 to `longest` words (h: codes of their words, n)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    found = frequent_words(texts, least, entries)
    totals = found.where("word = ''").select("lang", F.col("n").alias("total"))
    own = found.where("word <> ''")
    salt = next(s for s in map(str, range(100)) if own.groupBy(word_hash("lang", "word", s)).count().where("count > 1").isEmpty())
    words = own.select("lang", "word", word_hash("lang", "word", salt).alias("code"), "n")
    level = out = words.select(F.array("code").alias("h"), "n")
    partitions = max(1, min(MOST_PARTITIONS, (totals.agg(F.sum("total")).first()[0] or 0) // PARTITION_WORDS))
    known = None
    at = 1
    # Two words, three, then four and five at once: what three frequent phrases of three words leave of five is little.
    for lengths in [(2,), (3,), (4, 5)]:
        lengths = tuple(n for n in lengths if n <= longest)
        if not lengths or level.isEmpty():
            break
        shorter = filter_of(level, at)
        known = known or shorter
        level = frequent_phrases(texts, lengths, least, partitions, known, shorter, at, salt, entries)
        out, at = out.unionByName(level), lengths[0]
    return totals, words, out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = WORDS, top: int = TOP, share: int = 100, entries: int = ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best `top` phrases. share: percent of its occurrences that a longer candidate must have to take a phrase's place."""
    totals, words, counts = counted(docs, least, longest, entries)
    candidates = counts.where(F.size("h") > 1).withColumnRenamed("n", "a")

    # Every phrase inside a longer candidate, with the largest count of those.
    inner = F.expr("flatten(transform(sequence(2, size(h) - 1), m -> transform(sequence(1, size(h) - m + 1), i -> slice(h, i, m))))")
    longer = candidates.where(F.size("h") > 2).select(F.explode(F.array_distinct(inner)).alias("h"), "a").groupBy("h").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, "h", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).select("h", "a")

    # Codes become words: a row for each word of a phrase.
    each = kept.select("h", "a", F.posexplode("h").alias("at", "code")).join(words.select("code", "lang", "word"), "code")
    named = each.groupBy("h", "a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.first("lang").alias("lang")).join(totals, "lang")

    cut = named.select("h", "phrase", "lang", "a", "total", F.explode(F.sequence(F.lit(1), F.size("h") - 1)).alias("k"))
    cut = cut.select("*", F.expr("slice(h, 1, k)").alias("first"), F.expr("slice(h, k + 1, size(h))").alias("rest"))
    part = lambda name, to: counts.select(F.col("h").alias(name), F.col("n").alias(to))
    cut = cut.join(part("first", "l"), "first").join(part("rest", "r"), "rest")
    whole = "cast({} as decimal(19, 0))"
    score = F.expr(f"({whole.format('1000 * a')} * {whole.format('total')}) div ({whole.format('l')} * {whole.format('r')})").alias("score")
    best = cut.select("lang", "phrase", "a", "total", F.struct(score, "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "total").agg(F.min("cut").alias("cut"))
    flat = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
