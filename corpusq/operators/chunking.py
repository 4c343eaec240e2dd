"""Chunks of whole tables of documents, and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import structure as S
from corpusq.functions import text as T

TARGET, OVERLAP, LEAST = 1000, 200, 50


def assemble(docs: DataFrame, units: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """doc_id, chunk_index, char_start, char_end, text, token_count (TXT14): units in order fill windows of `target` tokens.

    A full window's tail, as long as the overlap's share of it, opens the next. A unit over the target stands alone, unless
    it opens a window. Windows under `least` tokens are dropped. A document's units are folded in one row."""
    if overlap >= target:
        raise ValueError("overlap must be smaller than target")
    grouped = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "token_count"))).alias("units"))
    rewound = f"greatest(a.s, a.e - cast(floor((a.e - a.s) * {overlap / target!r}D) as int))"
    closed = "concat(a.done, array(named_struct('s', a.s, 'e', a.e)))"
    state = "named_struct('done', {0}, 's', {1}, 'e', {2}, 't', {3})"
    opened = state.format("a.done", "u.char_start", "u.char_end", "u.token_count")
    alone = state.format("concat(a.done, array(named_struct('s', a.s, 'e', a.e), named_struct('s', u.char_start, 'e', u.char_end)))", "cast(null as int)", "0", "0")
    turned = state.format(closed, rewound, "u.char_end", rf"u.token_count + regexp_count(substring(text, {rewound} + 1, a.e - {rewound}), '(?U)\\s+')")
    grown = state.format("a.done", "a.s", "u.char_end", "a.t + u.token_count")
    fold = f"""aggregate(units, named_struct('done', cast(array() as array<struct<s: int, e: int>>), 's', cast(null as int), 'e', 0, 't', 0),
        (a, u) -> case when a.s is null then {opened} when u.token_count > {target} then {alone} when a.t + u.token_count > {target} then {turned} else {grown} end,
        a -> if(a.s is null, a.done, {closed}))"""
    cut = docs.select("doc_id", "text").join(grouped, "doc_id").select("doc_id", "text", F.posexplode(F.expr(fold)).alias("n", "w"))
    cut = cut.select("doc_id", "n", F.col("w.s").alias("char_start"), F.col("w.e").alias("char_end"), F.expr("substring(text, w.s + 1, w.e - w.s)").alias("text"))
    cut = cut.withColumn("token_count", T.token_count(F.col("text"))).where(F.col("token_count") >= least)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1
    return cut.select("doc_id", index.alias("chunk_index"), "char_start", "char_end", "text", "token_count")


def cut_documents(docs: DataFrame, found: DataFrame | None, strategy: str = "heading", target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Chunks as assemble() gives them. docs: doc_id, text (clean); found: headings, for the strategy heading; or paragraph or fixed."""
    units = {"heading": lambda: S.sections(docs, found), "paragraph": lambda: S.paragraphs(docs), "fixed": lambda: S.windows(docs, target, overlap)}[strategy]()
    return assemble(docs, units, target, overlap, least)


def chunk_documents(docs: DataFrame, strategy: str = "heading", target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Chunks with section_path and breadcrumb (TXT15). docs: doc_id, filename, text (clean). strategy: heading, paragraph or fixed."""
    found = S.headings(docs)
    cut = cut_documents(docs, found, strategy, target, overlap, least)
    titles = docs.select("doc_id", F.trim(F.translate(F.regexp_replace("filename", r"\.[^.]*$", ""), "-_", "  ")).alias("stem"), "filename")
    titles = titles.select("doc_id", F.when(F.col("stem") == "", F.col("filename")).otherwise(F.col("stem")).alias("title"))
    out = S.section_paths(cut, found).join(titles, "doc_id")
    return out.withColumn("breadcrumb", S.breadcrumb(F.col("title"), F.col("section_path"))).drop("title")


_BREAK = re.compile("\n\n|(?P<stop>[.!?][.!?\"')\\]}\u201d\u2019]*+)(?:\\s*\\[\\d+\\])*+(?=[ \\t]*(?:\n|\\Z|[A-Z0-9\"'(\\[]))", re.S)
_TAIL = re.compile(r"(?:[^\W_]|\.)*\Z")

#: Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset("e.g i.e etc vs al cf approx no fig eq mr mrs ms dr prof inc ltd co corp dept est min max vol ch sec art para pp".split())


def _stop_inside(text: str, dot: int) -> bool:
    """Whether a full stop belongs to a decimal number, an abbreviation or an initial."""
    if text[dot - 1 : dot].isdigit() and text[dot + 1 : dot + 2].isdigit():
        return True
    word = _TAIL.search(text[max(0, dot - 60) : dot]).group().lower()
    return word in ABBREVIATIONS or (len(word) == 1 and word.isalpha())


def split_sentences(text: str) -> tuple[list[str], str]:
    """Whole sentences with the citations behind them, and the rest. A blank line also ends one."""
    out, start, at = [], 0, 0
    while m := _BREAK.search(text, at):
        if m["stop"] and text[m.start()] == "." and _stop_inside(text, m.start()):
            at = m.start() + 1
            continue
        out.append(text[start : m.end()].strip())
        start = at = m.end()
    return [s for s in out if s], text[start:].strip()


def sentences(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sent_idx (from 0), sentence (TXT17); null texts have none."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b["text"]):
                whole, rest = split_sentences(t or "")
                rows += [(k, i, s) for i, s in enumerate(whole + ([rest] if rest else []))]
            yield pd.DataFrame(rows, columns=[key, "sent_idx", "sentence"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, "text").mapInPandas(split, f"{key} {kind}, sent_idx int, sentence string")
