"""The pipeline against plain versions of its stages, and with extra columns of every odd name."""

import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusq.llm import line_dedup, packing, simhash

D = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "source").collect()]
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    weights = brute.ftrl([(brute.features(t, 18), marks[i]) for i, t, _ in sorted(docs) if marks.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1])
    scores = {i: brute.score(t, weights) for i, t, _ in docs}
    assert min(abs(s - 0.5) for s in scores.values()) > 1e-4  # weights travel as 32-bit numbers
    now = [d for d in docs if scores[d[0]] >= 0.5]
    now = [(i, "\n".join(k), s) for (i, _, s), k in zip(now, brute.kept_lines([d[:2] for d in now]), strict=True)]
    least = {}
    for d, g in zip(now, brute.classes([brute.fingerprint(t) for _, t, _ in now]), strict=True):
        least[g] = min(d, least.get(g, d))
    now = sorted(least.values())
    assert len(docs) > len(scores) - 1 and 0 < len(now) < len(docs)
    text = {i: t for i, t, _ in now}
    taken, _ = brute.mix(now)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, total = [], 0
    for i in (i for _, i in taken):
        ids = tokenizer.encode(text[i], add_special_tokens=False).ids + [0]
        total += len(ids)
        expected += [(i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())) for p in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, D).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= packing.lower_bound(np.array([x[3] for x in expected]), 2048) + 1 and len(bins) >= -(-total // 2048)


NAMES = """score fp component_id label root lines n_lines n_dropped size source_size target times position d h u v node row1 row2 of one order bucket within
    before number middle taken slope pass at to to1 to2 place own least anchor digest keeper gone quality held_out
    _h _d _k _at _x _l _gone _row _t _o _b _p _so _bb _in _middle _slope __h Row1 OWN weight kind""".split()


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(spark, stage):
    """Extra columns named like results and helpers pass with their values; null and repeated rows don't stop a stage."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    wide = docs.unionByName(odd)
    spark.conf.set("spark.sql.caseSensitive", "false")
    taken, names = {c.lower() for c in docs.columns}, []
    for c in NAMES:
        if c.lower() not in taken:
            taken.add(c.lower())
            names.append(c)
    wide = wide.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in names})
    wide = corpus_pipeline.stage(wide)
    name, f = corpus_pipeline.STAGES[stage]
    out = corpus_pipeline.stage(f(spark, wide, D))
    assert out.columns == wide.columns, name
    wrong = F.lit(False)
    for c in names:
        wrong = wrong | ~F.col(c).eqNullSafe(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")))
    assert out.where(wrong).count() == 0 and out.where("doc_id is not null").count() > 0
    plain = f(spark, docs.unionByName(odd), D)
    assert sorted(map(str, plain.select("doc_id", "text").collect())) == sorted(map(str, out.select("doc_id", "text").collect()))


def test_packing_takes_extra_columns(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumns({c: F.lit("x") for c in ("piece", "start", "length", "offset", "sequence_id", "ids_crc32")})
    assert corpus_pipeline.pack(spark, docs, D).count() >= docs.count()


def test_one_of_each_and_line_dedup_take_maps(spark):
    df = spark.createDataFrame([(1, "a b", {"k": 1}), (2, "a b", {"k": 2})], "doc_id long, text string, m map<string,int>")
    assert [(r.doc_id, r.m) for r in simhash.one_of_each(df).collect()] == [(1, {"k": 1})]
    assert line_dedup.line_dedup(df).columns == ["doc_id", "text", "m", "n_lines", "n_dropped"]
