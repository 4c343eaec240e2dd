"""Defined cases of the training-data operators, held against brute force on small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from corpusq.llm import classifier, components, html_text, licenses, line_dedup, mixing, packing, quality_rules, simhash, tokens, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, w string, h string, label string, page long"
BASE = "the quick brown fox jumps over the lazy dog and runs away from all of them in a wood near the old town while it rains"
LINE = "This very common line stands in many documents."


def rows():
    texts = [None, "", "   \n\t", "one", BASE, BASE, BASE.replace("lazy", "Lazy"), BASE + " twice", LINE, f"{LINE}\nother a\n{LINE.upper()} ", f"x\n{LINE}\n\ny", "é ü ß 日本 <|endoftext|> it's!!",
             "MIT License, then Apache License: cc-by cc by. Released under the MIT License.", "a b a b a b a b a b " * 40, "word " * 9000 + "end.", " ".join(f"w{i}" for i in range(400))]
    out = [(i, t, "en", f"s{i % 4}" if i % 5 else None, 0, 1.0, "w", "h", "l", 1) for i, t in enumerate(texts)]
    return out + [out[4], (None, BASE, "en", "s1", 0, 1.0, "w", "h", "l", 1), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    got = [simhash.simhash_components(empty), simhash.one_of_each(empty), html_text.html_text(pages), line_dedup.digest(empty), packing.packed_pieces(empty), quality_rules.quality_rules(empty), licenses.license_scan(empty),
           topk.top_k(vectors, F.col("vec_id") % 50 == 0), mixing.mix(empty), mixing.mixed(empty), tokens.token_counts(empty), classifier.quality_scores(empty, labels)]
    assert [d.count() for d in got] == [0] * len(got)


def test_simhash(docs):
    fps = [brute.fingerprint(r[1]) for r in rows()]
    group, least = brute.classes(fps), defaultdict(list)
    for g, r in zip(group, rows(), strict=True):
        if r[0] is not None:
            least[g].append(r[0])
    expected = sorted((str(r[0]), f"{f:016x}", min(least[g])) for g, f, r in zip(group, fps, rows(), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()) == expected
    one = simhash.one_of_each(docs).collect()
    assert len(one) == len(set(group)) and sorted(r.doc_id for r in one) == sorted(min(x) for x in least.values())


def test_one_of_each_odd_ids(spark):
    """Components without ids keep one row; different texts of one doc_id are kept apart."""
    other = " ".join(f"w{i}" for i in range(40))
    d = [(None, BASE), (None, BASE), (7, other), (7, BASE + " and more of it all"), (8, other), (None, "x y z")]
    got = simhash.one_of_each(spark.createDataFrame(d, "doc_id long, text string")).collect()
    fps = brute.classes([brute.fingerprint(t) for _, t in d])
    assert len(got) == len(set(fps)) and (7, other) in map(tuple, got) and (None, "x y z") in map(tuple, got)


def test_simhash_anchors_cover(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(300):
        for b in rng.choice(32, i % 3, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    a, b = defaultdict(set), defaultdict(set)
    for of, v in ((a, x), (b, y)):
        for i, anchor in simhash.anchors(v):
            for k, n in zip(i.tolist(), anchor.tolist(), strict=True):
                of[k].add(n)
    assert all(a[i] & b[i] for i in range(300))


def test_simhash_crowded_anchor_in_blocks(spark):
    rng = np.random.default_rng(2)
    fp = {int(1 << 40 | sum(1 << int(b) for b in rng.choice(20, 3, replace=False))) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 60)}
    each = spark.createDataFrame([(x,) for x in fp], "fp long")
    got = {(r.node): r.root for r in components.components(simhash.links(each, block=16)).collect()}
    left, expected = set(fp), {}
    while left:
        comp, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            comp.add(x)
            near = {y for y in left if bin(x ^ y).count("1") <= 4}
            left -= near
            todo += near
        expected |= {x: min(comp) for x in comp if len(comp) > 1}
    assert got == expected


def test_components_long_chain(spark):
    r = components.components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")).collect()
    assert {x.node: x.root for x in r} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_line_dedup(docs):
    kept = brute.kept_lines([r[:2] for r in rows()])
    expected = sorted((str(r[0]), (r[1] or "").count("\n") + 1, (r[1] or "").count("\n") + 1 - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for r, k in zip(rows(), kept, strict=True))
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(docs).collect()) == expected


def test_line_dedup_with_a_full_filter(docs):
    small = line_dedup.line_dedup(docs, bits=64).select("doc_id", "text", "n_dropped")
    assert sorted(map(str, small.collect())) == sorted(map(str, line_dedup.line_dedup(docs).select("doc_id", "text", "n_dropped").collect()))


def test_packing(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = sorted((str(r[0]), p, 2048 * p, len(ids[2048 * p : 2048 * p + 2048]), zlib.crc32(np.array(ids[2048 * p : 2048 * p + 2048], "<u4").tobytes()))
                    for r in rows() for ids in [t.encode(r[1] or "", add_special_tokens=False).ids + [0]] for p in range(-(-len(ids) // 2048)))
    got = packing.packed_pieces(docs).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048


def test_packing_rounds_meet_the_bound(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 2048, 3000)
    items = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(n)], "doc_id long, length long")
    got = packing.pack(items, group=200).toPandas()
    assert len(got) == 3000 and got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * packing.lower_bound(n, 2048)


def test_bounds_never_exceed_the_best_packing():
    for lengths in ([6, 6, 6], [5, 5, 5, 5], [4, 4, 4, 3, 3, 3], [10, 1], [7, 3, 7, 3]):
        bins, _, fill = packing.best_fit(np.array(lengths), 10)
        assert packing.lower_bound(np.array(lengths), 10) <= len(fill) and fill.max() <= 10
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3


def test_quality_rules(docs):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs).collect())
    expected = []
    for r in rows():
        t, w = r[1] or "", brute.words(r[1])
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        rep = len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)})
        lines = [x for x in t.split("\n") if brute.words(x)]
        expected.append((str(r[0]), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert got == sorted(expected)


def test_quality_rules_sorting_path_equals_lookup(spark):
    import random

    random.seed(5)
    text = " ".join(random.choice("abcdefgh") for _ in range(800))
    w = text.split()
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_repeat_words == len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)})


def test_licenses(docs):
    got = {}
    for r in licenses.license_scan(docs).collect():
        got.setdefault(str(r.doc_id), r)
    r = got["12"]
    assert (r.n_base, r.base_labels, r.labels, r.score) == (5, "apache,cc-by,mit", "apache,cc-by,mit", 1.0)
    assert (r.first_word, r.last_word) == (0, 12)
    assert got["0"].first_word is None and got["0"].labels == "" and got["0"].score == 0.0


def test_licenses_against_brute_force(spark):
    rng = np.random.default_rng(12)
    phrases = list(licenses.PHRASES)
    texts = [None, "", "cc by", "Apache-License"]
    for _ in range(60):
        w = [f"w{x}" for x in rng.integers(0, 50, 40)]
        for _ in range(int(rng.integers(0, 4))):
            notice = licenses.NOTICES[int(rng.integers(0, len(licenses.NOTICES)))][1].split()
            part = notice[int(rng.integers(0, 1 + len(notice) // 3)) :] if rng.integers(0, 2) else phrases[int(rng.integers(0, 4))].split()
            part = [x for x in part if rng.random() > 0.04]
            at = int(rng.integers(0, len(w)))
            w[at:at] = part
        texts.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    expected = []
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))
        at = sorted(i for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        base = {licenses.PHRASES[p] for p in phrases if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
        more, best = set(), 0.0
        for label, words in licenses.NOTICES:
            n = words.split()
            hits = sorted((i - j, j) for i in range(len(w) - 3) for j in range(len(n) - 3) if w[i : i + 4] == n[j : j + 4])
            spans, last = [], None
            for diagonal, j in hits:
                if last is None or diagonal - last > 3:
                    spans.append(set())
                spans[-1] |= set(range(j, j + 4))
                last = diagonal
            for s in spans:
                if len(s) / len(n) >= 0.6:
                    more.add(label)
                    best = max(best, len(s) / len(n))
        expected.append((d, len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(base | more)), max(best, 0.5 if at else 0.0)))
    assert sum(e[6] != e[5] for e in expected) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, licenses.license_scan(docs).collect()), key=str) == sorted(expected, key=str)


def test_license_diagonals_merge(spark):
    notice = licenses.NOTICES[3][1].split()
    text = " ".join(["filler"] * 30 + notice[:12] + ["added", "words"] + notice[12:])
    s = licenses.notice_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("first = 30").collect()
    assert max(x.coverage for x in s) > 0.9


def test_topk(spark):
    rng = np.random.default_rng(4)
    v = [(i, [float(x) for x in rng.normal(size=6)], 0) for i in range(400)] + [(i, [0.5] * 6, 0) for i in range(400, 460)]
    v += [(500, None, 0), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (502, [float("nan")] + [0.0] * 5, 0), (503, [float("inf")] + [0.0] * 5, 0), (None, [9.0] * 6, 0), (3, v[3][1], 0), (504, [2.0, 1.0], 0)]
    e = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    usable = [(i, np.floor(256 * np.array((x + [0.0] * 6)[:6], np.float32).astype(float)).astype(int)) for i, x, _ in v if i is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    expected = []
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in usable if j != i)[:5]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    seen = {}
    for sizes in ((64, topk.DIRECTORY), (16, 10 * 8 * 8)):
        before, (topk.PAGE, topk.DIRECTORY) = (topk.PAGE, topk.DIRECTORY), sizes
        got = sorted(map(tuple, topk.top_k(e, F.col("vec_id") % 50 == 0, seen=seen).collect()))
        topk.PAGE, topk.DIRECTORY = before
        assert got == sorted(expected)
    assert seen["pages"] > 20


def test_topk_searches_few_pages_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 8)) * 20
    v = [(i, [float(x) for x in centers[i % 40] + rng.normal(size=8) * 0.1], 0) for i in range(4000)]
    page, topk.PAGE = topk.PAGE, 64
    seen = {}
    topk.top_k(spark.createDataFrame(v, "vec_id int, embedding array<double>, label int"), F.col("vec_id") % 50 == 0, seen=seen).count()
    topk.PAGE = page
    assert seen["queries"] == 80 and seen["pairs1"] + seen["pairs2"] < 0.5 * seen["queries"] * seen["pages"]


@pytest.mark.parametrize("size", [1e3, 1e5, 2e6])
def test_topk_long_vectors(spark, size):
    """Products beyond 2^53 are exact; vectors too long for products in a long take no part; ids may be ints."""
    rng = np.random.default_rng(9)
    v = [(i, [float(x) for x in np.floor(rng.normal(size=4) * size * 256) / 256], 0) for i in range(200)] + [(200, [1e300, 0.0, 0.0, 0.0], 0), (201, [3e7, 0.0, 0.0, 0.0], 0), (202, [0.0] * 4, 0)]
    usable = [(i, [int(np.floor(256 * c)) for c in x]) for i, x, _ in v if sum(np.floor(256 * c) ** 2 for c in x) <= 2**62]
    expected = []
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in usable if j != i)[:5]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    page, topk.PAGE = topk.PAGE, 32
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(v, "vec_id int, embedding array<double>, label int"), F.col("vec_id") % 50 == 0).collect()))
    topk.PAGE = page
    assert got == sorted(expected)


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        by[r.source][0] += r.size
        by[r.source][1:3] = [r.source_size, r.target]
        by[r.source][3] += r.taken
        assert r.taken <= 2 * r.size
    assert all(a == b for a, b, _, _ in by.values())
    assert sum(t for _, _, t, _ in by.values()) == pytest.approx(1.5 * sum(a for a, *_ in by.values()))
    assert all(t <= 2 * s + 1e-6 for s, _, t, _ in by.values())
    assert mixing.mixed(docs).count() == sum(r.times for r in got)
    data = [(r[0], r[1], r[3]) for r in rows() if r[0] is not None and r[0] != 4]
    taken, target = brute.mix(data)
    few = docs.where("doc_id is not null and doc_id <> 4")
    assert [r.doc_id for r in mixing.mixed(few).collect()] == [i for _, i in sorted(taken)]
    assert {r.source: r.target for r in mixing.mix(few).collect()} == pytest.approx(target)


def test_token_counts(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a  b", "a \nb\n\nc", " x ", "it's 12.5%, ok... (see) x\x00y", "foo.\nBar baz", "<|endoftext|> a<|endoftext|>b"]
    both = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(900 + i, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    expected = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in [(r[0], r[1]) for r in rows()] + [(900 + i, x) for i, x in enumerate(odd)])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.token_counts(both).collect()) == expected


def test_classifier(spark):
    import random

    random.seed(6)
    good, bad = "calm river stone garden light".split(), "buy!! win!! $$$ click@@ now##".split()
    d = [(i, " ".join(random.choice(good if i % 2 else bad) for _ in range(40)), "en") for i in range(400)] + [(None, None, "en"), (1000, "", "en")]
    docs = spark.createDataFrame(d, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(5000, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(d) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)
    text = {i: t for i, t, _ in d}
    weights = brute.ftrl([(brute.features(text[i], 18), i % 2) for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1])
    assert [r.score for r in got] == pytest.approx([brute.score(text[r.doc_id], weights) for r in got], abs=1e-5)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)


def test_html_text(spark):
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav>Menu one</nav><div class='ad'>Buy this</div><article><h1>Head &amp; line</h1>"
            "<p>First <b>bold<br>two&nbsp;three<p>Last &lt;x&gt;<aside>Side</aside><div id='comments'><p>Nice</p></div></article><footer>&copy; us</footer>")
    shared = "Home News Sport Weather Contact About us here"
    plain = [(10 + i, "http://b.example/x", f"<body><div>{shared}</div><div>Only{i} this{i} page{i} has{i} these{i} words{i} here</div></body>") for i in range(4)]
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "odd", ""), *plain]
    got = {r.page_id: r for r in html_text.html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line First bold two three Last <x>"
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert all(got[10 + i].text == f"Only{i} this{i} page{i} has{i} these{i} words{i} here" for i in range(4))


def test_html_structure_keeps_articles():
    """Wrappers named after what they have beside the text, teasers, self-closed elements and attributes that only look like hidden cost no text."""
    kept = lambda page: " ".join(t for r, t in html_text.blocks(page) if r != "c")
    for name in ("content with-sidebar", "has-sidebar", "main-widget", "no-banner"):
        assert kept(f"<body><div class='{name}'><p>The story</p></div></body>") == "The story"
    for name in ("sidebar", "site-footer", "x cookie-banner", "related_posts", "widget-area"):
        assert kept(f"<article><p>The story</p><div class='{name}'>Other</div></article>") == "The story"
    story = "one two three four five six seven eight nine ten " * 2
    assert kept(f"<div>{story}</div><article>Teaser card</article>") == f"{story}Teaser card"
    assert kept(f"<div>Other here</div><article>{story}</article>") == story.strip()
    assert kept("<article>One <svg class='a'/> two <iframe/> three <svg><text>no</text></svg> four</article>") == "One two three four"
    assert kept("<article>One <iframe src=/a/>no</iframe> two <iframe srcdoc='<br/>no'>no</iframe> three</article>") == "One two three"
    assert kept("<article><p data-hidden='false'>One</p><p title='hidden gem'>two</p><p hidden>no</p><p aria-hidden='true'>no</p></article>") == "One two"


def test_runs_repeat_by_the_whole_host(spark):
    """A large host loses what its pages repeat however the hash deals them: the same as with one shard; and runs on few of very many pages count."""
    shared, rare = "Home News Sport Weather Contact About us here", "Call our hotline every day from nine to five"
    page = lambda i: f"<body><div>{shared if i % 4 == 0 else ''}</div><div>{rare if i == 5 else ''}</div><div>Only{i} this{i} page{i} has{i} these{i} words{i} here</div></body>"
    small = spark.createDataFrame([(i, "http://b.example/x", page(i)) for i in range(12)], "page_id long, url string, html string")
    text = lambda df, **k: {r.page_id: r.text for r in html_text.html_text(df, **k).collect()}
    assert text(small, shard=2) == text(small) and not any("Home" in t for t in text(small, shard=2).values())
    hotline = lambda i: f"<body><div>{rare if i % 100 == 7 else ''}</div><div>Only{i} this{i} page{i} has{i} these{i} words{i} here</div></body>"
    big = spark.createDataFrame([(i, "http://c.example/x", hotline(i)) for i in range(1200)] + [(5000, "http://d.example/", page(5))], "page_id long, url string, html string")
    got = text(big)
    assert len(got) == 1201 and got[7] == "Only7 this7 page7 has7 these7 words7 here" and got[5000].startswith("Call our hotline")
    assert not any("hotline" in t for i, t in got.items() if i < 5000)


def long_repeats(pages, run, least):
    """Places of all words that lie in some substring of run words or more, of any length, that stands on enough pages."""
    on = defaultdict(set)
    for i, p in enumerate(pages):
        for a in range(len(p)):
            for b in range(a + run, len(p) + 1):
                on[tuple(p[a:b])].add(i)
    out = [[False] * len(p) for p in pages]
    for i, p in enumerate(pages):
        for a in range(len(p)):
            for b in range(a + run, len(p) + 1):
                if len(on[tuple(p[a:b])]) >= least:
                    out[i][a:b] = [True] * (b - a)
    return out


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 3, 200)
    order, lcp = html_text.suffix_array(words, 8)
    key = [words[i : i + 8].tolist() for i in range(200)]
    assert [key[i] for i in order] == sorted(key)
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [common(key[order[i - 1]], key[order[i]]) for i in range(1, 200)]


def test_runs_cover_all_long_repeats():
    rng = np.random.default_rng(7)
    pages = [rng.integers(0, 3, 30).tolist() for _ in range(5)]
    words, page, _, _ = html_text.stream([[" ".join(map(str, p))] for p in pages], [1] * 5)
    for run, least in ((5, 2), (6, 2), (5, 3)):
        of, _, n = html_text.runs(words, page, run)
        got = html_text.covered((n[of] >= least) & (words < 3), run)
        assert [x for i in range(5) for x in got[page == i][:30].tolist()] == [x for p in long_repeats(pages, run, least) for x in p]


def test_html_text_query_against_brute_force(spark):
    """Hosts of pages made of menus, notices and stories, with and without an article element; whole html_text() in one shard, in many shards, and without a broadcast."""
    rng = np.random.default_rng(11)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    parts = {h: [word(9), word(5), word(12), word(7)] for h in range(3)}
    rows, blocks = [], []
    for i in range(90):
        h = i % 3
        tops = [str(x) for x in rng.choice(parts[h], rng.integers(0, 3), replace=False)]
        story, end = [word(int(n)) for n in rng.integers(4, 30, 3)], [parts[h][0]] if i % 2 else []
        art = i % 5 < 2 or h == 2
        if h == 2 and i % 4:
            story.insert(1, "this line stands inside of very many stories here")
        rows.append((i, f"https://h{h}.example/{i}", "".join(f"<div>{t}</div>" for t in tops) + ("<article>" if art else "") + "".join(f"<p>{t}</p>" for t in story) + ("</article>" if art else "") + "".join(f"<nav>{t}</nav>" for t in end)))
        blocks.append([("c" if art else "p", t) for t in tops] + [("m" if art else "p", t) for t in story] + [("c", t) for t in end])
    rows += [rows[4], rows[4], rows[4]]
    blocks += [blocks[4]] * 3
    expected, boilers = [], 0
    for h in range(3):
        mine = [i for i in range(len(rows)) if rows[i][0] % 3 == h]
        distinct = {str(blocks[i]): i for i in mine}
        seen = sorted(distinct.values())
        side = {i: [w for r, t in blocks[i] if r != "m" for w in t.split()] for i in mine}
        gone = dict(zip(seen, long_repeats([side[i] for i in seen], 6, min(10, max(3, 0.02 * len(seen)))), strict=True))
        mains = {i: [t for r, t in blocks[i] if r == "m"] for i in mine}
        around = defaultdict(list)
        for i in seen:
            for t in set(mains[i]):
                k = mains[i].index(t)
                around[t].append((mains[i][k - 1] if k else None, mains[i][k + 1] if k + 1 < len(mains[i]) else None))
        most = max(10, len(seen) / 2)
        boiler = {t for t, x in around.items() if len(t.split()) >= 6 and len(x) >= most and min(len({a for a, _ in x}), len({b for _, b in x})) >= most / 2}
        boilers += len(boiler)
        for i in mine:
            marks, at, kept = gone[distinct[str(blocks[i])]], 0, []
            for r, t in blocks[i]:
                ws = t.split()
                if r == "m":
                    kept += [] if t in boiler else [t]
                    continue
                stay = [w for w, g in zip(ws, marks[at : at + len(ws)], strict=True) if not g]
                at += len(ws)
                if r == "p" and stay:
                    kept.append(" ".join(stay))
            kept = kept or [t for r, t in blocks[i] if r == "p"]
            expected.append((rows[i][0], rows[i][1], " ".join(kept), len(" ".join(kept))))
    assert boilers == 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for options in ({}, {"shard": 300}, {"shard": 300, "group": 900, "broadcast_runs": 0}):
        got = html_text.html_text(df, **options)
        assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(expected), options
        assert got.agg(F.sum("n_run_blocks")).first()[0] > 50


