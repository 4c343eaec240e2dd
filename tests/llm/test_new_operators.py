"""Personal data, collocations and hard negatives against brute force; rows told apart; broken markup."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import collocations, hard_negatives, html_text, mixing, pii, simhash
from corpusq.llm.common import row_hash

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if ok(k, m.group())]


PII_TEXTS = [
    None, "", " ", "no data here", "write to a.b+c@mail.example.com.", "a@b.c@d.e x@y@z.org @a.b a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111", "call +1 (212) 555-0123. or +12 or +1234567890123456 or ++49 30 1234567)", "é日本@x.yz é a@é.com İ joe@x.org",
    "IBAN: DE89 3704 0044 0532 0130 00 und so", "SSN 123-45-6789 and ssn 000-12-3456", "Account number: 12345-678 ok; passport no. AB1234567", "ftp://joe:pw@host.org/x. see https://example.com/ or https://x.org/~joe mailto:a@b.org",
    "word " * 300_000 + "last@mail.org", "1" * 2000, "a@" * 2000, "1 " * 2000, "1.2.3.4." * 2000,
]


def test_pii_against_patterns(spark):
    rng = random.Random(1)
    texts = PII_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for alphabet in ("a.@-1 ", "0123456789. -+()", "é@a.b+1 2()-") for _ in range(3000)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, PII_TEXTS[4], None, None), (4, PII_TEXTS[4], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, pii int")
    got = defaultdict(list)
    for r in pii.digest(docs).collect():
        got[r.doc_id].append(r)
    for i, t, _, _ in rows:
        want = base_spans(t)
        r = got[i][0]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in want) for k in PATTERNS], t
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), t
        assert [x for x in r.spans.split(",") if x.split(":")[0] in PATTERNS] == [f"{k}:{s}:{e}" for k, s, e in want]
    assert len(got[4]) == 2 and len(got[None]) == 1 and pii.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["1", "a@", "1 ", "1.", "+1(", "a.b@c.d ", "iban ", "http://a@"])
def test_pii_of_very_long_texts(unit):
    """Linear where the patterns are quadratic; as many spans as units where each is one."""
    began = time.time()
    found = pii.spans(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 10 and len(found) == {"a.b@c.d ": 125_000}.get(unit, len(found))


def test_pii_added_kinds_and_redaction(spark):
    text = "IBAN: DE89 3704 0044 0532 0130 00 und, IBAN DE88 3704 0044 0532 0130 00; SSN 123-45-6789, ssn 000-12-3456. Account number: 12345-678 ok, https://joe:pw@host.org/x. https://example.com/a mailto:a@b.org, librairie iban no"
    found = [(k, text[s:e]) for k, s, e in pii.spans(text) if k not in PATTERNS]
    assert found == [("url", "https://joe:pw@host.org/x"), ("url", "mailto:a@b.org"), ("iban", "DE89 3704 0044 0532 0130 00"), ("national_id", "123-45-6789"), ("account", "12345-678")]
    docs = spark.createDataFrame([(1, "to a@b.org, +1 (212) 555-0123", "k"), (2, None, None)], "doc_id long, text string, pii string")
    assert [tuple(r) for r in pii.redacted(docs).orderBy("doc_id").collect()] == [(1, "to <email>, <phone>", "k"), (2, None, None)]


def plain_collocations(rows, least, longest, top):
    n, f = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    often = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = defaultdict(list)
    for (lang, w), a in often.items():
        if any(g == lang and len(b) > len(w) and v >= a and inside(w, b) for (g, b), v in often.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((score, a, " ".join(w), left, right))
    return sorted((lang, i + 1, p, a, x, y, n[lang], s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v, key=lambda r: (-r[0], -r[1], r[2].encode()))[:top]))


@pytest.mark.parametrize("entries", [collocations.ENTRIES, 40])
def test_collocations(spark, entries, monkeypatch):
    rng = random.Random(4)
    words = ["the", "The", "of", "a", "é", "日本", "x" * 300, "w1", "w2", " ", "b\tc"]
    texts = [" ".join(rng.choice(words[: rng.randint(2, 11)]) + rng.choice(["", "", "", ".", ",", "\n", "!?"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = [(rng.choice(["en", "fr", None, "und"]), t) for t in texts] + [("en", None), (None, ""), ("de", "of the " * 20_000), ("de", "z" * 200_000 + " of the"), ("es", "a b c d e " * 6)] + [("en", "A b c d e f g")] * 6
    docs = spark.createDataFrame([(i, g, t, "x", 0) for i, (g, t) in enumerate(rows)], "n long, lang string, text string, phrase string, words int").repartition(3)
    for least, top in ((5, 2000), (12, 7)):
        got = sorted(map(tuple, collocations.collocations(docs, least=least, top=top, entries=entries).collect()))
        assert got == plain_collocations(rows, least, 5, top)
    assert collocations.collocations(docs.limit(0)).count() == 0 and collocations.collocations(docs, least=10**6).count() == 0


def test_hat_trie_bursts_and_counts():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 9, 20_000) for _ in range(4)]
    trie = collocations.HatTrie(4, burst=16)
    for lo in range(0, 20_000, 3000):
        trie.add(*collocations.distinct([c[lo : lo + 3000] for c in ids]))
    assert any(type(x) is trie.Node for x in trie.root.values())
    want = Counter(zip(*[c.tolist() for c in ids], strict=True))
    assert trie.entries == len(want)
    got = {(w, *[key >> s & (1 << 21) - 1 for s in (42, 21, 0)]): c for w, leaf in trie.spill(0) for key, c in leaf.items()}
    assert got == want and trie.entries == 0


def test_forgotten_vocabulary_loses_nothing(monkeypatch):
    monkeypatch.setattr(collocations, "VOCABULARY", 30)
    monkeypatch.setattr(collocations, "SLICE", 50)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(200)).encode() for _ in range(5)]
    for lengths in ((2,), (3,), (4, 5)):
        counter, found = collocations.PhraseCounter(lengths, 7, None, None, entries=100), []
        for rows in (counter.add(b"en", texts[:3]), counter.add(b"en", texts[3:]), counter.end()):
            found += rows
        for n in lengths:
            check_runs(texts, n, [(part, collocations.unpacked_run(body, n)) for m, part, body in found if m == n])


def check_runs(texts, n, runs):
    assert all((collocations.partition_of(list(r[:-1]), 7) == part).all() for part, r in runs)
    got = collocations.summed(np.concatenate([r for _, r in runs], axis=1))
    digest, seed = collocations.xxhash.xxh64_intdigest, collocations.seed_of(b"en", "0")
    want = Counter(tuple(digest(x, seed) for x in w[i : i + n]) for t in texts for w in [t.split()] for i in range(len(w) - n + 1))
    assert {tuple(c[:-1].tolist()): int(c[-1]) for c in got.T} == want


def test_word_hashes_are_those_of_the_tables(spark):
    rows = [("en", "a"), ("fr", "日本"), ("", "x" * 100)]
    got = spark.createDataFrame(rows, "lang string, word string").select(collocations.word_hash("lang", "word", "3").alias("h")).collect()
    assert [r.h % (1 << 64) for r in got] == [collocations.xxhash.xxh64_intdigest(w.encode(), collocations.seed_of(g.encode(), "3")) for g, w in rows]


def test_phrases_of_one_key_stay_apart(monkeypatch):
    monkeypatch.setattr(collocations, "fold", lambda columns: np.zeros(len(columns[0]), np.uint64))
    columns = np.array([[1, 2, 1, 2, 1], [5, 5, 5, 6, 5], [1, 1, 1, 1, 1]], np.uint64)
    assert sorted(map(tuple, collocations.summed(columns).T.tolist())) == [(1, 5, 3), (2, 5, 1), (2, 6, 1)]


def plain_negatives(rows, positives=5, negatives=5):
    use = [(i, label, [int(np.floor(256 * float(c))) for c in v]) for i, v, label in rows if None not in (i, v, label) and v and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, x in use:
        if i % 100:
            continue
        others = sorted(((-dot(x, y), j, g == label) for j, g, y in use if j != i))
        for p, pid, _ in [o for o in others if o[2]][:positives]:
            near = [(j, -s) for s, j, same in others if not same and 80 * -p <= 100 * -s <= 100 * -p][:negatives]
            out += [(i, pid, r + 1, j, -p, s) for r, (j, s) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("width", "block", "anchors"), [(3, 7, 2), (64, 2048, 4096), (9, 16, 3)])
def test_hard_negatives(spark, width, block, anchors):
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(c) for c in np.float32(rng.normal(size=width))], int(rng.integers(0, 3)) if i % 3 else 0) for i in range(0, 1500, 5)]
    rows += [(100, rows[3][1], 0), (7, rows[20][1], 1), (7, rows[20][1], 1), (8, rows[20][1], 2)]  # repeated rows and ties
    rows += [(None, rows[0][1], 1), (901, None, 1), (902, rows[0][1], None), (903, [1.0, None], 1), (904, [float("nan")] * 2, 1), (905, [float("inf")], 1), (906, [], 1), (1100, [0.5], 2), (1101, [1e4, -1e4], 2), (1102, [-3e-9] * 2, 2)]
    v = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, score int").repartition(4)
    got = hard_negatives.hard_negatives(v, F.col("vec_id") % 100 == 0, block=block, anchors=anchors).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = sorted(map(tuple, got.collect()))
    assert got == plain_negatives(rows) and len(got) > 10
    assert hard_negatives.hard_negatives(v.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_subset_sums_equal_products():
    rng = np.random.default_rng(0)
    for width, most in ((1, 5), (8, 300), (65, 1 << 40)):
        x, a = rng.integers(-most, most, (50, width)), rng.integers(-100, 100, width)
        bits = hard_negatives.bits_of(x)
        c = hard_negatives.Candidates({"ids": np.arange(50).tobytes(), "labels": np.zeros(50, np.int64).tobytes(), "bits": bits, "planes": hard_negatives.planes(x, bits).tobytes()})
        assert (c.scores(hard_negatives._fit(a, c.places.shape[1]), 3, 41) == (x @ a)[3:41]).all()


VALUES = "select 1L as doc_id, '{t}' as text, 's' as source, array({a}) as tags, map({m}) as facts, named_struct('p', {p}, 'q', array(named_struct('r', {r}))) as s, parse_json('{j}') as v"
SAME = {"t": "a text of some words that stays", "a": "'x'", "m": "'k', array('x')", "p": "1", "r": "'y'", "j": '{"a": 1}'}
DIFFERENT = [{"a": "'x', null"}, {"a": "null, 'x'"}, {"m": "'k', array('x', null)"}, {"m": "'k', cast(null as array<string>)"}, {"m": "'k2', array('x')"}, {"p": "null"}, {"r": "cast(null as string)"}, {"j": '{"a": 2}'}, {"j": '{"a": null}'}]


def test_rows_that_differ_inside_nested_values(spark):
    rows = [spark.sql(VALUES.format(**(SAME | d))) for d in [{}, {}, *DIFFERENT]]
    d = rows[0]
    for r in rows[1:]:
        d = d.union(r)
    hashes = [tuple(r) for r in d.select(*row_hash(d)).collect()]
    assert len(set(hashes)) == len(rows) - 1
    turned = spark.sql("select map('a', 1, 'b', cast(null as int)) as m union all select map('b', cast(null as int), 'a', 1)")
    assert len({tuple(r) for r in turned.select(*row_hash(turned)).collect()}) == 1
    # mixed() gives each row its own values, one_of_each() the same row whatever the order.
    plain = lambda df: sorted(df.selectExpr("to_json(struct(tags, facts, s)) || to_json(v) as x").toPandas()["x"])
    of = {tuple(h): x for *h, x in d.select(*row_hash(d), F.expr("to_json(struct(tags, facts, s)) || to_json(v) as x")).collect()}
    want = Counter()
    for r in mixing.mix(d).collect():
        want[of[r.row1, r.row2]] += r.times
    assert Counter(plain(mixing.mixed(d))) == +want and len(of) == len(rows) - 1
    kept = {tuple(plain(simhash.one_of_each(x))) for x in (d, d.repartition(5), d.orderBy(F.rand(3)))}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(?P<raw>script|style|noscript|template|svg|iframe|object|canvas|textarea|select|title)(?=[\s/>])"
    r"(?:(?:\s*+[^\s\"'<>=/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*+\s*+/>|[^>]*>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)


def test_scanner_equals_pattern():
    rng = random.Random(3)
    parts = ["<a", " b='", "' ", '"', "'", ">", "/>", "=", "<script", "<title", "</script>", "</TITLE >", " ", "x", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", "/", "<", "<p>", "\n", "&amp;", "<select"]
    for _ in range(30_000):
        p = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert list(html_text.Scanner(p)) == [(m.start(), m.end(), m["end"] or "", m["tag"] or "", m["attrs"] or "") for m in _TOKEN.finditer(p)], p


@pytest.mark.parametrize("unit", ["<a ", "<a b='", "<![CDATA[", "<script a='", "<script a=<script ", "<script a='b=\"c='x></script>", "</", "<!--", "<title ", "&#", "<p class='x\"' "])
def test_broken_markup_takes_linear_time(unit):
    began = time.time()
    html_text.blocks(unit * (5_000_000 // len(unit)))
    assert time.time() - began < 15
