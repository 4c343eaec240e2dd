"""Hand-made cases of chunking, sentences, vectors, intake, rewriting, answers, retrieval, evaluation and stateful streams."""

import re

import pytest
from pyspark.sql import functions as F

from corpusq.functions import structure as S
from corpusq.operators import answers, chunking, dense, evaluation, intake, lifecycle, retrieval, rewrite, vectors
from corpusq.sources import files
from corpusq.streaming import alerts, stateful


def test_heading_kinds(spark):
    lines = ["## Two ##", "2.1 Scope", "2.1 Ends here.", "PILOT PLAN", "lower case", "#", "# " + "x" * 130]
    got = [r.h for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").orderBy("i").select(S.heading_of_line(F.col("t")).alias("h")).collect()]
    assert [(h.level, h.text) if h else None for h in got] == [(2, "Two"), (2, "Scope"), None, (1, "PILOT PLAN"), None, None, None]


def test_headings_offsets_underlines_and_repeats(spark):
    text = "# A\nbody\nTitle\n--\n# B\n# B\nend"
    rows = S.headings(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line").collect()
    assert [(r.level, r.heading) for r in rows] == [(1, "A"), (2, "Title"), (1, "B")]
    assert all(text[r.char_start :].lstrip("# ").startswith(r.heading) for r in rows)


def test_section_path_and_breadcrumb(spark):
    d = spark.createDataFrame([(1, "# A\n## B\nx\n# C\ny")], "doc_id long, text string")
    places = spark.createDataFrame([(1, 9), (1, 15)], "doc_id long, char_start int")
    got = {r.char_start: r for r in S.section_paths(places, S.headings(d)).withColumn("b", S.breadcrumb(F.lit("T"), F.col("section_path"))).collect()}
    assert got[9].section_path == ["A", "B"] and got[15].section_path == ["C"] and got[9].b == "T > A > B"


def brute_chunks(text, target, overlap, least):
    """Paragraph windows by the rule, in plain Python."""
    n = lambda t: len(re.findall(r"\s+", t))
    units, at = [], 0
    for part in re.split(r"(\n[ \t]*\n)", text):
        s = part.strip()
        if s:
            b = at + part.index(s)
            units.append((b, b + len(s)))
        at += len(part)
    done, cur = [], None
    for b, e in units:
        t = n(text[b:e])
        if cur is None:
            cur = [b, e, t]
        elif t > target:
            done += [cur[:2], [b, e]]
            cur = None
        elif cur[2] + t > target:
            done.append(cur[:2])
            back = max(cur[0], cur[1] - int((cur[1] - cur[0]) * (overlap / target)))
            cur = [back, e, n(text[back : cur[1]]) + t]
        else:
            cur = [cur[0], e, cur[2] + t]
    done += [cur[:2]] if cur else []
    return [(b, e) for b, e in done if n(text[b:e]) >= least]


def test_chunks_follow_the_rule(spark):
    para = lambda k: " ".join(f"w{i}" for i in range(k))
    texts = ["\n\n".join(para(k) for k in ks) for ks in ([5, 5, 5, 5, 5], [30, 3, 4], [4, 30, 4, 9], [1], [12, 12, 2, 2, 2, 40])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("filename", F.lit("a_b.md"))
    got = chunking.chunk_documents(d, "paragraph", 12, 4, 2).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.chunk_index)
        assert [(r.char_start, r.char_end) for r in mine] == brute_chunks(t, 12, 4, 2)
        assert all(t[r.char_start : r.char_end] == r.text for r in mine) and [r.chunk_index for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three", ["One.", "Two!", "Three"]),
        ("See e.g. This costs 3.5 now. J. Smith agrees.", ["See e.g. This costs 3.5 now.", "J. Smith agrees."]),
        ("Thirty days. [1] Next.[2][3] End", ["Thirty days. [1]", "Next.[2][3]", "End"]),
        ('He said "stop." Then left. Item no. 5 too.', ['He said "stop."', "Then left.", "Item no. 5 too."]),
        ("a list\n\nmore. lower goes on", ["a list", "more. lower goes on"]),
        ("Wait... What", ["Wait...", "What"]),
        ("", []),
    ],
)
def test_sentences(text, want):
    whole, rest = chunking.split_sentences(text)
    assert whole + ([rest] if rest else []) == want


def test_hash_embedding_matches_hashlib(spark):
    import hashlib

    texts = ["Alpha beta beta", "", "!!", "ünï code"]
    got = {r.k: r.vector for r in vectors.hash_embedding(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k", 16).collect()}
    for i, t in enumerate(texts):
        v = [0.0] * 16
        for w in re.findall(r"[^\W_]+", t.lower()):
            h = hashlib.sha256(w.encode()).digest()
            for o in (0, 8):
                v[int.from_bytes(h[o : o + 4], "big") % 16] += -1 if h[o + 4] % 2 else 1
        size = sum(x * x for x in v) ** 0.5
        assert got[i] == pytest.approx([x / size for x in v] if size else [1.0] + [0.0] * 15)


def test_approximate_search_finds_most(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    q, c = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.where("vec_id % 50 <> 0").withColumnRenamed("vec_id", "chunk_id")
    key = ["query_id", "chunk_id"]
    exact, near = ({tuple(r) for r in x.select(key).collect()} for x in (dense.cosine_top(q, c, 5), dense.approximate_top(q, c, 5)))
    assert len(exact & near) >= 0.9 * len(exact)


def test_exact_search_of_many_queries(spark, monkeypatch):
    """More queries than one block holds give the same rows."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector")).where("vec_id < 60")
    q, c = e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "chunk_id")
    expected = sorted(map(tuple, dense.cosine_top(q, c, 3).collect()))
    for name, value in (("QUERIES", 7), ("ROWS", 9), ("TASKS", 3)):
        monkeypatch.setattr(dense, name, value)
    assert sorted(map(tuple, dense.cosine_top(q, c, 3).collect())) == expected and len(expected) == 3 * q.count()


def test_approximate_search_meets_other_query_rows(spark, tmp_path):
    from corpusq import queries_text

    rows = [(i, [1.0 + i % 50, 2.0, 3.0 * (i % 7)], 0) for i in range(51)]
    rows[50] = (50, rows[0][1], 0)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.chunk_id): r["rank"] for r in queries_text.vec3_approximate(spark, str(tmp_path)).collect()}
    assert got[0, 50] == got[50, 0] == 1 and (0, 0) not in got and (50, 50) not in got


def test_extracted_texts_are_composed(spark):
    rows = [(1, "a.md", "Cafe\u0301 U\u0308ber"), (2, "b.md", "plain"), (3, "c.md", None)]
    got = {r.doc_id: r.text for r in intake.extracted(spark.createDataFrame(rows, "doc_id long, filename string, text string")).collect()}
    assert got == {1: "Caf\u00e9 \u00dcber", 2: "plain", 3: None}


def test_uploads_and_clients(spark):
    rows = [("../a\\b.PDF", 5), ("...", 5), ("x.exe", 5), ("y.md", 0), ("z.txt", 26 * 1024 * 1024), (None, 1)]
    got = intake.admit_uploads(spark.createDataFrame([(1, *r) for r in rows], "batch_id int, raw_name string, size long")).collect()
    assert [(r.filename, r.error) for r in got] == [("_a_b.PDF", None), ("document", "unsupported"), ("x.exe", "unsupported"), ("y.md", "empty"), ("z.txt", "too large"), ("document", "unsupported")]
    c = spark.createDataFrame([("u", "1.1.1.1", "h"), (None, " 1.1.1.1 , 2.2.2.2", "h"), (None, None, "h")], "u string, f string, h string").select(intake.client(F.col("u"), F.col("f"), F.col("h")).alias("c")).collect()
    assert [r.c for r in c] == ["user:u", "ip:1.1.1.1", "ip:h"]


def test_html_text(spark):
    p = spark.createDataFrame([(1, "<nav>no</nav><p>a &amp; b</p><script>x</script><p>c</p>"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in intake.html_text(p).collect()} == {1: "a & b\nc", 2: ""}


def test_rewrites(spark):
    rows = [(1, 0, "user", "What is the refund policy?"), (1, 1, "user", "yes"), (1, 2, "user", "What about shipping?"), (2, 0, "user", "Tell me about travel costs."), (2, 1, "user", "Is it taxed?"), (3, 0, "user", "vpn access")]
    t = rewrite.with_antecedent(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    q = t.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"), "antecedent")
    g = spark.createDataFrame([("vpn", 1, "tunnel"), ("vpn", 2, "access"), ("vpn", 3, "remote")], "term string, position int, synonym string")
    got = {r.query_id: (r.query, r.stage) for r in rewrite.rewritten(q, g).collect()}
    assert got["1-2"] == ("refund policy shipping", "anaphora") and got["2-1"] == ("travel costs is taxed?", "anaphora")
    assert got["3-0"] == ("vpn access tunnel remote", "expansion") and got["1-0"][1] == "none"


def test_answers_hold_until_cited(spark):
    rows = [(1, 0, "Intro."), (1, 1, "Fact [1] [9]."), (1, 2, "More."), (2, 0, "Nothing [7].")]
    v = answers.validated(spark.createDataFrame([(*r, 3) for r in rows], "query_id int, sent_idx int, sentence string, passages int"))
    got = {r.query_id: r for r in answers.assembled(v).collect()}
    assert got[1].answer == "Intro. Fact [1]. More." and got[1].stripped == 1
    assert got[2].abstained and got[2].answer == answers.REFUSALS["ungrounded_answer"]


def test_extractive_answer(spark):
    q = spark.createDataFrame([(1, "refund window"), (2, "what about that")], "query_id int, query string")
    p = spark.createDataFrame([(1, 1, "Hello. The refund window is short."), (1, 2, "No match."), (2, 1, "that")], "query_id int, index int, text string")
    assert [(r.query_id, r.answer) for r in answers.extractive(q, p).collect()] == [(1, "The refund window is short. [1]")]


def test_retrieve_gates_and_counts(spark):
    c = spark.createDataFrame([(1, "refund window thirty days", 3, [1.0, 0.0]), (2, "holiday calendar", 1, [0.0, 1.0])], "chunk_id long, text string, token_count int, vector array<double>")
    q = spark.createDataFrame([(1, "refund window", [1.0, 0.0]), (2, "zzz", [0.0, 0.0])], "query_id long, query string, vector array<double>")
    final, per = retrieval.retrieve(q, c, retrieval.Config(threshold=0.3))
    assert [(r.query_id, r.chunk_id) for r in final.where("rank = 1").collect()] == [(1, 1)]
    assert {r.query_id: r.abstained for r in per.collect()} == {1: False, 2: True}


def test_nearest_rank(spark):
    v = spark.createDataFrame([("a", x) for x in range(1, 11)], "k string, v int")
    assert evaluation.nearest_rank(v, ["k"], "v", 0.95).first().value == 10 and evaluation.nearest_rank(v, ["k"], "v", 0.5).first().value == 6


def test_admin_actions(spark):
    r = spark.createDataFrame([(1, "live"), (2, "failed"), (3, "live")], "doc_id long, state string")
    a = spark.createDataFrame([(1, 1, "disable", None), (1, 2, "enable", None), (1, 3, "supersede", 9), (1, 4, "enable", None), (2, 1, "disable", None)], "doc_id long, seq int, action string, successor long")
    assert {x.doc_id: (x.state, x.successor) for x in lifecycle.after_actions(r, a).collect()} == {1: ("superseded", 9), 2: ("failed", None), 3: ("live", None)}


def test_rate_limit_windows_start_at_first_request(spark):
    rows = [(i, "a", s) for i, s in enumerate([10, 20, 30, 69, 70, 75, 200])]
    d = spark.createDataFrame(rows, "request_id long, client string, s int").withColumn("created_at", F.timestamp_seconds("s"))
    got = {r.request_id: (r.allowed, r.retry_after) for r in stateful.rate_limit(d, 2, 60).collect()}
    assert got == {0: (True, 0.0), 1: (True, 0.0), 2: (False, 40.0), 3: (False, 1.0), 4: (True, 0.0), 5: (True, 0.0), 6: (True, 0.0)}


def test_held_alerts(spark):
    w = spark.createDataFrame([(0,), (300,), (600,), (1500,)], "s int").select(F.timestamp_seconds("s").alias("bucket"))
    assert [r.s for r in alerts.held(w, "5 minutes", 3).select(F.unix_seconds("bucket").alias("s")).collect()] == [600]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_bytes(b"ok \xff")
    (tmp_path / "in" / "b.exe").write_bytes(b"x")
    (tmp_path / "in" / "h.jsonl").write_text('{"q": "a"}\n\n{"q": "b"}\n{"q": ')
    assert [r.filename for r in files.corpus(spark, str(tmp_path / "in")).collect()] == ["a.md"]
    assert files.plain_texts(spark, str(tmp_path / "in")).first().text == "ok �"
    assert sorted(r.q for r in files.json_rows(spark, str(tmp_path / "in" / "h.jsonl"), "q string").collect()) == ["a", "b"]
    c = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string")
    out = str(tmp_path / "chunks")
    files.replace_chunks(c, out, 4)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 1
    files.replace_chunks(c.where(bucket).withColumn("text", F.lit("new")), out, 4)
    kept = spark.read.parquet(out)
    assert kept.count() == 20 and kept.where("text = 'new'").count() == c.where(bucket).count()
    files.append_snapshot(c.limit(1), str(tmp_path / "snap"))
    files.append_snapshot(c.limit(1), str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 2
    files.dump_scores(c.limit(1), str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).first().value == '{"doc_id":0,"text":"t0"}'
