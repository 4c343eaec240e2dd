"""STR9 against its SQL where pages are copies of others, come again as copies, have no chunks or several windows."""

import duckdb

from corpusq.catalog import QUERIES, SQL


def test_copies_and_pages_without_chunks(spark, tmp_path):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    page = lambda body: f"<!DOCTYPE html><html><head><title>T</title><script>var t = '</p>';</script></head><nav>menu</nav><!-- ad --><article><h1>Of &amp; on</h1><p>{body}</p></article><footer>end</footer></html>"
    a, b, long = page(words("a", 20)), page("<b>" + words("b", 20) + "<br>&quot;so&quot;"), "\n".join(words(f"w{i}x", 30) for i in range(12))
    # 20 and 40 are copies that come again, 3 an odd copy; 9 is a copy in its own batch; 10 and 11 differ in their last window only; 12 and 60 are too short, 14 has a type that is not taken.
    pages = {2: a, 20: a, 40: a, 3: a, 5: b, 9: b, 8: page(long), 10: page(long + " last"), 11: page(long + " other"), 13: page(long), 12: page("short"), 60: page("short"), 14: a, 4: page(words("d", 20)), 80: page(words("e", 20)), 15: None}
    spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in pages.items()], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    rows = lambda rs: sorted(map(tuple, rs), key=lambda r: r[0])
    got = rows(QUERIES["str9_ingest_stream"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == rows(con.execute(SQL["str9_ingest_stream"]).fetchall())
    state = {r[0]: (r[1], r[4]) for r in got}
    assert state[3] == ("duplicate", "duplicate of 2; not indexed") and state[20] == ("live", None) and state[40] == ("duplicate", "duplicate of 20; not indexed")
    assert state[9][0] == state[13][0] == "duplicate" and state[60] == ("failed", "no chunks") and state[80] == ("live", "already indexed")
