"""Cleaning and stripping of very long lines and odd white space, against the plain rules."""

import re

import pytest
from pyspark.sql import functions as F

from corpusq.functions import structure
from corpusq.functions import text as T


def plain(raw):
    t = raw.replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ").replace("​", "")
    t = re.sub(r"[ \t]+$", "", t, flags=re.M)
    kept = []
    for line in t.split("\n"):
        s = line.strip()
        if not s:
            kept.append("")
        elif not (re.match(r"^\s*(?:page\s+)?\d+\s*(?:of\s+\d+)?\s*$", s, re.I) or re.match(r"^\s*(?:[-*_=]\s*){3,}$", s)):
            kept.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


TEXTS = [
    "a\n\f\nb\n \nc", "x\n- - -\ny\n--\nz\n***\n_ = -\n", "Page 3 of 10\ntext\n 12 \npage 4\n3 of\n12 x\n", "\x1c a \x1f\n\n\n\n b 　", "  lead\n\n\n\ntail \t\n", "a\r\nb\rc d​e", "", "\n", "---", "1", "a" + " " * 50 + "b  \n",
    "p\n- - -\nq", "PAGE 7\nr", "s\n٤\n",
]


def test_clean_text_against_plain_rules(spark):
    got = [r.t for r in spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", T.clean_text(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == [plain(t) for t in TEXTS]


@pytest.mark.parametrize("text", ["-" * 1_000_000 + "x", "-" * 1_000_000, "- " * 500_000, "1" + " " * 1_000_000 + "x", "a" + " " * 1_000_000 + "b", "page" + "\t" * 1_000_000 + "x", ("x" * 99 + "\n") * 100_000, "\n" * 1_000_000, "  " * 500_000 + "x"])
def test_long_lines_take_linear_time(spark, text):
    d = spark.createDataFrame([(text,)], "t string").select(T.clean_text(F.col("t")).alias("c"), structure.strip(F.col("t")).alias("s"), T.topic(F.col("t")).alias("q")).first()
    assert d.s == text.strip() and len(d.c) <= len(text) and (d.c == "") == (not text.strip(" -\n\t "))


def test_topic_of_many_marks(spark):
    d = spark.createDataFrame([("what is " + "?" * 500_000 + " x",), ("Is it so?? . ",)], "t string").select(T.topic(F.col("t")).alias("q")).collect()
    assert d[0].q.endswith("? x") and d[1].q == "it so"
