"""Uploads, requests, listings and passage lookup."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusq.functions import structure as S
from corpusq.functions import text as T

MOST_BYTES, LONGEST_NAME, LONGEST_MESSAGE = 25 * 1024 * 1024, 255, 4000

#: File types that are taken, with their media types.
MEDIA_TYPES = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".html": "text/html", ".htm": "text/html",
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown",
}


def safe_name(raw: Column) -> Column:
    n = S.strip(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\x00-\x1f\x7f]", ""), r"[/\\]", "_"))
    n = F.regexp_replace(n, r"^\.+", "")
    return F.substring(F.when(n == "", "document").otherwise(n), 1, LONGEST_NAME)


def extension(name: Column) -> Column:
    """The lower-case ending if it is taken, else null."""
    e = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(e.isin(*MEDIA_TYPES), e)


def admit_uploads(uploads: DataFrame) -> DataFrame:
    """uploads (batch_id, raw_name, size, ...) with filename, extension, mime and error, null if accepted (FLT3)."""
    mime = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    u = uploads.withColumn("filename", safe_name(F.col("raw_name"))).withColumn("extension", extension(F.col("filename")))
    error = F.when(F.col("extension").isNull(), "unsupported").when(F.coalesce("size", F.lit(0)) == 0, "empty").when(F.col("size") > MOST_BYTES, "too large")
    return u.withColumn("mime", F.coalesce(mime[F.col("extension")], F.lit("application/octet-stream"))).withColumn("error", error)


def batch_counts(admitted: DataFrame) -> DataFrame:
    """batch_id, accepted, rejected."""
    return admitted.groupBy("batch_id").agg(F.count_if(F.col("error").isNull()).alias("accepted"), F.count_if(F.col("error").isNotNull()).alias("rejected"))


def client(user: Column, forwarded: Column, host: Column) -> Column:
    """The user, else the first forwarded address, else the host."""
    first = F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    return F.coalesce(F.concat(F.lit("user:"), user), F.when(first != "", F.concat(F.lit("ip:"), first)), F.concat(F.lit("ip:"), F.coalesce(host, F.lit("unknown"))))


def admit_requests(requests: DataFrame, longest: int = LONGEST_MESSAGE) -> DataFrame:
    """requests (message, user, forwarded, host, ...) with client and admitted (FLT6)."""
    return requests.withColumn("client", client(F.col("user"), F.col("forwarded"), F.col("host"))).withColumn("admitted", F.length("message") <= longest)


def listing(registry: DataFrame, chunks: DataFrame, live_only: bool = False) -> DataFrame:
    """doc_id, state, uploaded_at, chunk_count of what is not deleted, newest first (FLT8, JN10)."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    r = registry.where("state = 'live'" if live_only else "state <> 'deleted'").select("doc_id", "state", "uploaded_at")
    return r.join(counts, "doc_id", "left").na.fill(0, ["chunk_count"]).orderBy(F.col("uploaded_at").desc(), "doc_id")


def passages(wanted: DataFrame, chunks: DataFrame, live: DataFrame) -> DataFrame:
    """wanted (chunk_id, ...) with text and found; chunks of documents that are not live are not found (FLT9, JN4)."""
    got = chunks.join(live.select("doc_id"), "doc_id", "left_semi").select("chunk_id", "text", F.lit(True).alias("hit"))
    return wanted.join(got, "chunk_id", "left").withColumn("found", F.col("hit").isNotNull()).drop("hit")


class _Text(HTMLParser):
    LEFT_OUT = {"script", "style", "nav", "header", "footer", "aside", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.inside = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.LEFT_OUT:
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            del self.inside[self.inside.index(tag) :]

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def html_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, text: text nodes joined by newlines, without scripts, styles and page furniture (TXT1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for html in b["html"]:
                p = _Text()
                p.feed(html or "")
                p.close()
                out.append("\n".join(p.parts))
            yield pd.DataFrame({key: b[key].to_numpy(), "text": out})

    return pages.select(key, "html").mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, text string")


def composed(text: Column) -> Column:
    """text in Unicode's composed form (NFC); only non-ASCII texts go to Python."""

    @pandas_udf("string")
    def nfc(t: pd.Series) -> pd.Series:
        return t.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def extracted(files: DataFrame) -> DataFrame:
    """files (filename, text, ...) with clean text and error_reason: unsupported, no text, only noise (TXT3)."""
    files = files.withColumn("text", composed(F.col("text")))
    clean = T.clean_text(F.col("text"))
    reason = F.when(extension(F.col("filename")).isNull(), "unsupported").when(S.strip(F.coalesce("text", F.lit(""))) == "", "no text").when(clean == "", "only noise")
    return files.withColumn("error_reason", reason).withColumn("text", F.when(F.col("error_reason").isNull(), clean))
