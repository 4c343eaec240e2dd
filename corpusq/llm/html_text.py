"""Main text of web pages: a suffix array over the pages of a host, and page structure.

1. Pages are parsed into blocks of text with a role: main (inside article or main), chrome (menus, headers,
   footers, sidebars, notices, adverts, forms, comments: by element, role or class name) or plain. Where main
   blocks carry less than MAIN_SHARE of the words that are not chrome (teasers), they are plain ones too.
2. The words outside main blocks of a host's distinct pages (pages with equal blocks are one) are concatenated,
   each page closed by a word of its own, and put into a suffix array with the lengths of common prefixes (LCP).
   Neighbours with an LCP of RUN words or more form an interval: a run that stands on the interval's pages. A run
   on enough distinct pages of its host is boilerplate; its words go, whatever block they stand in, and unique
   runs stay. Longer common substrings need no search of their own: each word of one lies in a run of RUN words
   that stands on at least as many pages. So the array is ordered by DEPTH words, a power of two from RUN on.
3. Of what is unique, structure takes chrome. Main blocks stay, what repeats there is quoted or copied text,
   except a block that half of the host's distinct pages have between different neighbours.

A large host is dealt by a hash of its pages' blocks into shards of SHARD bytes of words, each with an array of its
own. Every shard gives the pages of each of its runs, and these are added up over the host, so shards change no
result. Html is never shuffled while the boilerplate runs of all hosts are few enough to be broadcast; beyond
BROADCAST_RUNS pages meet the runs of their host in groups of bounded size.

Defined cases: null or empty html gives an empty text; a null or odd url belongs to the host ''; null page_id
and repeated rows give one output row per input row; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import small_batches, stage

#: Words of a run; pages of a host that it must stand on: a share of them, but PAGES at least, and MOST_PAGES are enough in any host; the same for blocks of an article.
RUN, PAGES, SHARE, MOST_PAGES, SITE_PAGES, SITE_SHARE = 6, 3, 0.02, 10, 10, 0.5
#: Words that suffixes are ordered by.
DEPTH = 8
#: Share of a page's words outside chrome from which its main blocks are the article.
MAIN_SHARE = 0.2
#: Bytes of words that one suffix array covers, and bytes of html of one group, about.
SHARD, GROUP = 1 << 18, 4 << 20
#: Runs (8 bytes each) and large hosts (two numbers each) that are broadcast at most; more are joined by shuffling.
BROADCAST_RUNS, BROADCAST_HOSTS = 4_000_000, 100_000

#: Elements whose content is no text, that end a block, and that hold what is not the article.
RAW = ["script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "title", "head"]
BLOCK = set("""address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CHROME = {"nav", "footer", "aside", "form", "button", "menu", "dialog"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: Class names and ids: some mean chrome alone or beside neutral parts (site-footer), some only beside one (related_posts, not related); with others (with-sidebar) they say nothing.
CHROME_NAMES = set("""ad ads advert adverts advertisement advertising adsense sponsored cookie cookies consent gdpr sidebar nav navbar navigation breadcrumb
    breadcrumbs footer masthead comment comments disqus newsletter pagination""".split())
UNSURE_NAMES = set("""sponsor sponsors promo promotion alert popup modal overlay aside menu topbar toolbar respond reply replies share sharing social related
    recommended recommendations subscribe subscription signup login widget widgets pager skip""".split())
BESIDE = set("site page global list item items box block area section bar banner notice notices posts links buttons slot unit".split())
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}

_RAW = re.compile(r"<(script|style|noscript|template|svg|iframe|object|canvas|textarea|select|title)(?=[\s/>])", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW if t != "head"}
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)", re.I)
#: Most tags: of bounded length and closed. Others take the scanner's way.
_USUAL = re.compile(rf"<(?!(?:{'|'.join(_RAW_END)})[\s/>])(/?)([a-z][\w:-]{{0,30}}+)(?![\w:-])((?:[^<>\"']{{1,100}}+|\"[^\"<>]{{0,400}}+\"|'[^'<>]{{0,400}}+'){{0,30}}+)>", re.I)
_EVENT, _BLANK = re.compile("[>\"']"), re.compile(r"\s*")
_NAME, _EQUALS, _VALUE = re.compile(r"[^\s\"'<>=/]+"), re.compile(r"\s*=\s*"), re.compile(r"[^\s\"'>]+")


class Scanner:
    """Markup of a page, in time linear in its length whatever is left open: what has failed once is known to fail wherever another try meets it, and ends that don't come any more are not looked for."""

    def __init__(self, page: str):
        self.page, self.event = page, (0, -1)
        self.last = {x: page.rfind(x) for x in (">", '"', "'", "]]>")}
        self.open_tags: set[int] = set()
        self.open_raw: set[int] = set()

    def _closing(self, quote: int) -> int:
        """Where the quoted value that begins at `quote` ends, or -1."""
        kind = self.page[quote]
        return self.page.find(kind, quote + 1) if quote < self.last[kind] else -1

    def _next_event(self, at: int) -> int:
        since, found = self.event
        if not since <= at <= found:
            m = _EVENT.search(self.page, at)
            self.event = at, m.start() if m else len(self.page)
        return self.event[1]

    def tag_end(self, at: int) -> int:
        """The first > from `at` on that stands in no quoted value, or -1."""
        met, e = [], self._next_event(at)
        while e < len(self.page) and e not in self.open_tags:
            if self.page[e] == ">":
                return e
            met.append(e)
            end = self._closing(e)
            if end < 0:
                break
            m = _EVENT.search(self.page, end + 1)
            e = m.start() if m else len(self.page)
        self.open_tags.update(met)
        return -1

    def self_closed(self, at: int) -> int:
        """The end of "/>" after nothing but whole attributes from `at` on, or -1: it neither ends an unquoted value nor stands in a quoted one."""
        met = []
        while True:
            at = _BLANK.match(self.page, at).end()
            if at in self.open_raw:
                break
            met.append(at)
            m = _NAME.match(self.page, at)
            if not m:
                if self.page.startswith("/>", at):
                    return at + 2
                break
            at = m.end()
            if m := _EQUALS.match(self.page, at):
                value = m.end()
                if self.page[value : value + 1] in ("'", '"'):
                    end = self._closing(value)
                    if end < 0:
                        break
                    at = end + 1
                elif m := _VALUE.match(self.page, value):
                    at = m.end()
                else:
                    break
        self.open_raw.update(met)
        return -1

    def markup(self, at: int) -> tuple[int, str, str, str] | None:
        """End, slash, tag and attributes of the markup that begins at `at`; no tag: a comment, a declaration, an element whose content is no text."""
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(page)), "", "", ""
        if page[at : at + 9].upper() == "<![CDATA[" and at + 9 <= self.last["]]>"]:
            return page.find("]]>", at + 9) + 3, "", "", ""
        if at > self.last[">"]:
            return None
        if m := _RAW.match(page, at):
            end = self.self_closed(m.end())
            if end < 0:
                name = m[1].lower()
                ending = _RAW_END.get(name) or re.compile(rf"</{name}\s*>", re.I)  # some other letters count as i, k and s
                close = ending.search(page, page.find(">", m.end()) + 1)
                end = close.end() if close else len(page)
            return end, "", "", ""
        if m := _TAG.match(page, at):
            end = self.tag_end(m.end())
            return (end + 1, m[1], m[2], page[m.end() : end]) if end >= 0 else None
        if page[at + 1 : at + 2] in ("!", "?"):
            return page.find(">", at) + 1, "", "", ""
        return None

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """Start, end, slash, tag, attributes of all markup."""
        at = self.page.find("<")
        while at >= 0:
            m = _USUAL.match(self.page, at)
            got = (m.end(), *m.groups()) if m else self.markup(at)
            if got:
                yield at, *got
            at = self.page.find("<", got[0] if got else at + 1)


_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[_-]+")


def _names_chrome(value: str) -> bool:
    """Whether one of the class names or ids consists of chrome names and parts that may stand beside them."""
    for name in value.split():
        parts = {x for x in _PART.split(name) if x}
        sure, unsure, beside = parts & CHROME_NAMES, parts & UNSURE_NAMES, parts & BESIDE
        if len(sure) + len(unsure) + len(beside) == len(parts) and (sure or unsure and beside):
            return True
    return False


def _is_chrome(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in CHROME or (tag == "header" and not in_main):
        return True
    if not attrs or tag in ("body", "html") or tag in ("article", "main") and "comment" not in attrs.lower():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and _names_chrome(value):
            return True
        if name == "role" and value in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(role, text) of the page's blocks in their order; role: m(ain), c(hrome), p(lain). A page has no plain blocks beside main ones: either they are chrome, or all are plain."""
    out: list[tuple[str, str]] = []
    now: list[str] = []
    main, chrome, chrome_tag, in_head = 0, 0, "", False

    def close() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text and not in_head:
            out.append(("c" if chrome else "m" if main else "p", text))

    at, page = 0, page or ""
    for start, stop, slash, tag, attrs in Scanner(page):
        if start > at:
            text = page[at:start]
            now.append(html.unescape(text) if "&" in text else text)
        at = stop
        if not tag:
            if page.startswith("<![CDATA[", start) and page.endswith("]]>", start, stop):
                now.append(page[start + 9 : stop - 3])
            continue
        tag = tag.lower()
        if tag in BLOCK or tag == "head":
            close()
        if tag == "head":
            in_head = not slash
        elif tag == "body":
            in_head = False
        if tag in VOID:
            continue
        if slash:
            if chrome and tag == chrome_tag:
                chrome -= 1
                if not chrome:
                    continue
            if tag in ("article", "main") and main and not chrome:
                main -= 1
        elif chrome:
            if tag == chrome_tag and not attrs.endswith("/"):
                chrome += 1
            elif tag == "main" or tag == "article" and chrome_tag in ("nav", "header") and not main:  # a menu that was never closed
                chrome, main = 0, main + 1
        elif attrs.endswith("/"):
            continue
        elif _is_chrome(tag, attrs, main > 0):
            close()
            chrome, chrome_tag = 1, tag
        elif tag in ("article", "main"):
            main += 1
    if at < len(page):
        now.append(html.unescape(page[at:]))
    close()
    size = {"m": 0, "p": 0, "c": 0}
    for r, t in out:
        size[r] += t.count(" ") + 1
    if size["m"] and size["p"]:
        was, now_is = ("p", "c") if size["m"] >= MAIN_SHARE * (size["m"] + size["p"]) else ("m", "p")
        out = [(now_is if r == was else r, t) for r, t in out]
    return out


def suffix_array(words: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stream ordered by the `depth` words from them on, and how many of these words each has in common with the place before it. Prefix doubling; depth: a power of two."""
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1]]
    while 1 << (len(ranks) - 1) < depth:
        step, last = 1 << (len(ranks) - 1), ranks[-1]
        after = np.zeros(n, np.int64)
        after[: n - step] = last[step:] + 1
        ranks.append(np.unique(last * (last.max() + 2) + after, return_inverse=True)[1])
    order = np.argsort(ranks[-1], kind="stable")
    lcp, here, before = np.zeros(n, np.int64), order[1:].copy(), order[:-1].copy()
    for k in range(len(ranks) - 1, -1, -1):
        r = np.append(ranks[k], [-1, -2])  # places past the end are like none
        same = (lcp[1:] + (1 << k) <= depth) & (r[np.minimum(here, n)] == r[np.where(before < n, before, n + 1)])
        for x in (lcp[1:], here, before):
            x[same] += 1 << k
    return order, lcp


def runs(words: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the suffix array with an LCP of at least `run`: for each place its interval; for each interval one of its places and its pages. words: numbers; each page ends with a number of its own."""
    order, lcp = suffix_array(words, 1 << (run - 1).bit_length())
    interval = np.cumsum(lcp < run) - 1
    of_place = np.empty(len(words), np.int64)
    of_place[order] = interval
    by_page = np.unique(interval * (page.max() + 1) + page[order])
    pages = np.bincount(by_page // (page.max() + 1))
    return of_place, order[np.flatnonzero(lcp < run)], pages


def covered(starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Whether each place lies in one of the runs that start at the marked places."""
    ends = np.zeros(len(starts) + run, np.int64)
    at = np.flatnonzero(starts)
    ends[at] += 1
    ends[at + run] -= 1
    return np.cumsum(ends)[: len(starts)] > 0


def least_pages(pages: int) -> float:
    """Distinct pages of a host of so many from which a run is boilerplate."""
    return min(MOST_PAGES, max(PAGES, SHARE * pages))


def stream(texts: list[list[str]], hosts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all pages as numbers, a number of its own after each page; their pages; for each place a hash of the host and the RUN words from it on, and whether these lie within a page."""
    numbers: dict[str, int] = {}
    of, size = [], []
    for page in texts:
        was = len(of)
        for text in page:
            of += [numbers.setdefault(w, len(numbers)) for w in text.split(" ")]
        of.append(-1)
        size.append(len(of) - was)
    words, page = np.array(of, np.int64), np.repeat(np.arange(len(texts)), size)
    within = words >= 0
    words[~within] = len(numbers) + np.arange(len(texts))
    hashes = np.append(pd.util.hash_array(np.array(list(numbers), dtype=object), categorize=False) if numbers else np.zeros(0, np.uint64), np.zeros(len(texts), np.uint64))[words]
    n = max(0, len(words) - RUN + 1)
    keys, inside = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
    inside[:n] = True
    for k in range(RUN):
        keys[:n] = keys[:n] * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        inside[:n] &= within[k : k + n]
    keys = (keys ^ np.array(hosts, np.int64).view(np.uint64)[page]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return words, page, (keys ^ keys >> np.uint64(29)).view(np.int64), inside


def _hash(*texts: str) -> int:
    h = xxhash.xxh64(seed=3)
    for t in texts:
        h.update(t.encode("utf-8", "replace") + b"\0")
    return h.intdigest() - (1 << 63)


def main_keys(page: list[tuple[str, str]], host: int) -> list[tuple[int, int, int]]:
    """(key, neighbour before, neighbour after) of the main blocks of RUN words or more, each block once; key: a hash of the host and the text; neighbours: hashes, 0 at either end of the article."""
    mains = [t for r, t in page if r == "m"]
    side = lambda i: _hash(mains[i]) if 0 <= i < len(mains) else 0
    return [(_hash(str(host), t), side(i - 1), side(i + 1)) for t, i in {t: i for i, t in reversed([*enumerate(mains)])}.items() if t.count(" ") + 1 >= RUN]


def main_texts(pages: list[list[tuple[str, str]]], hosts: list[int], known: np.ndarray) -> list[tuple[str, int, int]]:
    """Main text of each page, blocks that repeated runs took whole, and blocks that structure took. known: sorted keys of the boilerplate runs and main blocks."""
    _, page, keys, inside = stream([[t for r, t in p if r != "m"] for p in pages], hosts)

    def in_known(x: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)

    gone = covered(inside & in_known(keys))
    first = np.searchsorted(page, np.arange(len(pages)))
    out = []
    for i, bs in enumerate(pages):
        kept, plain, by_run, by_mark, at = [], [], 0, 0, int(first[i])
        boiler = {}
        if len(known) and any(r == "m" for r, _ in bs):
            ms = [k for k, _, _ in main_keys(bs, hosts[i])]
            boiler = {k for k, hit in zip(ms, in_known(np.array(ms, np.int64)).tolist(), strict=True) if hit}
        for role, text in bs:
            if role == "m":
                if boiler and text.count(" ") + 1 >= RUN and _hash(str(hosts[i]), text) in boiler:
                    by_run += 1
                else:
                    kept.append(text)
                continue
            size = text.count(" ") + 1
            taken = gone[at : at + size]
            at += size
            if taken.all():
                by_run += 1
            elif role == "c":
                by_mark += 1
            elif not taken.any():
                kept.append(text)
            else:
                kept.append(" ".join(w for w, t in zip(text.split(" "), taken.tolist(), strict=True) if not t))
            if role == "p":
                plain.append(text)
        # A page of which nothing is unique is a copy of other pages, not boilerplate.
        if not kept and plain:
            kept, by_run = plain, by_run - len(plain)
        out.append((" ".join(kept), by_run, by_mark))
    return out


def _hosted(pages: DataFrame) -> DataFrame:
    """page_id, url, html and host: a hash of the url's host name."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    return pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"))


def _side_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, content, words, mains): a hash of all blocks, the words outside main blocks, and the keys of main blocks."""
    for b in batches:
        rows = []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            bs = blocks(page)
            mains = [{"key": k, "before": x, "after": y} for k, x, y in main_keys(bs, host)]
            rows.append((host, _hash(*[r + t for r, t in bs]), " ".join(t for r, t in bs if r != "m"), mains))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(_MAIN)), strict=True)], ["host", "content", "words", "mains"])


_MAIN = pa.struct([("key", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])


def _shard_runs(df: pd.DataFrame) -> pd.DataFrame:
    """The runs of one shard: key, pages of the shard; pages of the host. Runs that can't become boilerplate are left out where the shard is the whole host."""
    host, n = int(df["host"].iloc[0]), df["host_pages"].iloc[0]
    words, page, keys, inside = stream([[t] if t else [] for t in df["words"]], [host] * len(df))
    _, place, pages = runs(words, page)
    ok = inside[place] & (pages >= (least_pages(len(df)) if pd.isna(n) else 1))
    return pd.DataFrame({"host": host, "key": keys[place[ok]], "pages": pages[ok], "host_pages": len(df) if pd.isna(n) else int(n)})


def boilerplate(pages: DataFrame, shard: int = SHARD) -> DataFrame:
    """host and key of the runs outside main blocks, and of the main blocks, that are boilerplate."""
    seen = _hosted(pages).select("host", "html").mapInArrow(_side_words, "host long, content long, words string, mains array<struct<key:long,before:long,after:long>>")
    # Copies of a page are one page; they are dropped before they are shuffled.
    seen = stage(seen.dropDuplicates(["host", "content"]))
    hosts = stage(seen.groupBy("host").agg(F.count("*").alias("host_pages"), F.ceil(F.sum(F.length("words")) / shard).cast("int").alias("shards")))
    large = hosts.where("shards > 1")
    dealt = seen.join(F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large, "host", "left")
    dealt = dealt.withColumn("shard", F.pmod("content", F.coalesce("shards", F.lit(1)).cast("long")))
    counted = dealt.select("host", "shard", "words", "host_pages").groupBy("host", "shard").applyInPandas(_shard_runs, "host long, key long, pages long, host_pages long")
    least = F.least(F.lit(float(MOST_PAGES)), F.greatest(F.lit(float(PAGES)), SHARE * F.max("host_pages")))
    found = counted.groupBy("host", "key").agg(F.sum("pages").alias("n"), least.alias("least")).where("n >= least").select("host", "key")
    # Main blocks on half of a host's pages: few by their nature, at most twice a page's blocks.
    site = F.greatest(F.lit(float(SITE_PAGES)), SITE_SHARE * F.col("host_pages"))
    mains = seen.select("host", F.explode("mains").alias("m")).select("host", "m.*")
    often = mains.select("host", "key").groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= SITE_PAGES)
    often = stage(often.join(hosts, "host").where(F.col("n") >= site).select("host", "key", site.alias("site")))
    if not often.isEmpty():
        sides = mains.join(often, ["host", "key"]).groupBy("host", "key", "site").agg(F.count_distinct("before").alias("b"), F.count_distinct("after").alias("a"))
        found = found.unionByName(sides.where("least(a, b) >= site / 2").select("host", "key"))
    return stage(found)


def html_text(pages: DataFrame, shard: int = SHARD, group: int = GROUP, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """page_id, url, text, n_chars, n_run_blocks (blocks that repeated runs took whole), n_mark_blocks (blocks that structure took)."""
    spark = pages.sparkSession
    small_batches(spark)
    known = boilerplate(pages, shard)
    kind = dict(pages.dtypes)["page_id"]
    result = f"page_id {kind}, url string, text string, n_run_blocks int, n_mark_blocks int"
    hosted = _hosted(pages)

    def columns(htmls: list, hosts: list[int], keys: np.ndarray) -> list:
        return list(zip(*main_texts([blocks(x) for x in htmls], hosts, keys), strict=True)) or [[]] * 3

    if known.count() <= broadcast_runs:
        shared = spark.sparkContext.broadcast(np.sort(known.select("key").toPandas()["key"].to_numpy(np.int64)))

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text, run, mark = columns(b.column(2).to_pylist(), b.column(3).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(run, pa.int32()), pa.array(mark, pa.int32())], ["page_id", "url", "text", "n_run_blocks", "n_mark_blocks"])

        out = hosted.mapInArrow(extract, result)
    else:

        def extract_group(df: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            text, run, mark = columns(df["html"].tolist(), df["host"].tolist(), np.sort(keys["key"].to_numpy(np.int64)))
            return pd.DataFrame({"page_id": df["page_id"], "url": df["url"].astype(object), "text": pd.Series(text, dtype=object), "n_run_blocks": run, "n_mark_blocks": mark})

        # Pages of a host are dealt into groups of about `group` bytes of html; its runs go to each of them.
        parts = hosted.groupBy("host").agg(F.ceil((F.sum(F.length(F.coalesce("html", F.lit("")))) + 1) / group).cast("int").alias("parts"))
        parts = stage(parts.where("parts > 1"))
        parts = F.broadcast(parts) if parts.count() <= BROADCAST_HOSTS else parts
        dealt = hosted.join(parts, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("parts", F.lit(1)).cast("long")))
        to_all = known.join(parts, "host", "left").select("host", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part"))
        out = dealt.drop("parts").groupBy("host", "part").cogroup(to_all.groupBy("host", "part")).applyInPandas(extract_group, result)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_run_blocks", "n_mark_blocks")
