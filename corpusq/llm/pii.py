"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over each whole text and finds anchors: at-signs, digits around a dot, pairs of
digits, a plus before a digit, schemes of addresses, and words that announce an identifier. From each anchor a
deterministic parser expands to the boundaries and validates what it has found; it never tries another start or end.
Every parser walks on from where its kind's last span ended, so the work is linear in the text.

Kinds: email, ip, card (Luhn) and phone have the bounds of these patterns, leftmost and non-overlapping per kind,
and a match that fails its check is dropped:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)     parts of at most 255
    card   [0-9]([\\x20-]?[0-9])+                     13 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]               9 to 15 digits

and the anchors add: url (an address whose authority names a user, or that leads to a user's folder or profile;
mailto: and tel: targets), iban (after its cue, check digits right), national_id (after its cue, 3-2-4 digits with an
area that is given out), account (after a cue, 6 to 20 letters and digits with at least 5 digits). Access tokens and
passwords are no personal data and are left alone.

Defined cases: null or empty text has no spans; null doc_id and repeated rows give one output row per input row; all
other columns of the input are kept by with_pii() and redacted(), whatever their names (with_pii's own column takes
the place of one with its name), and ignored by digest(). Positions are code points, ends exclusive. Texts that are
no valid UTF-8 are read with replacement characters.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import LOWER, UPPER, small_batches

#: The contract's kinds, then those that anchors add; spans are listed in this order.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "iban", "national_id", "account"]

#: Schemes, and words that announce an identifier. All in lower case.
SCHEMES = ["http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "tel:"]
CUES = {
    "iban": ["iban"],
    "national_id": ["ssn", "social security number", "social security no"],
    "account": ["account number", "account no", "acct", "kontonummer", "kontonr", "numéro de compte", "número de cuenta", "passport number", "passport no", "passeport", "pasaporte", "reisepassnummer", "customer number", "kundennummer"],
}

LABEL, DIGITS, PHONE = re.compile(r"[A-Za-z0-9-]+"), re.compile(r"[0-9]+"), re.compile(r"[\x20().0-9-]*")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = frozenset("0123456789")
#: What may stand between a cue and its value, and the values; all of bounded length.
GAP = re.compile(r"[\x20\t]{0,4}(?:(?:is|no|nr|number|ist|est|es)\b)?[\x20\t.:=#]{0,6}", re.ASCII | re.IGNORECASE)
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}", re.ASCII)
NATIONAL = re.compile(r"(?!000|666|9)[0-9]{3}([-\x20])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9-])", re.ASCII)
ACCOUNT = re.compile(r"[A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){5,19}(?![A-Za-z0-9])", re.ASCII)
ADDRESS = re.compile(r"[^\x00-\x20\"'<>\\^`{|}\x7f]+")
USER = re.compile(r"[^/?#@]+@[^/?#@]+|[^/?#]+/(?:~[^/?#]+|@[^/?#]+|(?:user|users|profile|profiles|people|in|u)/[^/?#]+)", re.IGNORECASE)

_TO_LOWER = str.maketrans(UPPER, LOWER)


@functools.lru_cache(maxsize=1)
def automaton():
    """Anchors to (kind, length of the anchor)."""
    import ahocorasick

    d, out = "0123456789", ahocorasick.Automaton()
    anchors = {"@": "email"} | {f"{a}.{b}": "ip" for a in d for b in d} | {f"{a}{s}{b}": "card" for a in d for b in d for s in ("", " ", "-")} | {f"+{a}": "phone" for a in d}
    anchors |= {s: "url" for s in SCHEMES} | {c: kind for kind, cues in CUES.items() for c in cues}
    for a, kind in anchors.items():
        out.add_word(a, (kind, len(a)))
    out.make_automaton()
    return out


def _luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _email(t: str, at: int, after: int) -> tuple[bool, int, int] | None:
    start = at
    while start > after and t[start - 1] in LOCAL:
        start -= 1
    m = LABEL.match(t, at + 1) if start < at else None
    end, dots = m.end() if m else 0, 0
    while m and t[end : end + 1] == "." and (m := LABEL.match(t, end + 1)):
        end, dots = m.end(), dots + 1
    return (True, start, end) if dots else None


def _ip(t: str, at: int, after: int) -> tuple[bool, int, int]:
    start = at
    while start > after and t[start - 1] in DIGIT:
        start -= 1
    parts, end = [], start
    while len(parts) < 4 and (m := DIGITS.match(t, end + bool(parts))):
        parts.append(m.group().lstrip("0"))
        end = m.end()
        if t[end : end + 1] != ".":
            break
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts), start, end


def _card(t: str, at: int, after: int) -> tuple[bool, int, int]:
    found, n, end = [], 0, at
    while m := DIGITS.match(t, end):
        if n <= 19:
            found.append(m.group())
        n, end = n + m.end() - end, m.end()
        if t[end : end + 1] not in (" ", "-") or t[end + 1 : end + 2] not in DIGIT:
            break
        end += 1
    return 13 <= n <= 19 and _luhn("".join(found)), at, end


def _phone(t: str, at: int, after: int) -> tuple[bool, int, int] | None:
    run = PHONE.match(t, at + 2).group().rstrip(" ().-")
    if len(run) < 2:
        return None
    n = 1 + len(run) - sum(map(run.count, " ().-"))
    return 9 <= n <= 15, at, at + 2 + len(run)


def _url(t: str, at: int, after: int) -> tuple[bool, int, int] | None:
    m = ADDRESS.match(t, at)
    end = at + len(m.group().rstrip(".,;:!?)]}*_"))
    scheme, _, rest = t[at:end].partition(":")
    if scheme.lower() in ("mailto", "tel"):
        return ("@" in rest if scheme.lower() == "mailto" else sum(c in DIGIT for c in rest) >= 5), at, end
    return USER.match(rest[2:]) is not None, at, end


def _after_cue(kind: str, t: str, at: int, size: int) -> tuple[bool, int, int] | None:
    """The value that follows a cue, if the cue is a word of its own."""
    if t[at - 1 : at].isalnum() or t[at + size : at + size + 1].isalpha():
        return None
    start = GAP.match(t, at + size).end()
    m = {"iban": IBAN, "national_id": NATIONAL, "account": ACCOUNT}[kind].match(t, start)
    if not m:
        return None
    if kind == "iban":
        # Groups are of four; what follows the number may look like one more of them, so the check decides.
        ends = [e for e in range(m.end(), start + 14, -1) if t[e - 1] != " " and not t[e : e + 1].isalnum()]
        return next(((True, start, e) for e in ends if _iban(t[start:e].replace(" ", ""))), None)
    if kind == "account":
        # Words may follow the number: it ends with the last group that holds a digit.
        value = re.match(r".*[0-9][A-Za-z0-9]*", m.group())
        n = sum(c in DIGIT for c in value.group()) if value else 0
        return (n >= 5, start, start + value.end()) if value else None
    return True, m.start(), m.end()


def _iban(number: str) -> bool:
    return 15 <= len(number) <= 34 and int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url}


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), in the order of KINDS and then of places."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letter becomes two
        low = text.translate(_TO_LOWER)
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton().iter(low):
        at = last + 1 - size
        if at < after[kind]:
            continue
        parser = _PARSERS.get(kind)
        got = parser(text, at, after[kind]) if parser else _after_cue(kind, text, at, size)
        if got:
            ok, start, end = got
            after[kind] = end
            if ok:
                out[kind].append((start, end))
    return [(k, s, e) for k in KINDS for s, e in out[k]]


def _texts(column: pa.Array) -> list[str | None]:
    return [t if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


_SPANS = "array<struct<kind: string, start: long, end: long>>"


def _find():
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(_SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t)] for t in _texts(texts)], kind)

    return find


def with_pii(docs: DataFrame, text: str = "text", column: str = "pii") -> DataFrame:
    """docs with the spans of each text: an array of (kind, start, end)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(column, _find()(F.col(f"`{text}`").cast("string")))


def replaced(text: str | None) -> str | None:
    """text with each span replaced by its kind; overlapping spans become one, named by the one that starts first."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in texts replaced by <kind>."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        return pa.array([replaced(t) for t in _texts(texts)], pa.string())

    return docs.withColumn(text, redact(F.col(f"`{text}`").cast("string")))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    out = with_pii(docs.select("doc_id", "text"))
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    return out.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_listed(of(*BASE)), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
