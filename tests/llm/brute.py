"""Plain versions of the operators, for small tables: lists in, lists out."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fingerprint(t):
    w = [x.translate(LOWER) for x in words(t)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, distance=4):
    """A class number for each fingerprint; those that are linked in steps have the same."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    return group


def line_key(s):
    return s.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def kept_lines(data):
    """data: (doc_id, text). The lines that each row keeps."""
    split = [(-1 if i is None else i, (t or "").split("\n")) for i, t in data]
    where = defaultdict(set)
    for i, ls in split:
        for s in ls:
            where[line_key(s)].add(i)
    return [[s for s in ls if not (len(line_key(s)) >= 20 and len(where[line_key(s)]) >= 3 and max(where[line_key(s)]) != i)] for i, ls in split]


def features(text, bits):
    """Hashed words, pairs of neighbours and word shapes with the square roots of their counts, scaled to length 1."""
    ws = re.findall(r"[^\W_]+|[^\w\s]+|_+", text or "")
    shape = lambda w: ("A" if w.isupper() and len(w) > 1 else "a" if w.isalpha() else "0" if w.isalnum() else "#") + str(min(len(w), 20) // 2)
    one = [xxhash.xxh64_intdigest(w.lower().encode("utf-8", "replace"), 7) for w in ws]
    two = [((a * 0x9E3779B97F4A7C15 & 2**64 - 1) ^ ((b * 0xC2B2AE3D27D4EB4F & 2**64 - 1) >> 3)) >> 17 for a, b in zip(one, one[1:], strict=False)]
    n = defaultdict(int)
    for h in [*one, *two, *(xxhash.xxh64_intdigest(shape(w), 11) for w in ws)]:
        n[h & (1 << bits) - 1] += 1
    size = math.sqrt(sum(n.values()))
    return {k: math.sqrt(v) / size for k, v in n.items()}


def ftrl(rows, bits=18, epochs=3, alpha=0.5, beta=1.0, l1=0.05, l2=0.05):
    """rows: (features, label) in order of doc_id. Weights by follow-the-regularised-leader, one weight at a time; None is the intercept."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    labels = [y for _, y in rows]
    show = [i for i, y in enumerate(labels) for _ in range(max(1, round(len(labels) / 2 / max(1, labels.count(y)))))]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(show).tolist():
            x = rows[i][0] | {None: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - rows[i][1]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z}


def score(text, weights, bits=18):
    s = weights.get(None, 0.0) + sum(weights.get(k, 0.0) * v for k, v in features(text, bits).items())
    return 1 / (1 + math.exp(-max(-30, min(30, s))))


def mix(data):
    """data: (doc_id, text, source). (position, doc_id) of each time a document is taken, and the targets by source."""
    size = {s: sum(len(words(t)) for _, t, o in data if o == s) for s in {o for *_, o in data}}
    order = sorted(size, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    slope = {s: (0.5, 0.0, -0.5)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while free:  # sources over their limit stop there; the others share what is left
        full = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]}
        if not full:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    out = []
    for s in order:
        start = 0
        for i, t, _ in sorted((d for d in data if d[2] == s), key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest()):
            n = len(words(t))
            for p in range(2):
                middle = start + n / 2 + p * size[s]
                if n and middle < target[s]:
                    a, k = min(1.0, middle / target[s]), slope[s]
                    out.append((a if k == 0 else (1 + k - math.sqrt(max(0.0, (1 + k) ** 2 - 4 * k * a))) / (2 * k), i))
            start += n
    return out, target
