"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def similar(rows):
    """{doc_id: (shingles, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    groups, at = Groups(sets), {}
    for i, own in sets.items():
        for j, n in Counter(j for s in own for j in at.get(s, ())).items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                groups.join(i, j)
        for s in own:
            at.setdefault(s, []).append(i)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def vectors(rows, threshold=0.98):
    """[(vec_id, links, component)] of (vec_id, vector, label)."""
    groups, links = Groups(r[0] for r in rows), [0] * len(rows)
    fit = [v is not None and label is not None and len(v) > 0 and any(v)
           and all(x is not None and math.isfinite(x) for x in v) for _, v, label in rows]
    for i in range(len(rows)):
        for j in range(i):
            (a, v, s), (b, w, t) = rows[i], rows[j]
            if fit[i] and fit[j] and s == t and len(v) == len(w):
                v, w = (np.array(x, float) / max(map(abs, x)) for x in (v, w))
                if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    groups.join(a, b)
    return sorted((r[0], n, groups.find(r[0])) for r, n in zip(rows, links))


def repeats(texts, window):
    """[(bytes, removed, spans, sha256 of the rest)]"""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + window] for d in data for p in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - window + 1):
            if seen[d[p:p + window]] > 1:
                gone[p:p + window] = b"\1" * window
        rest = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    """kind:start:end, comma-joined"""
    found = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True,
                    "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and _luhn(digits),
                    "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def negatives(rows, every, positives=5, negatives=5):
    """[(anchor, positive, rank, negative, positive score, negative score)] of (vec_id, vector, label)."""
    fit = [(i, [math.floor(256 * x) for x in v], s) for i, v, s in rows
           if v and s is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, s) in enumerate(fit):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, t) for b, (j, w, t) in enumerate(fit)
                        if b != a and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == s][:positives]:
            hard = [x for x in scored if x[2] != s and 80 * -p <= 100 * -x[0] <= 100 * -p][:negatives]
            out += [(i, j, k + 1, x[1], -p, -x[0]) for k, x in enumerate(hard)]
    return sorted(out)


def mixture_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: most * sizes[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return target
        capped |= set(above)
