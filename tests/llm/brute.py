"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOWER)


def shingles(text, size=5):
    w = WORD.findall(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near(rows, percent=75):
    """Of (id, text) with distinct ids: id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    common = Counter((a, b) for ids in held.values() for a in ids for b in ids if a < b)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(rows, length=100):
    """Of (id, text) with distinct ids: id -> (bytes, removed, spans, hash of the rest)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(data[s : s + length])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def leaks(rows, items, threshold=0.75):
    """Of (id, text): id -> items of at least five words of which some window of their size holds enough."""
    own = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        own[item] = (len(w), Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    df = Counter(g for _, c in own.values() for g in c)
    weight = lambda g: np.log2(1 + len(own) / (df[g] or 1))
    out = {}
    for i, text in rows:
        w, found = WORD.findall(lower(text)), set()
        for item, (n, c) in own.items():
            for s in range(max(1, len(w) - n + 1)):
                x = Counter(tuple(w[k : k + 5]) for k in range(s, min(s + n, len(w)) - 4))
                keys = x.keys() | c.keys()
                both = sum(weight(g) * min(x[g], c[g]) for g in keys)
                if both and both >= threshold * sum(weight(g) * max(x[g], c[g]) for g in keys):
                    found.add(item)
        out[i] = found
    return out
