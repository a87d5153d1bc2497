"""Plain versions of the operators for small tables."""

import hashlib
from collections import defaultdict


def substring(docs, length):
    rows = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in rows:
        if i is not None:
            for j in range(len(w) - length + 1):
                k = tuple(w[j : j + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in rows:
        c = [False] * len(w)
        for j in range(len(w) - length + 1):
            if i is not None and first[tuple(w[j : j + length])] < i:
                c[j : j + length] = [True] * length
        out.append((i, len(w), sum(c), hashlib.sha256(b" ".join(x for x, y in zip(w, c) if not y)).hexdigest()))
    return out


def suffix(docs, length):
    rows = [(i, (t or "").encode()) for i, t in docs]
    seen = defaultdict(int)
    for _, b in rows:
        for j in range(len(b) - length + 1):
            seen[b[j : j + length]] += 1
    out = []
    for i, b in rows:
        c = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                c[j : j + length] = b"\1" * length
        spans = sum(1 for j in range(len(c)) if c[j] and (j == 0 or not c[j - 1]))
        out.append((i, len(b), sum(c), spans, hashlib.sha256(bytes(x for x, y in zip(b, c) if not y)).hexdigest()))
    return out


def kept_bytes(docs, length):
    """What is left of each text, by id."""
    rows = {i: (t or "").encode() for i, t in docs}
    seen = defaultdict(int)
    for b in rows.values():
        for j in range(len(b) - length + 1):
            seen[b[j : j + length]] += 1
    out = {}
    for i, b in rows.items():
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        out[i] = bytes(x for x, y in zip(b, gone) if not y)
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(docs, width, percent):
    sets = [(i, shingles(t, width)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x & y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets)]


def contamination(text, items, width):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for key, t in items:
        v = word.findall((t or "").translate(LOWER))
        for k in [v[i : i + width] for i in range(max(1, len(v) - width + 1))] if v else []:
            for j in range(len(w) - len(k) + 1):
                if w[j : j + len(k)] == k:
                    hit.update(range(j, j + len(k)))
                    found.add(str(key))
    return len(w), len(hit), sorted(found)
