"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(rows, percent=80):
    """rows: (id, text). {id: (size, component)}"""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(k)
    for k, (_, s) in enumerate(sets):
        for j in {j for g in s for j in index[g] if j < k}:
            both = len(s & sets[j][1])
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                root[find(k)] = find(j)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (len(s), low[find(k)]) for k, (i, s) in enumerate(sets)}


def repeats(rows, width=50):
    """rows: (id, text). {id: (words, removed, sha256)}"""
    owner = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            owner[key] = min(owner.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        drop = [False] * len(w)
        for k in range(len(w) - width + 1):
            if owner[tuple(w[k : k + width])] < i:
                drop[k : k + width] = [True] * width
        kept = [x for x, d in zip(w, drop) if not d]
        out[i] = (len(w), sum(drop), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
